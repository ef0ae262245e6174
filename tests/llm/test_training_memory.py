"""What training takes on the driver."""

import random
import tracemalloc

import numpy as np

from graphloom.llm import toxicity


def test_training_holds_few_bytes_for_each_word_of_its_texts():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(300)).encode() for _ in range(300)]
    labels = np.arange(len(texts)) % 2
    tracemalloc.start()
    try:
        toxicity.train(texts, labels, steps=3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 850 * 300 * 300, peak
