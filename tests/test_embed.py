"""Vectors by an ONNX model made for the test: token vectors looked up in a table."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import Whitespace

from graphloom.operators import embed
from graphloom.schema import as_nodes


def field(number, value):
    """A field of a protocol buffer: a whole number, or bytes with their length."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_of(table):
    """An ONNX model of one node: hidden = Gather(table, input_ids)."""
    shape = lambda *names: field(2, b"".join(field(1, field(2, n)) for n in names))
    value = lambda name, kind, *names: field(1, name) + field(2, field(1, field(1, kind) + shape(*names)))
    tensor = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, b"table") + field(9, table.astype("<f4").tobytes())
    node = field(1, b"table") + field(1, b"input_ids") + field(2, b"hidden") + field(4, b"Gather")
    graph = field(1, node) + field(2, b"g") + field(5, tensor) + field(11, value(b"input_ids", 7, b"b", b"s")) + field(12, value(b"hidden", 1, b"b", b"s", b"d"))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


@pytest.fixture
def made(tmp_path):
    words = ["[UNK]", *(f"w{i}" for i in range(40))]
    own = Tokenizer(WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    own.pre_tokenizer = Whitespace()
    own.save(str(tmp_path / "t.json"))
    table = np.random.default_rng(1).normal(size=(len(words), 6)).astype(np.float32)
    (tmp_path / "m.onnx").write_bytes(model_of(table))
    return words, table, str(tmp_path / "m.onnx"), str(tmp_path / "t.json")


def by_hand(text, words, table, most):
    ids = [words.index(w) if w in words else 0 for w in (text or "").split()][:most]
    mean = table[ids].astype(float).mean(0) if ids else np.zeros(table.shape[1])
    return mean / max(np.linalg.norm(mean), 1e-12)


@pytest.mark.parametrize("budget", [1, 50, 16384])
def test_vectors_are_normed_means_of_token_vectors_in_any_run(made, budget):
    words, table, model, tokenizer = made
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice([*words[1:], "unknown"]) for _ in range(rnd.choice((0, 1, 3, 10, 60)))) for _ in range(70)] + ["", None]
    found = embed.OnnxEncoder(model, tokenizer, most=40, budget=budget).encode(texts)
    assert np.allclose(found, [by_hand(t, words, table, 40) for t in texts], atol=1e-5)
    assert embed.OnnxEncoder(model, tokenizer).encode([]) == []


def test_runs_pad_little_and_hold_their_budget():
    rnd = random.Random(3)
    lengths = [int(rnd.lognormvariate(4, 1.2)) + 1 for _ in range(1000)] + [9000]
    runs = embed.runs(lengths, 16384)
    assert sorted(i for r in runs for i in r) == list(range(len(lengths)))
    padded = sum(len(r) * max(lengths[i] for i in r) for r in runs)
    assert all(len(r) == 1 or len(r) * max(lengths[i] for i in r) <= 16384 for r in runs)
    assert padded < 1.35 * sum(lengths)  # batches of 32 in the given order would take several times that
    assert sum(32 * max(lengths[k : k + 32]) for k in range(0, 1000, 32)) > 2 * padded


def test_nodes_get_vectors_of_the_model(spark, made):
    words, table, model, tokenizer = made
    rows = [("a", "Function", "w1", "w2 w3", None, None), ("b", "Module", "w1", None, None, None), ("c", "Document", "w5", None, "w7 w7", "w6"), ("d", "Document", "w5", None, None, None)]
    nodes = as_nodes(spark.createDataFrame(rows, "uid string, label string, name string, signature string, content string, title string"))
    found = {r["uid"]: r["embedding"] for r in embed.embed(nodes, embed.OnnxEncoder(model, tokenizer)).collect()}
    assert found["b"] is None and found["d"] is None
    assert np.allclose(found["c"], by_hand("w6 w7 w7", words, table, 99), atol=1e-5) and len(found["a"]) == 6


def test_hashed_vectors_equal_a_plain_count(spark):
    """The default encoder against counts made anew: signed buckets of words and their trigrams."""
    import zlib

    def plain(words, dim):
        out = np.zeros(dim)
        for w in (f"<{x}>" for x in words):
            for gram in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                h = zlib.crc32(gram.encode())
                out[h % dim] += 1 if h >= 2**31 else -1
        return out / np.linalg.norm(out)

    nodes = as_nodes(spark.createDataFrame([("a", "Document", "getUserName x_1", "read file")], "uid string, label string, title string, content string"))
    found = embed.embed(nodes, dim=64).first()["embedding"]
    assert np.allclose(found, plain(["get", "user", "name", "x", "1", "read", "file"], 64), atol=1e-6)
