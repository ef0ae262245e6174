"""Vectors of texts: a hashed default without any model, or an ONNX encoder that each worker loads once."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import VECTOR_LABELS
from . import traverse

DIM = 1024
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_WORD = re.compile(r"[A-Za-z]+|\d+|[^\W\d_]+")
#: What both find in ASCII, in one pass.
_PLAIN = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+")


def hashed(text: str, dim: int = DIM) -> list[float]:
    """A unit vector of hashed words and their trigrams, camel and snake case split; zero-length texts give zeros.

    It stands in for a trained encoder: equal words make near vectors, meaning does not.
    """
    return hashed_many([text], dim)[0].tolist()


def hashed_many(texts: list[str], dim: int = DIM) -> np.ndarray:
    """`hashed` of some texts, a row each; grams of a whole block of texts are summed at once."""
    out = np.empty((len(texts), dim), np.float32)
    start, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if i + 1 == len(texts) or chars > _CHARS or (i + 1 - start) * dim >= _CELLS:
            out[start : i + 1] = _block(texts[start : i + 1], dim)
            start, chars = i + 1, 0
    return out


def _block(texts: list[str], dim: int) -> np.ndarray:
    known: dict[str, int] = {}
    words: list[int] = []
    many: list[int] = []
    each = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = Counter(_PLAIN.findall(text or "") if (text or "").isascii() else _WORD.findall(_CAMEL.sub(r"\1 \2", text)))
        words += [known.setdefault(w, len(known)) for w in own]
        many += own.values()
        each[i] = len(own)
    out = np.zeros((len(texts), dim))
    if words:
        hashes, sizes = _grams(list(known))
        begin, word = np.cumsum(sizes) - sizes, np.array(words)
        n = sizes[word]
        own = hashes[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row = np.repeat(np.repeat(np.arange(len(texts)), each), n)
        # sums of whole numbers, so their order changes nothing
        sums = np.bincount(row * dim + own % dim, np.where(own >> 31, 1.0, -1.0) * np.repeat(many, n), minlength=out.size)
        out = sums.reshape(out.shape)
    size = np.sqrt((out * out).sum(axis=1))
    return out / np.where(size, size, 1)[:, None]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words and their trigrams, word by word, and how many there are of each word."""
    marked = [f"<{w.lower()}>" for w in words]
    plain = np.array([w.isascii() for w in marked])
    sizes = np.array([len(w) - 1 for w in marked])
    begin = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.int64)
    out[begin] = [zlib.crc32(w.encode()) for w in marked]
    at = np.repeat(begin + 1 - (np.cumsum(sizes - 1) - (sizes - 1)), sizes - 1) + np.arange((sizes - 1).sum())
    if plain.all():
        text = np.frombuffer("".join(marked).encode(), np.uint8)
        first = at - 1 + np.repeat(np.arange(len(words)), sizes - 1)  # a word has one letter more than hashes
        out[at] = _CRC[0][text[first]] ^ _CRC[1][text[first + 1]] ^ _CRC[2][text[first + 2]]
    else:
        out[at] = [zlib.crc32(w[i : i + 3].encode()) for w in marked for i in range(len(w) - 2)]
    return out, sizes


#: Characters and components of the vectors, about, that are hashed at once.
_CHARS, _CELLS = 1 << 18, 1 << 20
#: By place and byte: the sums modulo 2 of their entries are the hashes of three bytes, as a checksum's bits are linear but for a constant.
_ZERO = zlib.crc32(bytes(3))
_CRC = [np.array([zlib.crc32(bytes(b if i == place else 0 for i in range(3))) ^ (0 if place == 0 else _ZERO) for b in range(256)], np.int64) for place in range(3)]


class OnnxEncoder:
    """Masked mean of an ONNX model's token vectors, scaled to length 1. Needs onnxruntime, tokenizers and local files.

    Models take so many tokens at most; what lies behind the first `most` of a text is not encoded.
    Texts are put in order of their tokens and cut into runs of at most `budget` tokens, padding
    included, or of one text; so little is padded, and one long text makes no large batch of others.
    """

    #: Sessions and tokenizers of this process by their files, so that a worker loads them once for all its tasks.
    loaded: ClassVar[dict] = {}

    def __init__(self, model: str, tokenizer: str, most: int = 8192, budget: int = 16384):
        self.model, self.tokenizer, self.most, self.budget = model, tokenizer, most, budget

    def encode(self, texts: list[str]) -> list[list[float]]:
        key = self.model, self.tokenizer, self.most
        if key not in OnnxEncoder.loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(self.tokenizer)
            own.no_padding()
            own.enable_truncation(self.most)
            OnnxEncoder.loaded[key] = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), own
        session, own = OnnxEncoder.loaded[key]
        rows = [r.ids for r in own.encode_batch([t or "" for t in texts])]
        out: list = [None] * len(texts)
        for run in runs([len(r) for r in rows], self.budget):
            ids = np.zeros((len(run), max(1, len(rows[run[-1]]))), np.int64)
            mask = np.zeros_like(ids)
            for k, i in enumerate(run):
                ids[k, : len(rows[i])], mask[k, : len(rows[i])] = rows[i], 1
            feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            hidden = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
            mean = (hidden * mask[..., None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
            vectors = (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            for i, v in zip(run, vectors.tolist(), strict=True):
                out[i] = v
        return out


def runs(lengths: list[int], budget: int) -> list[list[int]]:
    """Indices in ascending order of length, in runs whose size times longest is at most `budget`, or of one."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def embedding_text() -> Column:
    """What of a node is embedded: code by its labelled lines, a section by its title and content; null where nothing is."""
    code = X.code_text("name", "signature", "docstring", "code_snippet")
    document = F.when(F.coalesce("content", F.lit("")) != "", F.concat_ws("\n", F.coalesce("title", "name"), "content"))
    return F.when(F.col("label").isin("Function", "Class"), code).when(F.col("label") == "Document", document)


def embed(nodes: DataFrame, encoder: OnnxEncoder | None = None, batch: int = 1024, dim: int = DIM) -> DataFrame:
    """`nodes` with vectors for functions, classes and document sections that have content; other rows keep theirs. An encoder gets `batch` texts at a time.

    Nodes are dealt out by uid first, as few splits may hold them all.
    """

    @F.arrow_udf("array<float>")
    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = part.to_pylist()
            there = [i for i, t in enumerate(texts) if t is not None]
            if encoder is None:
                sizes = np.zeros(len(texts) + 1, np.int32)
                sizes[1:][there] = dim
                values = hashed_many([texts[i] for i in there], dim)
                yield pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values.ravel()), mask=part.is_null())
            else:
                out: list = [None] * len(texts)
                for at in range(0, len(there), batch):
                    some = there[at : at + batch]
                    for i, v in zip(some, encoder.encode([texts[i] for i in some]), strict=True):
                        out[i] = v
                yield pa.array(out, pa.list_(pa.float32()))

    # else a condition on vectors goes below the exchange, and each text is encoded once more for it
    vectors = vectors.asNondeterministic()
    text = F.when(F.col("label").isin(*VECTOR_LABELS), embedding_text())
    return traverse.spread(nodes, "uid").withColumn("_text", text).withColumn("embedding", F.coalesce(vectors("_text"), "embedding")).drop("_text")
