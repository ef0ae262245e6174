"""Packing of tokenised documents into training sequences, balanced by attention cost."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, text_blocks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int"


class Tokens:
    """The ids that the `tokenizers` library gives for a byte-level BPE's .json file, without special tokens added.

    Added tokens that stand in a text, such as `<|endoftext|>`, are found and get their own id, as
    that library does it. Texts that hold none take a faster road over the same vocabulary, which
    the file gives as ranks by its order of ids.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("byte_bpe_50k.json")
        self.load, self.held = lambda: Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as lines:
            held = json.load(lines)
        self.added = [x["content"].encode() for x in held["added_tokens"]]
        self.fast = None
        simple = held["pre_tokenizer"]["type"] == "ByteLevel" and held["pre_tokenizer"].get("use_regex", True) and not held["pre_tokenizer"]["add_prefix_space"]
        if held["normalizer"] is None and simple and not held["model"].get("ignore_merges"):
            names = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
            bytes_of = {c: b for b, c in names.items()} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in names)}
            ranks = {bytes(bytes_of[c] for c in piece): i for piece, i in held["model"]["vocab"].items() if piece.encode() not in self.added}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: bytes) -> list[int]:
        own = text.decode("utf-8", "replace")
        if self.fast is None or any(x in text for x in self.added):
            self.held = self.held or self.load()
            return self.held.encode(own, add_special_tokens=False).ids
        return self.fast.encode_ordinary(own)


_TOKENS: dict[str | None, Tokens] = {}


def tokens(path: str | None = None) -> Tokens:
    """One of each file per worker."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cost(length: int, linear: float = 1.0, quadratic: float = 1 / 512) -> float:
    """Estimated cost of a piece: feed-forward work grows with its length, attention with the square."""
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, room: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (piece, begin in it, length, sequence, offset there).

    Pieces in descending length go to the sequence of least cost that has room for them; only
    where none has, the piece is cut at what the sequence of least cost can hold. There are just
    enough sequences for all tokens, so that together they lack less than one `room`. Sequences
    lie in a heap for each number of free tokens; a tree over these has the least of each range.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(room + 1)]
    heaps[room] = [(0.0, k) for k in range(-(-int(lengths.sum()) // room))]
    size = 1 << room.bit_length()
    tree = [(float("inf"), -1, 0)] * (2 * size)  # (cost, sequence, free)

    def renew(free: int) -> None:
        at = size + free
        tree[at] = (*heaps[free][0], free) if heaps[free] else (float("inf"), -1, 0)
        while at > 1:
            at //= 2
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def least(free: int) -> tuple[float, int, int]:
        at = size + free
        best = tree[at]
        while at > 1:
            if at % 2 == 0:
                best = min(best, tree[at + 1])
            at //= 2
        return best

    renew(room)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        begin, left = 0, int(lengths[piece])
        while left:
            spent, sequence, free = least(left) if left <= room else tree[1]
            if sequence < 0:
                spent, sequence, free = tree[1]
            heapq.heappop(heaps[free])
            renew(free)
            put = min(left, free)
            yield piece, begin, put, sequence, room - free
            begin, left, free = begin + put, left - put, free - put
            if free:
                heapq.heappush(heaps[free], (spent + cost(put), sequence))
                renew(free)


def pack(docs: DataFrame, room: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, part) of all documents.

    A document's ids are its whole text's (null: none) and `end_id`; its full runs of `room` ids
    are sequences of their own, and what is left of the documents of one Arrow batch is packed by
    `assign`. Nothing is shuffled: a batch wastes less than one sequence. Sequence ids hold the
    partition in the upper bits, so a task that runs again gives the same rows. Of a document that
    was read only what is left over, less than `room` ids, is kept. Repeated rows are packed as
    often as they occur; a null doc_id stays null; columns other than doc_id and text are not
    read, whatever their names; an empty table gives no rows.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base, own = part << 36, tokens(tokenizer)

        def out(ids_of: pa.Array, rows: list[tuple[int, ...]]) -> pa.RecordBatch:
            columns = [np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 7
            return pa.RecordBatch.from_arrays([ids_of.take(pa.array(columns[0])), *(pa.array(x) for x in columns[1:]), pa.array(np.full(len(rows), part, np.int32))], names)

        for batch in batches:
            ids_of, tails = batch.column(0).cast(pa.int64()), []
            for first, _, block in text_blocks(batch.column(1)):
                rows = []
                for k, text in enumerate(block):
                    ids = np.array([*(own.ids(text) if text else []), end_id], "<u4")
                    full = len(ids) // room
                    for x in range(full):
                        rows.append((first + k, x * room, room, zlib.crc32(ids[x * room : (x + 1) * room].tobytes()), len(ids), base, 0))
                        base += 1
                    if len(ids) % room:
                        tails.append((first + k, full * room, ids[full * room :].astype(np.uint16 if ids.max() < 1 << 16 else np.uint32), len(ids)))
                if rows:
                    yield out(ids_of, rows)
            lengths, rows = np.array([len(t[2]) for t in tails], np.int64), []
            for piece, begin, length, sequence, offset in assign(lengths, room):
                row, start, ids, total = tails[piece]
                rows.append((row, start + begin, length, zlib.crc32(ids[begin : begin + length].astype("<u4").tobytes()), total, base + sequence, offset))
            base += -(-int(lengths.sum()) // room)
            yield out(ids_of, rows)

    return arrow_map(docs.select("doc_id", "text"), work, SCHEMA)
