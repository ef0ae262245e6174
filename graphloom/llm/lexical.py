"""Ranked lexical search: postings in windows of doc_ids, scores scattered into small arrays, best ones kept in heaps."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, arrow_map, text_blocks

#: Documents of a window (their scores take 64 KiB), documents of a bit of its occupancy, and distinct terms of a block of items, about.
WINDOW, LINE, TERMS = 8192, 64, 1 << 18
#: Bytes of postings after which a window ends early.
WIDE = 1 << 25
#: Bytes of a text to bytes of its terms: ASCII letters in lower case, digits and all bytes beyond ASCII stay, the rest is space.
_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
POSTINGS = "doc_id long, n long, terms binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def item_blocks(stage: Stage, items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, terms, times, block): the distinct terms of each item and how often it holds them; and the number of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, block in text_blocks(batch.column(1)):
                held = [Counter(terms_of(x)) for x in block]
                terms, times = pa.array([list(x) for x in held], pa.list_(pa.binary())), pa.array([list(x.values()) for x in held], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at).cast(pa.int64()), terms, times], ["item_id", "terms", "times"])

    held = stage.keep(arrow_map(items.select("item_id", "text"), work, "item_id long, terms array<binary>, times array<long>").where(F.size("terms") > 0).withColumn("key", F.monotonically_increasing_id()))
    blocks = -(-(held.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    return held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, blocks)))), blocks


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """POSTINGS of each document with terms: how many it has, and ids (int32) and counts (int32) of those in the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, block in text_blocks(batch.column(1)):
                rows, n, terms, tfs = [], [], [], []
                for k, text in enumerate(block):
                    words = terms_of(text)
                    if words:
                        met = Counter(map(vocabulary.get, words))
                        met.pop(None, None)
                        rows.append(at + k)
                        n.append(len(words))
                        terms.append(np.fromiter(met, np.int32, len(met)).tobytes())
                        tfs.append(np.fromiter(met.values(), np.int32, len(met)).tobytes())
                ids = batch.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    return arrow_map(docs.select("doc_id", "text"), work, POSTINGS)


def statistics(held: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and documents that hold each of the `size` terms of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, docs, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            docs, total = docs + batch.num_rows, total + int(batch.column(0).to_numpy().sum())
            found += np.bincount(_joined(batch.column(1))[0], minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at], pa.int32()), pa.array(np.r_[docs, total, found[at]], pa.int64())], ["term", "n"])

    sums = arrow_map(held.select("n", "terms"), work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # at most size + 2 rows
    held_by = dict(zip(sums["term"].tolist(), sums["n"].tolist(), strict=True))
    df = np.zeros(size, np.int64)
    for term, n in held_by.items():
        if term >= 0:
            df[term] = n
    return held_by.get(-2, 0), held_by.get(-1, 0), df


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 values of all cells of a binary column, and how many each holds."""
    ends = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int32) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.int32)
    return flat, np.diff(ends) // 4


def score_windows(batches: Iterator[pa.RecordBatch], items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int) -> list[list[tuple[int, int, int]]]:
    """A heap of (score, has an id, -doc_id) for each item, of the k best documents of a run of postings.

    The documents are taken in windows of 8,192 successive ones. A window's postings are sorted by
    term; each item adds those of its terms, as often as it holds them, to the scores of the
    window's slots and marks the lines of 64 slots that it touched. Only these are read for the
    heap, and set back to 0.
    """
    heaps: list[list[tuple[int, int, int]]] = [[] for _ in items]
    scores, touched = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // LINE, bool)
    lines = scores.reshape(-1, LINE)

    def window(ids: np.ndarray, there: np.ndarray, n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, each: np.ndarray) -> None:
        if int(n.max()) * 25 * docs < 2**63:
            spread = 75 + (25 * n * docs) // total
        else:
            spread = np.array([75 + 25 * x * docs // total for x in n.tolist()], np.int64)
        order = np.argsort(terms, kind="stable")
        slots = np.repeat(np.arange(len(n)), each)[order]
        terms, tf = terms[order], tfs[order].astype(np.int64)
        gain = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * spread[slots]))
        line = slots // LINE
        starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        for heap, (own, times) in zip(heaps, items, strict=True):
            for lo, hi, repeat in zip(starts[own].tolist(), starts[own + 1].tolist(), times.tolist(), strict=True):
                if lo < hi:  # a document holds a term once, so no slot comes twice
                    scores[slots[lo:hi]] += gain[lo:hi] * repeat if repeat > 1 else gain[lo:hi]
                    touched[line[lo:hi]] = True
            at = np.flatnonzero(touched)
            if not len(at):
                continue
            least = heap[0][0] if len(heap) == k else 1
            row, column = np.nonzero(lines[at] >= max(least, 1))
            found = at[row] * LINE + column
            if len(found):
                best = found[np.lexsort((ids[found], ~there[found], -scores[found]))[:k]]
                for s, t, d in zip(scores[best].tolist(), there[best].tolist(), ids[best].tolist(), strict=True):
                    entry = (s, int(t), -d)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
            lines[at] = 0
            touched[at] = False

    def windows() -> Iterator[pa.Table]:
        parts, rows, wide = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, WINDOW - rows)
                parts, rows, wide = [*parts, part], rows + part.num_rows, wide + part.nbytes
                batch = batch.slice(part.num_rows)
                if rows == WINDOW or wide > WIDE:
                    yield pa.Table.from_batches(parts)
                    parts, rows, wide = [], 0, 0
        if parts:
            yield pa.Table.from_batches(parts)

    for held in windows():
        ids = held.column("doc_id").combine_chunks()
        terms, each = _joined(held.column("terms").combine_chunks())
        window(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held.column("n").to_numpy(), terms, _joined(held.column("tfs").combine_chunks())[0], each)
    return heaps


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0.

    Terms, weights and scores are as the query's contract has them: a term's weight falls with the
    documents that hold it, its gain grows with its count and falls with the document's length;
    statistics cover all documents. Equal scores go by ascending doc_id, null ones last.

    Documents and items without text or terms give nothing. Rows that repeat a doc_id are
    documents of their own; of items that repeat an item_id, each is ranked, so ranks come
    again. Other columns are not read; empty tables give no rows.

    Items are taken in blocks of about 262,144 terms, one after the other, so what a task holds of
    them is bounded. For each, documents are turned into postings of the block's terms, which are
    sorted by doc_id and written; each task then walks its range of doc_ids in windows, keeps a
    heap for each item, and a window function keeps the best of these.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "lexical")
    held_items, blocks = item_blocks(stage, items)
    out = None
    for block in range(blocks):
        rows = held_items.where(F.col("block") == block).select("key", "item_id", "terms", "times").collect()  # about TERMS terms, and one item at least
        vocabulary: dict[bytes, int] = {}
        own = [(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]]), np.array(r["times"])) for r in rows]
        posted = stage.keep(postings(docs, vocabulary))
        sorted_ = stage.keep(posted.repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
        n, total, df = statistics(sorted_, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

        def work(batches, own=own, weights=weights, n=n, total=total):
            heaps = score_windows(batches, own, weights, n, total, k)
            each = [(i, s, -d if t else None) for i, heap in enumerate(heaps) for s, t, d in heap]
            cols = list(zip(*each, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["item", "score", "doc_id"])

        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = arrow_map(sorted_, work, "item int, score long, doc_id long").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        found = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = found if blocks == 1 else stage.keep(found)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
