"""Best-fit packing in bulk-synchronous rounds: sorted documents and gaps, matched by successor sweeps."""

from __future__ import annotations

import array
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import Stage, arrow_map, text_blocks

#: Rows of documents and gaps, about, that one task of a round sweeps over, and documents that one task finishes at the end.
SWEEP_ROWS, LAST = 1 << 16, 4096
PIECES = "pid long, doc_id long, piece int, start long, length int, ids_crc32 long"
SWEPT = "part int, kind int, id long, size int, rank int, sequence_id long, offset int"

#: How the vocabulary file says that it cuts a text into words.
STEPS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Ends each word of a text that is handed to the byte-pair encoder.
MARK = "\x01"
_FIND = regex.compile(WORDS.replace(r"\s", r"\t-\r \x85\xa0"))
#: Characters whose normal form, lower case and kind need nothing but themselves.
_PLAIN = regex.compile(r"[\x00\x02-ɏ‐-‧€]*")
_KIND = np.array([0 if c in "\t\n\x0b\x0c\r \x85\xa0" else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(256))], np.uint8)


def marked(text: str) -> str:
    """The lower-cased words of a plain text, each with MARK behind it; one pass over its bytes where they suffice."""
    low = text.lower()
    coded = low.encode("latin-1", "replace")
    if "'" in low or not low.isascii() and coded.decode("latin-1") != low:
        return "".join(w + MARK for w in _FIND.findall(low))
    data = np.frombuffer(coded, np.uint8)
    kind = _KIND[data]
    live, last = kind > 0, np.ones(len(data), bool)
    last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    width = live.astype(np.int8) + (live & last)
    out = np.full(int(width.sum(dtype=np.int64)), ord(MARK), np.uint8)
    out[(np.cumsum(width, dtype=np.int64) - width)[live]] = data[live]
    return out.tobytes().decode("latin-1")


class WordTokens:
    """The ids that the `tokenizers` library gives for a BPE with word ends, without special tokens added.

    A word's end is one more byte for the byte-pair encoder, which ranks it first with the byte
    before it. Texts that hold an added token, or a character whose normal form, kind or lower
    case is not its own matter, go to the `tokenizers` library, as do all texts where the file
    says anything else than is known here.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.load, self.held, self.fast = lambda: Tokenizer.from_file(path), None, None
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        self.added = [x["content"] for x in file["added_tokens"]]
        model, steps = file["model"], (file["normalizer"] or {}).get("normalizers", [])
        cut = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = [x["type"] for x in steps] == STEPS and cut[0].get("pattern") == {"Regex": WORDS} and model.get("end_of_word_suffix") == "</w>"
        if known and not model.get("ignore_merges"):
            names = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
            bytes_of = {c: b for b, c in names.items()} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in names)}
            ranks = {}
            for piece, i in model["vocab"].items():
                ends = len(piece) > 4 and piece.endswith("</w>")
                if piece not in self.added:
                    ranks[bytes(bytes_of[c] for c in (piece[:-4] if ends else piece)) + MARK.encode() * ends] = i
            self.fast = tiktoken.Encoding("bestfit", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: bytes) -> list[int]:
        own = text.decode("utf-8", "replace")
        if self.fast is None or not _PLAIN.fullmatch(own) or any(x in own for x in self.added):
            self.held = self.held or self.load()
            return self.held.encode(own, add_special_tokens=False).ids
        return self.fast.encode_ordinary(marked(own))


_TOKENS: dict[str | None, WordTokens] = {}


def word_tokens(path: str | None = None) -> WordTokens:
    """One of each file per worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pieces(docs: DataFrame, room: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """(pid, doc_id, piece, start, length, ids_crc32): each document's ids and `end_id`, cut after every `room` ids."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, own = TaskContext.get().partitionId() << 36, word_tokens(tokenizer)
        for batch in batches:
            ids_of = batch.column(0).cast(pa.int64())
            for first, _, block in text_blocks(batch.column(1)):
                rows: list[tuple[int, ...]] = []
                for k, text in enumerate(block):
                    ids = array.array("I", own.ids(text) if text else ())
                    ids.append(end_id)
                    for n, at in enumerate(range(0, len(ids), room)):
                        held = ids[at : at + room]
                        rows.append((pid, first + k, n, at, len(held), zlib.crc32(held.tobytes())))
                        pid += 1
                c = [np.array(x) for x in zip(*rows, strict=True)]
                columns = [pa.array(c[0], pa.int64()), ids_of.take(pa.array(c[1])), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs.select("doc_id", "text"), work, PIECES)


def best_fit(docs: np.ndarray, gaps: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, larger documents first: each one's gap (-1: none), that gap's size then, sizes of all gaps after, and which were met.

    The successor of a size is the lowest bit at or above it of a set of the sizes that gaps have;
    a gap that took a document comes back with what is left of it.
    """
    by: list[list[int]] = [[] for _ in range(room + 1)]
    there = 0
    for k, size in enumerate(gaps.tolist()):
        by[size].append(k)
        there |= 1 << size
    took, at, left, met = np.full(len(docs), -1), np.zeros(len(docs), np.int64), gaps.astype(np.int64), np.zeros(len(gaps), bool)
    for i in np.argsort(-docs, kind="stable").tolist():
        length = int(docs[i])
        above = there >> length
        if not above:
            continue
        size = length + (above & -above).bit_length() - 1
        k = by[size].pop()
        if not by[size]:
            there &= ~(1 << size)
        took[i], at[i], left[k], met[k] = k, size, size - length, True
        if size > length:
            by[size - length].append(k)
            there |= 1 << (size - length)
    return took, at, left, met


def sweep(rows: DataFrame, parts: int, room: int) -> DataFrame:
    """Documents (kind 0) and gaps (kind 1) in ranges of size, matched within each range by best fit.

    What a range leaves over has a rank: documents from the largest, gaps from the smallest; no
    document that it leaves fits into a gap that it leaves.
    """
    names = [f.split()[0] for f in SWEPT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"size": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "id": pa.array([], pa.int64())})])
        size, kind, own = (held.column(c).to_numpy() for c in ("size", "kind", "id"))
        part = TaskContext.get().partitionId()
        docs, gaps = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        took, at, left, met = best_fit(size[docs], size[gaps], room)
        for n, count, new, over in ((0, len(docs), size[docs], took < 0), (1, len(gaps), left, ~met)):
            rank = np.zeros(count, np.int32)
            rank[over] = np.arange(over.sum())[:: 1 if n else -1]  # rows come in ascending size
            ids = own[docs if n == 0 else gaps]
            sequence = np.where(over, 0, own[gaps][took] if n == 0 and len(gaps) else 0)
            offset = room - at if n == 0 else np.zeros(count, np.int64)
            columns = [pa.array(np.full(count, part), pa.int32()), pa.array(np.full(count, n), pa.int32()), pa.array(ids, pa.int64()), pa.array(new, pa.int32())]
            columns += [pa.array(rank, pa.int32(), mask=~over), pa.array(sequence, pa.int64(), mask=over), pa.array(offset, pa.int32(), mask=over)]
            yield pa.RecordBatch.from_arrays(columns, names)

    keys = ["size", "kind", "id"]
    return arrow_map(rows.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys), work, SWEPT)


def across(runs: list[Row]) -> list[tuple[int, int, int, int, int, int]]:
    """How gaps left in one range take documents left in lower ones: (part, first, end, gap part, first gap, gaps).

    `runs` has part, docs, largest, gaps and smallest of each range, in their order; so a few
    numbers for each range decide, however many rows it holds. A gap takes the largest documents
    below it that no smaller gap took: the last run is used first. Where all gaps of a run hold
    several of the largest documents of another, each takes so many; they are dealt in turn.
    """
    out, stack = [], []
    for run in runs:
        at = 0
        while at < run["gaps"] and stack:
            part, first, end, largest = stack[-1]
            each = max(1, run["smallest"] // largest)
            take = min(end - first, each * (run["gaps"] - at))
            used = min(run["gaps"] - at, take)
            out.append((part, first, first + take, run["part"], at, used))
            at += used
            stack.pop()
            if first + take < end:
                stack.append((part, first + take, end, largest))
        if run["docs"]:
            stack.append((run["part"], 0, run["docs"], run["largest"]))
    return out


def pack(docs: DataFrame, room: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of all documents.

    A document's ids are its whole text's (null: none) and `end_id`. Runs of `room` ids are
    sequences of their own; what is left of each document stays whole. For these, as many
    sequences are opened as their ids need at least. In each round documents and gaps are sorted
    into ranges of their size together; a sweep gives each range's documents, the largest first,
    to the smallest gaps that hold them; then gaps left over take documents left over in lower
    ranges, by rank. Gaps shrink by what they took, and the round is repeated. If none fits any
    more, as many sequences as the rest needs at least are opened again. The last documents, 4,096
    at most, are given in one task to at most as many of the largest gaps, or to new sequences.

    Sizes and ids are sorted together, so a size that very many documents have is spread over
    tasks. Every step is a written table. Repeated rows are packed as often as they occur; a null
    doc_id stays null; columns other than doc_id and text are not read, whatever their names; an
    empty table gives no rows. Numbers of sequences are below 0 for whole runs, else from 0.
    """
    stage = Stage(docs.sparkSession, "bestfit")
    spark = docs.sparkSession
    all_pieces = stage.keep(pieces(docs, room, end_id, tokenizer))
    pending = all_pieces.where(F.col("length") < room).select(F.col("pid").alias("id"), F.col("length").alias("size"))
    gaps = spark.createDataFrame([], "id long, size int")
    placed = spark.createDataFrame([], "id long, sequence_id long, offset int")
    n, tokens, smallest = _counts(pending)
    opened, stuck = 0, True
    while n > LAST:
        if stuck:
            more = -(-tokens // room)
            gaps = gaps.unionByName(spark.range(opened, opened + more).select("id", F.lit(room).alias("size")))
            opened += more
        rows = pending.withColumn("kind", F.lit(0)).unionByName(gaps.where(F.col("size") >= smallest).withColumn("kind", F.lit(1)))
        swept = stage.keep(sweep(rows, -(-(n + opened) // SWEEP_ROWS), room))
        left = swept.where("rank is not null")
        doc, gap = F.col("kind") == 0, F.col("kind") == 1
        runs = left.groupBy("part").agg(
            F.count_if(doc).alias("docs"), F.max(F.when(doc, F.col("size"))).alias("largest"), F.count_if(gap).alias("gaps"), F.min(F.when(gap, F.col("size"))).alias("smallest"),
        )
        segments = spark.createDataFrame(across(runs.orderBy("part").collect()), "part int, first int, end int, gap_part int, gap_first int, gaps int")
        asked = left.where(doc).select("part", "id", "size", "rank")
        dealt = asked.join(segments, "part").where("rank >= first and rank < end")
        dealt = dealt.select("id", "size", "gap_part", (F.col("gap_first") + (F.col("rank") - F.col("first")) % F.col("gaps")).alias("gap_rank"), "rank")
        open_gaps = left.where(gap).select(F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("id").alias("sequence_id"), F.col("size").alias("free"))
        before = F.sum("size").over(Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        crossed = dealt.join(open_gaps, ["gap_part", "gap_rank"]).select("id", "size", "sequence_id", (room - F.col("free") + F.coalesce(before, F.lit(0))).cast("int").alias("offset"))
        crossed = stage.keep(crossed)
        took = crossed.groupBy("sequence_id").agg(F.sum("size").cast("int").alias("took")).withColumnRenamed("sequence_id", "id")
        gaps = swept.where(gap).select("id", "size").join(took, "id", "left").select("id", (F.col("size") - F.coalesce("took", F.lit(0))).alias("size"))
        pending = stage.keep(asked.join(crossed.select("id"), "id", "left_anti").select("id", "size"))
        own = swept.where(doc & F.col("sequence_id").isNotNull())
        placed = placed.unionByName(own.select("id", "sequence_id", "offset")).unionByName(crossed.select("id", "sequence_id", "offset"))
        before_n = n
        n, tokens, smallest = _counts(pending)
        stuck = n == before_n
    if n:
        rows = pending.withColumn("kind", F.lit(0)).unionByName(gaps.where(F.col("size") >= smallest).orderBy(F.desc("size"), "id").limit(LAST).withColumn("kind", F.lit(1)))
        placed = placed.unionByName(stage.keep(_last(rows, opened, room)))
    whole = all_pieces.where(F.col("length") == room).withColumn("sequence_id", -1 - F.col("pid")).withColumn("offset", F.lit(0))
    parts = all_pieces.where(F.col("length") < room).join(placed.withColumnRenamed("id", "pid"), "pid")
    return whole.unionByName(parts).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def _counts(pending: DataFrame) -> tuple[int, int, int]:
    row = pending.agg(F.count(F.lit(1)), F.sum("size"), F.min("size")).first()
    return row[0], row[1] or 0, row[2] or 0


def _last(rows: DataFrame, opened: int, room: int) -> DataFrame:
    """Place all of a few documents, in sequences from `opened` on where no gap holds them."""

    def work(held: pa.Table) -> pa.Table:
        size, kind, own = (held.column(c).to_numpy() for c in ("size", "kind", "id"))
        docs, gaps = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        docs, gaps = docs[np.lexsort((own[docs], size[docs]))], gaps[np.lexsort((own[gaps], size[gaps]))]
        sizes, names = size[gaps].astype(np.int64), own[gaps]
        sequence, offset = np.full(len(docs), -1), np.zeros(len(docs), np.int64)
        todo, new = np.arange(len(docs)), opened
        while len(todo):
            took, at, sizes, _ = best_fit(size[docs][todo], sizes, room)
            fit = took >= 0
            sequence[todo[fit]], offset[todo[fit]] = names[took[fit]], room - at[fit]
            todo = todo[~fit]
            more = -(-int(size[docs][todo].sum()) // room)
            sizes, names = np.concatenate([sizes, np.full(more, room)]), np.concatenate([names, np.arange(new, new + more)])
            new += more
        return pa.table({"id": pa.array(own[docs], pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int32())})

    return rows.groupBy(F.lit(0).alias("g")).applyInArrow(work, "id long, sequence_id long, offset int")
