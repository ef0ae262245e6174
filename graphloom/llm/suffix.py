"""Removal of byte strings that occur earlier: sampled suffixes are sorted, named and compared with their neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, arrow_map, few, mix, text_blocks

#: Bytes of the gram that decides which positions are sampled.
GRAM = 24


def _runs_min(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """Minimum (or maximum) of each window of w values, by minima from both ends of blocks."""
    n = len(x) - w + 1
    pad = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    left = pick.accumulate(pad, axis=1).ravel()
    right = pick.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(right[:n], left[w - 1 : w - 1 + n])


def samples(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of a text and the hashes of the GRAM bytes there.

    A position is sampled if its gram's hash is least in one of the windows of length - GRAM + 1
    positions that hold it. So every string of `length` bytes holds a sampled position, at one
    place wherever the string stands: what a difference cover gives by position, from the content.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = [np.ascontiguousarray(np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))).view(np.uint64).ravel()]
    n, w = len(data) - GRAM + 1, length - GRAM + 1
    h = words[0][:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for k in range(8, GRAM, 8):
        h += words[0][k : k + n]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    low = _runs_min(h, w, np.minimum, 2**64 - 1)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_runs_min(np.concatenate([pad, low, pad]), w, np.maximum, 0) == h)
    return at, h[at]


def contexts(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sampled position the bytes that strings holding its gram can hold, and how many lie before it and from it on."""
    before, after = length - GRAM, length
    pad = np.concatenate([np.zeros(before, np.uint8), data, np.zeros(after + 8, np.uint8)])
    near = np.lib.stride_tricks.sliding_window_view(pad, before + after)[at]
    return near, np.minimum(at, before), np.minimum(len(data) - at, after)


def context_hashes(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wide = np.ascontiguousarray(near).view(np.uint64)
    out = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    for k in range(wide.shape[1]):
        out = (out + wide[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def _first(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in an order that has equal keys together: whether each is the first of its keys, and the place in the order of that first one."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    return new, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _sampled(docs: DataFrame, length: int, often: int = 8) -> DataFrame:
    """(r, h, c, doc, at) of the sampled positions: where the row goes, hashes of its gram and its context, and place.

    `at` is 256 * position + 128 if the gram is common here + the bytes from the position on, of
    which there are GRAM at least. Each block of texts sends one row for each context: the other
    rows that hold it are later, and go on as spans, (doc, c to at >> 8), marked by a 1 there. A
    gram of `often` contexts in the block goes by gram and context, so that no task gets all of a
    gram that is common everywhere; a row marked by a 0 tells those that go by the gram alone.
    """
    before = length - GRAM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, block in text_blocks(batch.column(1), 4 << 20):
                out: list[tuple[np.ndarray, ...]] = []
                for k, text in enumerate(block):
                    data = np.frombuffer(text, np.uint8)
                    at, h = samples(data, length)
                    if len(at):
                        near, left, right = contexts(data, at, length)
                        out.append((h.view(np.int64), context_hashes(near, left, right).view(np.int64), np.full(len(at), ids[first + k]), at * 256 + right))
                if not out:
                    continue
                h, c, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.lexsort((at, doc, c, h))
                new, lead = _first(order, h, c)
                h, c, doc, at = h[order], c[order], doc[order], at[order]
                again = np.flatnonzero(~new & ((doc != doc[lead]) | (at != at[lead])))  # not a row that stands twice
                start = at[again] >> 8
                begin, end = start - np.minimum(start, before), start + (at[again] & 127)
                spans = end - begin >= length
                again, begin, end = again[spans], begin[spans], end[spans]
                h1, c1, d1, a1 = h[new], c[new], doc[new], at[new]
                gram = np.flatnonzero(np.concatenate(([True], h1[1:] != h1[:-1])))
                many = np.diff(np.append(gram, len(h1)))
                common = np.repeat(many >= often, many)
                apart = mix((mix(h1.view(np.uint64).copy()) ^ c1.view(np.uint64))).view(np.int64)
                told = h1[gram[many >= often]]
                zero, one = np.zeros(len(told), np.int64), np.ones(len(again), np.int64)
                columns = [
                    (np.where(common, apart, h1), told, mix(doc[again].astype(np.uint64)).view(np.int64)), (h1, told, one), (c1, zero, begin),
                    (d1, zero, doc[again]), (a1 + 128 * common, zero, end * 256 + 1),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["r", "h", "c", "doc", "at"])

    return arrow_map(docs.select("doc_id", "text"), work, "r long, h long, c long, doc long, at long")


def _named(sampled: DataFrame, length: int) -> DataFrame:
    """(doc, start, end) where a whole context occurs earlier, and (doc, h, at) of first contexts whose gram has others, or is told to.

    A task reads its rows, sorted by gram and context, as a stream and keeps one row of the one before.
    """
    before = length - GRAM

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the first row of the context at hand; that of its gram, until a second context or a mark is seen
        for batch in batches:
            if not batch.num_rows:
                continue
            r, h, c, doc, at = (batch.column(k).to_numpy() for k in range(5))
            known = np.flatnonzero(at & 255 == 1)
            known_spans = doc[known], c[known], at[known] >> 8
            own = at & 255 != 1
            r, h, c, doc, at = (x[own] for x in (r, h, c, doc, at))
            mark = at & 255 == 0
            if last is None:
                last = (0, 0, 0, 0, 0, False)
            if len(h):
                pr, ph, pc = (np.concatenate(([last[k]], x[:-1])) for k, x in enumerate((r, h, c)))
                pm = np.concatenate(([last[5]], mark[:-1]))
                new_gram = (r != pr) | (h != ph)
                new_gram[0] |= last[4] == 0
                first = new_gram | (c != pc) | pm | mark
                lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), -1))
                ld, la = np.where(lead >= 0, doc[lead], last[3]), np.where(lead >= 0, at[lead], last[4])
                covered = ~first & ((doc != ld) | (at != la))
                start = at >> 8
                spans = np.flatnonzero(covered & (np.minimum(start, before) + (at & 127) >= length))
                # a first context goes on if another one of its gram, or a mark, stands before or behind it, or if its gram is common
                firsts = np.flatnonzero(first)
                second = ~new_gram[firsts]
                behind = np.concatenate((second[1:], [False]))
                reps = firsts[(second | behind | (at[firsts] & 128 > 0)) & ~mark[firsts]]
                rd, rh, ra = doc[reps], h[reps], at[reps]
                if held is not None and len(firsts) and second[0]:
                    rd, rh, ra = (np.concatenate(([x], y)) for x, y in zip(held, (rd, rh, ra), strict=True))
                if len(firsts):
                    end = firsts[-1]
                    held = (doc[end], h[end], at[end]) if new_gram[end] and not mark[end] and not at[end] & 128 else None
                    last = (r[-1], h[-1], c[-1], doc[end], at[end] or 256, mark[end] and end == len(h) - 1)
                sd, ss, se = doc[spans], start[spans] - np.minimum(start[spans], before), start[spans] + (at[spans] & 127)
            else:
                sd, ss, se, rd, rh, ra = (np.zeros(0, np.int64),) * 6
            sd, ss, se = (np.concatenate(x) for x in zip((sd, ss, se), known_spans, strict=True))
            none, n = np.zeros(len(rd), np.int64), np.zeros(len(sd), np.int64)
            columns = [np.concatenate(x) for x in ((sd, rd), (ss, none), (se, none), (n, rh), (n, ra & ~128), (n > 0, none == 0))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "start", "end", "h", "at", "more"])

    return arrow_map(sampled.repartition("r").sortWithinPartitions("r", "h", "c", "doc", "at"), work, "doc long, start long, end long, h long, at long, more boolean")


def _window_hashes(near: np.ndarray, length: int) -> np.ndarray:
    """Of each context the hashes of the strings of `length` bytes that hold its gram: one column for each number of bytes before it, descending.

    Hashes of 8 bytes are mixed to those of 16, 32 and so on; two that overlap cover `length` bytes.
    """
    size, wide = 8, near.shape[1]
    h = np.lib.stride_tricks.as_strided(near, (len(near), wide - 7, 8), (near.strides[0], 1, 1))
    h = mix(np.ascontiguousarray(h).view(np.uint64)[:, :, 0])
    while 2 * size <= length:
        h = mix(h[:, :-size] * np.uint64(0x9E3779B97F4A7C15) + h[:, size:])
        size *= 2
    n, over = wide - length + 1, length - size
    return mix(h[:, :n] * np.uint64(0x9E3779B97F4A7C15) + h[:, over : over + n])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    return row, begin, np.nonzero(edge == -1)[1] - 1


def _strings(h: np.ndarray, at: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of `length` bytes around grams, by bytes before the gram, descending, and which of them lie within the document."""
    before = length - GRAM
    value = _window_hashes(text, length)
    shift = np.arange(value.shape[1])
    start, right = at >> 8, at & 127
    fits = (before - shift <= np.minimum(start, before)[:, None]) & (length - before + shift <= right[:, None])
    return mix((value + mix(h.astype(np.uint64))[:, None]) * np.uint64(0x9E3779B97F4A7C15) + shift.astype(np.uint64)), fits


def _compared(near: DataFrame, length: int) -> DataFrame:
    """(doc, start, end) of what the strings around a gram repeat of earlier ones, for contexts (h, doc, at, near) grouped by gram.

    Sorted rows come as a stream; whole grams, a few thousand rows at a time, are compared by
    sorting the hashes of their strings, where the first of equal ones is the earliest.
    """
    before = length - GRAM

    def compare(h: np.ndarray, doc: np.ndarray, at: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        value, fits = _strings(h, at, text, length)
        start = at >> 8
        rows, columns = np.nonzero(fits)
        keys = value[rows, columns]
        order = np.argsort(keys, kind="stable")
        new, lead = _first(order, keys)
        later = np.zeros(len(order), bool)
        own, first = rows[order], rows[order[lead]]
        later[order] = ~new & ((doc[own] != doc[first]) | (start[own] != start[first]))
        mask = np.zeros(fits.shape, bool)
        mask[rows, columns] = later
        row, begin, end = _runs(mask)
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(start[row] - before + begin), pa.array(start[row] - before + end + length)], ["doc", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        width = length + before
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                text = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, width)
                new = (*(part.column(k).to_numpy() for k in range(3)), text)
                rows = tuple(np.concatenate(x) for x in zip(*kept, new, strict=True)) if kept else new
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                if cut:
                    yield compare(*(x[:cut] for x in rows))
                    kept = [tuple(x[cut:] for x in rows)]
                else:
                    kept.append(new)
        if kept:
            yield compare(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return arrow_map(near.repartition("h").sortWithinPartitions("h", "doc", "at"), work, "doc long, start long, end long")


def _compared_apart(near: DataFrame, length: int) -> DataFrame:
    """The same for grams of very many contexts, whose strings are dealt out by their hashes.

    Each batch sends the first of equal strings only, and (h, s, doc, start) of the others as
    what they are, repeats; so a string that all documents hold is a row for each batch.
    """
    before = length - GRAM

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                text = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, length + before)
                h, doc, place = (part.column(k).to_numpy() for k in range(3))
                value, fits = _strings(h, place, text, length)
                rows, columns = np.nonzero(fits)
                s, h, doc, start = value[rows, columns].view(np.int64), h[rows], doc[rows], (place[rows] >> 8) - before + columns
                order = np.lexsort((start, doc, h, s))
                new, lead = _first(order, s, h)
                s, h, doc, start = s[order], h[order], doc[order], start[order]
                again = ~new & ((doc != doc[lead]) | (start != start[lead]))
                held = new | again
                where = np.where(again, mix(doc.astype(np.uint64)).view(np.int64), s)
                yield pa.RecordBatch.from_arrays([pa.array(x[held]) for x in (where, h, doc, start, again)], ["s", "h", "doc", "start", "again"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None,) * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            again = batch.column(4).to_numpy(zero_copy_only=False)
            s, h, doc, start = (batch.column(k).to_numpy() for k in range(4))
            found = [(doc[again], start[again])]
            s, h, doc, start = (x[~again] for x in (s, h, doc, start))
            if len(s):
                new = np.concatenate(([(s[0], h[0]) != last[:2]], (s[1:] != s[:-1]) | (h[1:] != h[:-1])))
                lead = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
                ld, ls = np.where(lead >= 0, doc[lead], last[2] or 0), np.where(lead >= 0, start[lead], last[3] or 0)
                repeats = ~new & ((doc != ld) | (start != ls))
                found.append((doc[repeats], start[repeats]))
                last = (s[-1], h[-1], ld[-1], ls[-1])
            doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(start + length)], ["doc", "start", "end"])

    parts = arrow_map(near, strings, "s long, h long, doc long, start long, again boolean")
    return arrow_map(parts.repartition("s").sortWithinPartitions("again", "s", "h", "doc", "start"), later, "doc long, start long, end long")


def repeated_spans(stage: Stage, docs: DataFrame, length: int, wide: int = 20_000) -> DataFrame:
    """(doc, start, end): byte runs of (doc_id, text) that earlier strings of `length` bytes cover; they may overlap."""
    found = stage.keep(_named(_sampled(docs, length), length))
    spans, reps = found.where("not more").select("doc", "start", "end"), found.where("more").select("doc", "h", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[k].as_py().encode(), np.uint8)
                own = batch.column(2)[k].values.flatten()
                for first in range(0, len(own[0]), 16384):
                    h, at = (x.to_numpy()[first : first + 16384] for x in own)
                    near, _, _ = contexts(data, at >> 8, length)
                    text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(near.shape[1]), len(near), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), batch.column(0)[k].as_py())), pa.array(at), text], ["h", "doc", "at", "near"])

    def near(own: DataFrame) -> DataFrame:
        by_doc = stage.keep(own.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("reps")).withColumnRenamed("doc", "doc_id"))
        texts = docs.join(few(by_doc.select("doc_id")), "doc_id", "left_semi").join(by_doc, "doc_id")
        return arrow_map(texts.select("doc_id", "text", "reps"), cut, "h long, doc long, at long, near binary")

    hot = stage.keep(reps.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {wide}").select("h"))
    if hot.isEmpty():
        return spans.union(stage.keep(_compared(near(reps), length)))
    apart = stage.keep(_compared_apart(near(reps.join(few(hot), "h", "left_semi").select("doc", "h", "at")), length))
    rest = stage.keep(_compared(near(reps.join(few(hot), "h", "left_anti").select("doc", "h", "at")), length))
    return spans.union(rest).union(apart)


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and, if asked for, `text`, what is left, and the columns `carry`.

    Of the whole UTF-8 text (null: empty) each byte goes that lies in a string of `length` bytes
    (GRAM + 1 to 127) which also starts earlier: in a smaller doc_id, or before in the same
    document. Strings are judged on the input and never cross documents. n_spans counts the
    maximal runs removed. `text` leaves out bytes of characters that a run cut. A doc_id names one
    text: rows that repeat it with the same text are given each with the same result, and are no
    earlier documents to one another. Rows with a null doc_id stay whole. Columns that are not
    carried are not read, and carried ones may have any name but those of the result. An empty
    table gives no rows.

    Copies of a whole text are found by digest. Of all other texts one position in about 35 is
    sampled, sorted by what stands around it and compared with its neighbours; only where contexts
    differ near a common gram are their bytes read again.
    """
    stage = Stage(docs.sparkSession, "suffix")
    names = [f"carried_{k}" for k in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    marks = stage.keep(rows.select("doc_id", *names, F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha")))
    first = marks.where(f"n >= {length} and doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copies = stage.keep(marks.join(first, "sha").where("doc_id > first").select("doc_id").distinct())
    fresh = rows.where(f"octet_length(text) >= {length} and doc_id is not null").join(few(copies), "doc_id", "left_anti")
    spans = repeated_spans(stage, fresh, length)
    by_doc = stage.keep(spans.distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnRenamed("doc", "doc_id"))
    touched = rows.join(few(by_doc.select("doc_id")), "doc_id", "left_semi").join(by_doc, "doc_id")

    columns_out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode()
                own = batch.column(2)[k].values.flatten()
                start, end = own[0].to_numpy(), own[1].to_numpy()
                reach = np.maximum.accumulate(end)
                begins = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
                runs = list(zip(start[begins].tolist(), reach[np.concatenate((begins[1:] - 1, [len(end) - 1]))].tolist(), strict=True))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *batch.columns[3:]], [*columns_out, *names])

    kinds_of = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string", *(f"{n} {kinds_of[n]}" for n in names)])
    changed = arrow_map(touched.select("doc_id", "text", "spans", *names), work, schema)
    zero = F.lit(0).cast("long")
    same = [F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256")]
    gone = [F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256")]
    known = few(stage.keep(by_doc.select("doc_id").union(copies)))
    copied = marks.join(few(copies), "doc_id", "left_semi").select("doc_id", *gone, F.lit("").alias("text"), *names)
    if with_text:
        untouched = rows.withColumn("n", F.octet_length("text").cast("long")).withColumn("sha", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    else:
        untouched = marks.withColumn("text", F.lit(None).cast("string"))
    untouched = untouched.join(known, "doc_id", "left_anti").select("doc_id", *same, "text", *names)
    whole = changed.unionByName(copied).unionByName(untouched)
    return whole.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text"] if with_text else []), *(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)))
