"""Near-duplicate texts by bottom-k sketches, inverted lists of their values and exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, arrow_map, components, few, mix, span_hashes, text_blocks

#: Values that a sketch retains, and of those how many smallest ones have inverted lists.
RETAINED, LISTED = 64, 40
#: Of LISTED values of a union, pairs at the threshold share this many or more, but for 1 in 10 million; in smaller sets, this share.
NEEDED = 15
#: Sets up to which all pairs of a list are made, and over which a list is thinned out before its blocks are compared.
SHORT, LONG = 32, 16384
#: Sets and values in a block of a list, about.
TILE, WEIGHT = 2048, 1 << 21
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Of each text the sorted 64-bit hashes of its distinct shingles.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer words
    has one shingle of all of them; one without words has none.
    """
    data = np.frombuffer(b" ".join(t.translate(_LOWER) for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    own = span_hashes(data, start, end)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    edges = np.searchsorted(start, begins)
    out = []
    factors = np.arange(3, 4 * words + 3, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    joined = np.zeros(max(0, len(own) - words + 1), np.uint64)
    for k in range(words):
        piece = own[k : k + len(joined)] * factors[k]
        joined += piece ^ (piece >> np.uint64(29))
    joined = mix(joined)
    for k in range(len(texts)):
        a, b = edges[k], edges[k + 1]
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            few = own[a:b] * factors[words : words + b - a]
            out.append(mix((few ^ (few >> np.uint64(29))).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch) of every row; equal sets have equal keys k1 and k2.

    The top bit of a sketch's values is flipped, so that they sort as signed numbers as the hashes do as unsigned ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, low = [], [], [], []
            for _, _, block in text_blocks(batch.column(1)):
                for s in shingle_sets(block, words):
                    n.append(len(s))
                    k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    k2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)) if len(s) else 0)
                    low.append((s[:RETAINED] ^ np.uint64(1 << 63)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "n", "k1", "k2", "sketch"])

    return arrow_map(docs.select("doc_id", "text"), work, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, block in text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([s.view(np.int64) for s in shingle_sets(block, words)], pa.list_(pa.int64()))], ["id", "s"])

    return arrow_map(docs, work, "id long, s array<long>")


def _overlap() -> Column:
    """Shared values among the RETAINED smallest of the union of two sketches a and b, and how many those are."""
    both = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, RETAINED)
    return F.size(F.array_intersect(F.array_intersect("sa", "sb"), both))


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs` (doc_id, text).

    Texts are linked where den * intersection >= num * union of their full sets; component_id is
    the smallest doc_id reachable, kept marks it. Whole texts count; null and empty texts, and
    those of white space only, link with nothing. Rows that repeat a doc_id with one set are given
    each; an empty table gives no rows. doc_id must not be null: such rows have null components.

    Equal sets are one from the first step. Of a set's LISTED smallest values a partner shares
    NEEDED, so of these, in order of how many sets hold them, the last NEEDED - 1 need no list: the
    rarest shared value is among the others of both. Lists of up to SHORT sets give all their
    pairs. Longer ones are cut into blocks, compared two by two in tasks of bounded size that
    return a forest of the links. Lists of over LONG sets are thinned out first: each round
    compares central sets, twice as many as before, with all others; by the triangle inequality of
    the Jaccard distance only sets within twice the link distance of a central one can be linked
    to what it has joined, and only these, unless joined already, stay. Estimates from union
    sketches only discard pairs (64 values, more than five deviations under the threshold); links
    are confirmed on full sets.
    """
    stage = Stage(docs.sparkSession, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = stage.keep(_sketches(rows, words))
    kinds = all_rows.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"))
    kinds = stage.keep(kinds)
    sketches = stage.keep(all_rows.join(kinds.select(F.col("id").alias("doc_id"), "n", "k1", "k2"), ["doc_id", "n", "k1", "k2"]).dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("id"), "n", "sketch"))
    links = _links(stage, rows, sketches, num, den, words)
    groups = components(stage, links)
    named = kinds.join(groups, "id", "left").select("n", "k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = all_rows.select("doc_id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left")
    whole = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), (F.col("doc_id") == whole).alias("kept"))


def _links(stage: Stage, rows: DataFrame, sketches: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Pairs (a, b) of linked sets: of short lists all, of long lists enough for the same components."""
    postings = sketches.where("n > 1").select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    held = postings.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = postings.join(held, "v")
    by_set = Window.partitionBy("id")
    listed = F.least("n", F.lit(LISTED))
    ranked = shared.withColumn("rank", F.row_number().over(by_set.orderBy("c", "v"))).withColumn("m", F.count(F.lit(1)).over(by_set))
    first = ranked.where(listed - F.col("m") + F.col("rank") <= listed - F.greatest(F.lit(1), F.floor(listed * (NEEDED / LISTED))) + 1)
    first = stage.keep(first.select("v", "id", "n"))
    sizes = first.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tagged = stage.keep(first.join(sizes, "v"))
    # short lists: the partners are close in size
    close = lambda x, y: (F.least(x["n"], y["n"]) * den >= F.greatest(x["n"], y["n"]) * num) & (x["id"] < y["id"])
    lists = tagged.where(f"c <= {SHORT}").groupBy("v").agg(F.collect_list(F.struct("id", "n")).alias("l"))
    pairs = lists.select(F.explode(F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: close(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))).alias("p"))
    pairs = stage.keep(_likely(pairs.select("p.a", "p.b").distinct(), sketches, num / den))
    hot = tagged.where(f"c > {SHORT}")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(hot.select("id")).distinct()
    wanted = stage.keep(wanted)
    texts = rows.join(few(wanted.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
    sets = stage.keep(_full_sets(texts, words).dropDuplicates(["id"]))
    links = [_confirmed(pairs, sets).where(f"{den} * i >= {num} * u").select("a", "b")]
    very_long = hot.where(f"c > {LONG}").withColumn("central", F.sum("c").over(by_set)).select("v", "id", "n", "central", F.lit(False).alias("ring"), F.lit(False).alias("debt"))
    left = hot.where(f"c <= {LONG}").select("v", "id", "n")
    if not hot.where(f"c > {LONG}").isEmpty():
        thinned, rest = _thinned(stage, stage.keep(very_long), sketches, sets, num, den)
        links.append(thinned)
        left = left.union(rest)
    links.append(_tiled(left, sets, num, den))
    whole = links[0]
    for x in links[1:]:
        whole = whole.union(x)
    return stage.keep(whole.distinct())


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None, groups: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """How many values each of `a` shares with each of `b` (None: with `a` itself), by products of incidence matrices.

    With `groups`, sorted bounds, the counts of the values up to each bound, one after the other
    in one array that changes; else the counts of all values.
    """
    both = a if b is None else a + b
    at = np.repeat(np.arange(len(both)), [len(x) for x in both])
    values, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    dense = np.cumsum(times > 1) - 1
    at, column, values = at[keep], dense[column[keep]], values[times > 1]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    out = np.zeros((len(a), len(both) - (len(a) if b is not None else 0)), np.float64)
    first = 0
    for last in [len(values)] if groups is None else np.searchsorted(values, groups, side="right"):
        for low in range(first, last, 2048):
            high = min(low + 2048, last)
            i, j = np.searchsorted(column, [low, high])
            held = np.zeros((len(both), high - low), np.float32)
            held[at[i:j], column[i:j] - low] = 1
            out += held[: len(a)] @ (held if b is None else held[len(a) :]).T
        first = max(first, last)
        yield out


def likely_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, level: float) -> np.ndarray:
    """Which pairs of `a` with `b` (None: with `a` itself) the sketches of their union do not rule out.

    The union sketch of a pair is taken up to the last of nine bounds up to which both sketches are complete.
    """
    low = [[s[:RETAINED] for s in x] for x in (a, a if b is None else b)]
    most = [np.array([s[RETAINED - 1] if len(s) > RETAINED else 2**64 - 1 for s in x], np.uint64) for x in (a, a if b is None else b)]
    ends = np.sort(np.concatenate(most))
    bounds = np.unique(ends[np.linspace(0, len(ends) - 1, 9).astype(int)])
    complete = np.minimum.outer(*(np.searchsorted(bounds, x, side="right") for x in most))
    out = np.zeros(complete.shape, bool)
    for k, shared in enumerate(shared_counts(low[0], None if b is None else low[1], bounds)):
        held = [np.array([np.searchsorted(s, bounds[k], side="right") for s in x]) for x in low]
        union = np.add.outer(*held) - shared
        out |= (complete == k + 1) & (shared >= level * union - 5.2 * np.sqrt(level * (1 - level) * union))
    return out


def tile_forest(ids: list[np.ndarray], sets: list[list[np.ndarray]], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one block of sets, or of two against each other, every set that is linked and the smallest id that its links within the tile reach."""
    a, b = sets[0], sets[1] if len(sets) > 1 else None
    sizes = [np.array([len(s) for s in x]) for x in (a, a if b is None else b)]
    maybe = likely_pairs(a, b, num / den)
    maybe &= np.minimum.outer(*sizes) * den >= np.maximum.outer(*sizes) * num
    if b is None:
        np.fill_diagonal(maybe, False)
    rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = [a[k] for k in rows], None if b is None else [b[k] for k in columns]  # of one block both are the same
    shared = next(shared_counts(*own))
    union = np.add.outer(sizes[0][rows], sizes[1][columns]) - shared
    linked = maybe[np.ix_(rows, columns)] & (den * shared >= num * union)
    names = [ids[0][rows], (ids[0] if b is None else ids[1])[columns]]
    label = [names[0].copy(), names[1].copy()]
    while True:  # the smallest id goes along the links until nothing changes
        x = np.minimum(label[0], np.where(linked, label[1][None, :], np.iinfo(np.int64).max).min(axis=1))
        y = np.minimum(label[1], np.where(linked, x[:, None], np.iinfo(np.int64).max).min(axis=0))
        if b is None:
            x = y = np.minimum(x, y)
        if (x == label[0]).all() and (y == label[1]).all():
            break
        label = [x, y]
    members, roots = (names[0], label[0]) if b is None else (np.concatenate(names), np.concatenate(label))
    other = members != roots
    return roots[other], members[other]


def _tiled(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that connect what the links within each list of `rows` (v, id, n) connect.

    A list is cut into blocks by the hash of the id, of about TILE sets or WEIGHT values; each two
    blocks are compared in one task, which returns at most one pair for each of its sets.
    """

    def work(group: pa.Table) -> pa.Table:
        first = group.column("first").to_numpy()
        ids, found = group.column("id").to_numpy(), [np.sort(np.asarray(s, np.int64).view(np.uint64)) for s in group.column("s").combine_chunks().to_numpy(zero_copy_only=False)]
        sides = [np.flatnonzero(first), np.flatnonzero(~first)]
        if group.column("i")[0] == group.column("j")[0]:
            sides = sides[:1]
        a, b = tile_forest([ids[x] for x in sides], [[found[k] for k in x] for x in sides], num, den) if all(map(len, sides)) else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = rows.groupBy("v").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / WEIGHT)).alias("blocks"))
    cut = rows.join(blocks, "v").withColumn("k", F.pmod(F.xxhash64("id"), "blocks")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("v", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), (F.col("k") <= F.col("x")).alias("first"), "id")
    return cut.join(sets, "id").select("v", "i", "j", "first", "id", "s").groupBy("v", "i", "j").applyInArrow(work, "a long, b long")


def _thinned(stage: Stage, hot: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links of the central sets of very long lists, and the rows (v, id, n) that can have links besides these."""
    far, links = 1 - num / den, []
    few_ids = few(stage.keep(hot.select("id").distinct()))
    sketches, sets = (stage.keep(x.join(few_ids, "id", "left_semi")) for x in (sketches, sets))
    for turn in range(6):
        if hot.isEmpty():
            break
        ask = _pivots(hot, 2 << turn)
        met = hot.join(ask, "v").where("id <> pivot")
        tries = met.where(F.least("n", "pn") * den >= F.greatest("n", "pn") * F.lit(num / 2)).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        likely = stage.keep(_confirmed(_likely(tries, sketches, num / den, 0.2), sets).withColumn("d", 1 - F.col("i") / F.col("u")))
        links.append(likely.where(f"{den} * i >= {num} * u").select("a", "b"))
        # of each list: who is linked to a pivot, and who may be linked to one that is and is not known to be joined to that pivot
        ends = likely.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "d").union(likely.select(F.col("b").alias("id"), F.col("a").alias("pivot"), "d"))
        ends = ends.where(f"d <= {2 * far}").join(ask.select("pivot").distinct(), "pivot", "left_semi")
        linked = ends.where(f"d <= {far}")
        lead = linked.groupBy("pivot").agg(F.min("id").alias("low")).select("pivot", F.least("pivot", "low").alias("lead"))
        group = linked.join(lead, "pivot").groupBy("id").agg(F.min("lead").alias("own"))
        ends = ends.join(group, "id", "left").join(lead, "pivot", "left")
        ends = ends.select("id", "pivot", "d", F.coalesce(F.col("own") != F.col("lead"), F.lit(True)).alias("apart"))
        near = stage.keep(met.join(ends, ["id", "pivot"]).select("v", "id", "pivot", "ring", "d", "apart"))
        unsure = near.where(f"d > {far} and apart and not ring").groupBy("v", "pivot").agg(F.min("d").alias("least"))
        mine = near.join(unsure, ["v", "pivot"], "left").groupBy("v", "id").agg(
            F.max(F.col("d") <= far).alias("joined"),
            F.max((F.col("d") <= far) & (F.col("least") - F.col("d") <= far)).alias("rim"),
            F.max((F.col("d") > far) & F.col("apart")).alias("unsure"),
        )
        pivots = ask.select("v", F.col("pivot").alias("id"), F.lit(True).alias("done"))
        rest = hot.join(mine, ["v", "id"], "left").join(pivots, ["v", "id"], "left").where("done is null")
        rest = rest.select("v", "id", "n", "central", "ring", (F.col("debt") | F.coalesce("unsure", F.lit(False))).alias("debt"), F.coalesce("joined", F.lit(False)).alias("joined"), F.coalesce("rim", F.lit(False)).alias("rim"))
        rest = rest.where("ring or debt or not joined or rim").select("v", "id", "n", "central", F.expr("ring or (joined and not debt)").alias("ring"), "debt")
        live = rest.groupBy("v").agg(F.sum(F.col("ring").cast("int")).alias("r"), F.count(F.lit(1)).alias("c")).where("c > 1 and c > r").select("v")
        hot = stage.keep(rest.join(live, "v", "left_semi"))
    whole = links[0]
    for x in links[1:]:
        whole = whole.union(x)
    return whole, hot.select("v", "id", "n")


def _pivots(hot: DataFrame, most: int) -> DataFrame:
    """(v, pivot, pn): of each list the sets to compare with all others now, those that share most with others first."""
    open_ = hot.where("not ring")
    few_left = open_.groupBy("v").agg(F.count(F.lit(1)).alias("left")).where(f"left <= {SHORT}")
    order = Window.partitionBy("v").orderBy(F.desc("central"), "id")
    top = open_.withColumn("_n", F.row_number().over(order)).where(f"_n <= {max(most, SHORT)}")
    top = top.join(few_left, "v", "left").where(f"_n <= {most} or left is not null")
    return top.select("v", F.col("id").alias("pivot"), F.col("n").alias("pn"))


def _likely(pairs: DataFrame, sketches: DataFrame, level: float, least: float | None = None) -> DataFrame:
    """The pairs whose union sketch does not rule them out."""
    a = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    bound = least if least is not None else level - 5.2 * (level * (1 - level) / RETAINED) ** 0.5
    union = F.least(F.size(F.array_union("sa", "sb")), F.lit(RETAINED))
    return pairs.join(a, "a").join(b, "b").where(_overlap() >= F.lit(bound) * union).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, i, u): sizes of intersection and union of the full sets."""
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("fa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("fb")), "b")
    joined = joined.select("a", "b", F.size(F.array_intersect("fa", "fb")).cast("long").alias("i"), F.size("fa").alias("x"), F.size("fb").alias("y"))
    return joined.select("a", "b", "i", (F.col("x") + F.col("y") - F.col("i")).alias("u"))
