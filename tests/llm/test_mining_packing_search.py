"""Hard negatives, best-fit packing and ranked search against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bestfit, lexical, mining

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "a b c d e f g h i j"), (6, "A B C D E F G H I J"), (7, "é" * 3000), (8, "x " * 5000), (9, "word"), (9, "word")]
VECTORS = "vec_id long, label int, embedding array<float>"


# hard negatives -----------------------------------------------------------------------------


def brute_negatives(rows, every=3):
    own = [(v, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for v, lab, e in rows if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, lab, e in own:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(e, f, strict=True)), b, other) for b, other, f in own if b != a and len(f) == len(e)]
        for pos, p, _ in sorted((x for x in score if x[2] == lab), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted((x for x in score if x[2] != lab and 50 * pos <= 100 * x[0] <= 95 * pos), key=lambda x: (-x[0], x[1]))[:3]
            out += [(a, p, k + 1, n, pos, s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


def negatives(spark, rows, every=3):
    found = mining.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def near_vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(4)] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_negatives_equal_brute_force_over_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mining, "SHARD_ROWS", 40)
    monkeypatch.setattr(mining, "ANCHOR_ROWS", 25)
    rows = near_vectors(300, 24, 7)
    rows = [(i, 0 if i % 3 else lab, e) for i, lab, e in rows]  # a label with most of the rows
    found = negatives(spark, rows)
    assert len(found) > 500
    assert found == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = near_vectors(60, 6, 3)
    rows += [(100 + i, i % 2, [0.5] * 6) for i in range(20)]  # ties
    rows += [(200, 1, None), (201, None, [1.0] * 6), (None, 1, [1.0] * 6), (203, 1, [float("nan")] * 6), (204, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (205, 0, [float("inf")] * 6)]
    rows += [(300, 0, [0.0] * 6), (303, 1, []), (306, 0, []), (309, 1, [1.0, 2.0]), (312, 0, [1.0, 1.5]), (315, 1, [2.0, 1.0]), (318, 1, [-1.0, -1.0])]
    assert negatives(spark, rows) == brute_negatives(rows)
    assert negatives(spark, []) == []
    assert negatives(spark, [(1, 1, [1.0])]) == []


def test_negatives_of_repeated_rows_and_great_components(spark):
    rows = near_vectors(40, 4, 5)
    great = [(i, i % 2, [x * 3e5 for x in e]) for i, _, e in near_vectors(30, 4, 6)]
    assert negatives(spark, great) == brute_negatives(great)
    found = negatives(spark, rows + rows)
    assert all(a != p and a != n for a, p, _, n, _, _ in found)
    beyond = negatives(spark, [(i, i % 2, [1e30 * (1 + i % 5), 1.0]) for i in range(12)])
    assert all(-(2**63) <= s < 2**63 for *_, p, n in beyond for s in (p, n))
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS + ", key int, dim int, shard int")
    assert sorted(map(tuple, mining.hard_negatives(clash, F.col("vec_id") % 3 == 0).collect())) == brute_negatives(rows)


def test_bounds_rule_out_no_pair_and_most_of_the_rest():
    rng = np.random.default_rng(2)
    low_rank = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 48)) + 0.05 * rng.normal(size=(500, 48))
    x = np.floor(64 * low_rank)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    side = mining.Side(x, turn, [12, 24, 48])
    seen = []

    def keep(lower, upper):
        seen.append((lower, upper))
        return upper >= mining.nth_largest(lower, 5)

    i, j = mining.survivors(side, side, slice(0, 100), [12, 24, 48], np.ones((100, 500), bool), keep)
    score = x[:100] @ x.T
    for lower, upper in seen[:1]:
        assert (lower <= score).all() and (score <= upper).all()
    alive = np.zeros(score.shape, bool)
    alive[i, j] = True
    assert alive[score >= -np.sort(-score, axis=1)[:, 4:5]].all()
    assert alive.mean() < 0.2
    assert (mining.exact(x, x, i, j) == score[i, j]).all()


# best-fit packing ---------------------------------------------------------------------------


def test_word_ids_equal_the_librarys():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library, own, rnd = Tokenizer.from_file(path("word_bpe_49k.json")), bestfit.WordTokens(), random.Random(4)
    assert own.fast is not None
    pool = [chr(c) for c in range(0x250)] + list("abcdefghij'''' stremdl  \n\t") * 8 + ["’", "—", "€", "日", "İ", "Σ", "ﬁ", "́", " ", "\U0001f600"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    texts += ["don't 'tis it''s 's 'll <|endoftext|> x", "A\x01b", "x" * 5000, "''''ss 're're", " ", ""]
    for text in texts:
        assert own.ids(text.encode()) == library.encode(text, add_special_tokens=False).ids, repr(text)


def packed(spark, docs, schema="doc_id long, text string"):
    found = bestfit.pack(spark.createDataFrame(docs, schema))
    rows = found.collect()
    own, texts = bestfit.WordTokens(), defaultdict(list)
    for doc, text, *_ in docs:
        texts[doc].append([*own.ids((text or "").encode()), 0])
    assert len(rows) == sum(-(-len(i) // 2048) for ids in texts.values() for i in ids)
    sums = Counter((d, k // 2048, k, len(i[k : k + 2048]), zlib.crc32(np.array(i[k : k + 2048], "<u4").tobytes())) for d, ids in texts.items() for i in ids for k in range(0, len(i), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sums
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return rows, places


def mixed_docs(n, seed):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(("one", "two", "tree", "four")) for _ in range(int(rnd.lognormvariate(5.5, 1.2))))) for i in range(n)]


def test_packing_in_one_task_needs_no_more_than_best_fit(spark):
    rows, places = packed(spark, mixed_docs(400, 1))
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1


@pytest.mark.parametrize("per_range", [60, 700])
def test_packing_in_rounds_over_ranges(spark, monkeypatch, per_range):
    monkeypatch.setattr(bestfit, "SWEEP_ROWS", per_range)
    monkeypatch.setattr(bestfit, "LAST", 20)
    rows, places = packed(spark, mixed_docs(900, 2))
    assert len(places) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_odd_documents(spark, monkeypatch):
    packed(spark, ODD)
    packed(spark, [(None, "a"), (None, None), (3, "word " * 10000)])
    monkeypatch.setattr(bestfit, "LAST", 1)
    packed(spark, [(i, "same size") for i in range(300)])  # one size for all
    packed(spark, [(i, "long " * 1500) for i in range(12)])  # none fits beside another
    packed(spark, [(1, "a b", 4, 5, 6), (2, "c", 4, 5, 6)], "doc_id long, text string, pid int, id int, size int")
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_takes_the_successor():
    took, at, left, met = bestfit.best_fit(np.array([3, 5, 9]), np.array([4, 10, 12]), 16)
    assert took.tolist() == [0, 2, 1] and at.tolist() == [4, 12, 10] and left.tolist() == [1, 1, 7] and met.all()
    runs = [{"part": 0, "docs": 5, "largest": 10, "gaps": 0, "smallest": None}, {"part": 1, "docs": 3, "largest": 30, "gaps": 0, "smallest": None}, {"part": 2, "docs": 0, "largest": None, "gaps": 4, "smallest": 31}]
    # three gaps take a large document each, the fourth as many small ones as surely fit
    assert bestfit.across(runs) == [(1, 0, 3, 2, 0, 3), (0, 0, 3, 2, 3, 1)]


# ranked search ------------------------------------------------------------------------------


def brute_rank(docs, items, k=20):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n, total, df = len(held), sum(x[2] for x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in held:
            m = 75 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items):
    found = lexical.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def some_texts(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéñß9") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    return [(rnd.randint(0, 10**12), rnd.choice((" ", ". ", "\x00", "_")).join(rnd.choice(words[: rnd.randint(3, 120)]) for _ in range(rnd.randint(1, 60)))) for _ in range(n)]


def test_ranks_equal_brute_force(spark):
    docs = some_texts(400, 1)
    docs += [(10**13 + i, docs[0][1]) for i in range(50)] + ODD + [(None, docs[1][1]), (None, "word")]
    items = [(i, t) for i, (_, t) in enumerate(some_texts(25, 2))] + [(100, docs[0][1]), (101, None), (102, ""), (103, "word WORD Word"), (104, "nowhere"), (None, "word")]
    assert ranked(spark, docs, items) == brute_rank(docs, items)
    assert ranked(spark, docs, []) == [] == ranked(spark, [], items) == ranked(spark, [(1, None)], items)


def test_ranks_of_items_in_blocks_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TERMS", 60)
    docs, items = some_texts(80, 3), [(i % 6, t) for i, (_, t) in enumerate(some_texts(12, 4))]
    assert ranked(spark, docs, items) == brute_rank(docs, items)


def test_windows_carry_heaps_and_leave_no_score_behind(monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 128)
    rnd = random.Random(5)
    tfs = [[rnd.randint(1, 4) for _ in range(3)] for _ in range(1000)]
    rows = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(1000), pa.int64()), "n": pa.array([10] * 1000, pa.int64()),
        "terms": pa.array([np.arange(3, dtype=np.int32).tobytes()] * 1000, pa.binary()), "tfs": pa.array([np.array(t, np.int32).tobytes() for t in tfs], pa.binary()),
    })
    weights = np.array([5, 7, 11])
    heaps = lexical.score_windows(iter([rows.slice(0, 300), rows.slice(300)]), [(np.array([0, 2]), np.array([1, 3])), (np.array([1]), np.array([1]))], weights, 1000, 10000, 20)
    gain = lambda tf: 10**9 * tf // (1000 * tf + 12 * 100)
    want = [sorted(((5 * gain(t[0]) + 3 * 11 * gain(t[2]), 1, -d) for d, t in enumerate(tfs)), reverse=True)[:20], sorted(((7 * gain(t[1]), 1, -d) for d, t in enumerate(tfs)), reverse=True)[:20]]
    assert [sorted(h, reverse=True) for h in heaps] == want
