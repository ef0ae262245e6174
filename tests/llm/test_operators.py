"""The ten operators against brute force, and their edge cases."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, common, embedding_dedup, html, langid, minhash, packing, sampling, suffix, toxicity, warc

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "a b c d e f g h i j"), (6, "A B C D E F G H I J"), (7, "é" * 3000), (8, "x " * 5000), (9, "word"), (9, "word")]


def vocabulary(rnd, n=400):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def near_texts(seed, groups=12, size=6, length=60):
    rnd = random.Random(seed)
    words, out = vocabulary(rnd), []
    shared = [rnd.choice(words) for _ in range(12)]
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(length)] + shared
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(length)] = rnd.choice(words)
            out.append(" ".join(own))
    return out


def brute_components(texts):
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            i, j = sorted((find(a), find(b)))
            parent[j] = i
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("short, long, tile", [(2, 4, 3), (2, 100, 3), (2, 100, 2048), (32, 100, 2048)])
def test_minhash_matches_brute_force(spark, monkeypatch, short, long, tile):
    """Short lists by pairs, longer ones by blocks, very long ones thinned out first."""
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "LONG", long)
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = list(enumerate(near_texts(3)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("cut", [0, 70])
def test_minhash_tiles_match_brute_force(cut):
    rnd = np.random.default_rng(1)
    base = [rnd.integers(0, 2**63, size, dtype=np.uint64) for size in (30, 90, 400)]
    sets = []
    for k in range(150):
        own = base[k % 3].copy()
        own[: rnd.integers(0, len(own) // 3)] = rnd.integers(0, 2**63)
        sets.append(np.unique(own))
    ids = np.arange(150)
    cuts = [ids] if not cut else [ids[:cut], ids[cut:]]
    root, member = minhash.tile_forest(cuts, [[sets[k] for k in x] for x in cuts], 75, 100)
    label = dict(zip(ids.tolist(), ids.tolist())) | dict(zip(member.tolist(), root.tolist()))
    parent = ids.copy()
    for a, b in itertools.combinations(range(150), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and (not cut or a < cut <= b):
            parent[parent == max(parent[a], parent[b])] = min(parent[a], parent[b])
    assert label == dict(enumerate(parent.tolist()))


def test_minhash_links_subsets_at_the_threshold(spark):
    """Texts cut by a quarter: sets of more values than a sketch retains lose no link of Jaccard similarity 0.75 in their short lists."""
    rnd, rows, expected = random.Random(17), [], {}
    for small, large in [(66, 88), (75, 98), (84, 112), (90, 120), (99, 132)] * 250:
        words, first = [f"{rnd.getrandbits(40):x}" for _ in range(large + 4)], len(rows)
        rows += [(first, " ".join(words)), (first + 1, " ".join(words[: small + 4]))]
        expected |= {first: (large, first), first + 1: (small, first)}
    assert brute_components(rows[:10]) == {d: expected[d] for d in range(10)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == expected


def test_minhash_tells_patterned_words_apart(spark):
    """A Thue-Morse word and its complement, which collide in every polynomial modulo a power of two."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("ba"[b] for b in bits[:64])), (4, "".join("ab"[b] for b in bits[:64]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_span_hashes_depend_on_the_bytes_alone():
    rnd = np.random.default_rng(3)
    spans = [rnd.integers(97, 99, n, dtype=np.uint8).tobytes() for n in [*range(0, 40), 63, 64, 65, 200] * 3]
    data = np.frombuffer(b"".join(s + b" " for s in spans), np.uint8)
    size = np.array([len(s) for s in spans])
    end = np.cumsum(size + 1) - 1
    one = common.span_hashes(data, end - size, end)
    two = common.span_hashes(np.concatenate(([7], data)).astype(np.uint8), end - size + 1, end + 1)
    assert (one == two).all() and len(set(one.tolist())) == len(set(spans))


def test_minhash_edge_cases(spark):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit(1))).collect())
    assert got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == got[(3, 0, 3, True)] == 1
    assert got[(4, 1, 4, True)] == 1 and got[(9, 1, 4, False)] == 2
    assert got[(5, 6, 5, True)] == 1 and got[(6, 6, 5, False)] == 1
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_paths_and_hubs(spark):
    stage = common.Stage(spark, "test")
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 999) for i in range(30)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in common.components(stage, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **{100 + i: 100 for i in range(30)}, 999: 100}
    assert common.components(stage, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("wide, often", [(100_000, 8), (2, 8), (100_000, 2), (2, 1)])
def test_suffix_matches_brute_force(spark, monkeypatch, wide, often):
    """Grams of few and of very many contexts, and such as are common in some blocks only."""
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (wide,))
    monkeypatch.setattr(suffix._sampled, "__defaults__", (often,))
    rnd = random.Random(5)
    words = vocabulary(rnd, 200)
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 300), (5, "é" * 200), (6, passage), (7, passage)]
    for k in range(8, 40):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        cut = rnd.randint(0, len(passage) // 2)
        rows.append((k, " ".join(own[:3]) + passage[cut : cut + rnd.randint(60, 260)] + " ".join(own[3:])))
    rows.append((41, " ".join(rnd.choice(words) for _ in range(60000)) + passage + rows[12][1] * 3))
    df = spark.createDataFrame(rows, DOCS).withColumn("n_bytes", F.lit("other")).repartition(5, "doc_id")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_suffix_edge_cases(spark):
    df = spark.createDataFrame([(1, "x" * 150, "k"), (1, "x" * 150, "k"), (None, "x" * 150, "n")], DOCS + ", n string")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["text"], r["n"]) for r in suffix.remove_repeats(df, with_text=True, carry=("n",)).collect()]
    # of 51 equal strings the first stays, of which the second leaves its first byte
    assert sorted(got, key=str) == sorted([(1, 150, 149, "x", "k"), (1, 150, 149, "x", "k"), (None, 150, 0, "x" * 150, "n")], key=str)
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_samples_follow_the_lattice():
    own, n = sampling.pieces(None), 3000
    drawn = list(sampling.segmentations(own, ["this"] * n, np.arange(n, dtype=np.uint64), 2))
    p = {tuple(ids): math.exp(lp) for _, _, ids, lp, _, _ in drawn}
    assert abs(sum(p.values()) - 1) < 1e-3
    best = max(p, key=p.get)
    first = collections.Counter(tuple(ids) for _, rank, ids, *_ in drawn if rank == 1)
    second = collections.Counter(tuple(ids) for _, rank, ids, *_ in drawn if rank == 2)
    assert abs(first[best] / n - p[best]) < 0.03
    assert abs(second[best] / n - sum(p[o] * p[best] / (1 - p[o]) for o in p if o != best)) < 0.03
    values = collections.defaultdict(list)
    for k, _, ids, _, value, score in drawn:
        values[k].append((value, tuple(ids)))
        assert score <= 1e-9
    assert all(len({i for _, i in v}) == len(v) and v == sorted(v, reverse=True) for v in values.values())


def all_segmentations(own, word):
    """Ids and weight of every way to cut a word into pieces, one after the other."""
    held = {own.model.id_to_piece(i): i for i in range(own.model.get_piece_size()) if not (own.model.is_control(i) or own.model.is_unknown(i) or own.model.is_byte(i))}

    def rest(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            i = held.get(word[at:end])
            if i is not None:
                yield from (((i, *ids), own.weight[i] + w) for ids, w in rest(end))

    return dict(rest(0))


def test_samples_match_full_enumeration():
    """All segmentations of two words with their probabilities, and inclusion scores that weigh two of them without bias."""
    own = sampling.pieces(None)
    one, two = all_segmentations(own, "▁cat"), all_segmentations(own, "▁oat")
    whole = {a + b: x + y for a, x in one.items() for b, y in two.items()}
    norm = math.log(sum(math.exp(x) for x in whole.values()))
    assert 9 < len(whole) < 400
    drawn = list(sampling.segmentations(own, ["cat oat", "", "cat oat"], np.array([5, 6, 7], np.uint64), len(whole) + 3))
    for k in (0, 2):
        got = {tuple(ids): lp for t, _, ids, lp, _, _ in drawn if t == k}
        assert got.keys() == whole.keys() and all(abs(got[i] - whole[i] + norm) < 1e-9 for i in whole)
        assert all(score == 0 for t, *_, score in drawn if t == k)
        values = [v for t, *_, v, _ in drawn if t == k]
        assert values == sorted(values, reverse=True)
    assert [x for x in drawn if x[0] == 1] == [(1, 1, [], 0.0, 0.0, 0.0)]
    n = 4000
    for size in (1, 2, 3):
        drawn = list(sampling.segmentations(own, ["cat oat"] * n, np.arange(n, dtype=np.uint64), size))
        weighed = sum(math.exp(lp - score) for *_, lp, _, score in drawn) / n
        assert abs(weighed - 1) < 0.05, size


def test_samples_of_long_texts_spell_them(spark):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcdeéß☃🙂日") for _ in range(rnd.randint(1, 12))) for _ in range(60000))
    own = sampling.pieces(None)
    rows = sampling.sample(spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3)], DOCS + ", rank int"), 2).collect()
    assert len(rows) == 6 and all(own.model.decode(list(r["ids"])) == text and r["decoded_crc32"] == zlib.crc32(text.encode()) for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert len({r["ids_crc32"] for r in rows if r["doc_id"] == 4}) == 2


def test_samples_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "The cat  sat.\nÉté ☃ 日本 🙂"), (4, "a"), (5, " lead"), (6, "z" * 3000)]
    df = spark.createDataFrame(rows, DOCS)
    found = sampling.sample(df, 3)
    texts = {(r["doc_id"], r["text"]) for r in sampling.decode(found).collect()}
    assert texts == {(d, t or "") for d, t in rows}
    assert {(r["doc_id"], r["text"]) for r in sampling.decode(sampling.encode(df)).collect()} == {(d, t or "") for d, t in rows}
    again = {(r["doc_id"], r["rank"]): r["ids_crc32"] for r in sampling.sample(df.repartition(3), 3, with_ids=False).collect()}
    assert again == {(r["doc_id"], r["rank"]): r["ids_crc32"] for r in found.collect()}
    assert sampling.sample(df.limit(0)).count() == 0


def vectors(seed, n=120, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    rows = [(i, (base[i % len(base)] + rng.normal(size=dim) * rng.choice([0.02, 0.08, 0.3])).astype(float).tolist()) for i in range(n)]
    odd = [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [1.0, None] + [0.0] * (dim - 2)), (1004, [float("inf")] * dim), (1005, rows[3][1]), (1006, [1.0, 2.0])]
    return rows, odd


def test_embedding_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rows, odd = vectors(1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()}
    sound = [(i, np.array(np.float32(v), float)) for i, v in [*rows, odd[5]]]
    links = collections.defaultdict(set)
    for (i, a), (j, b) in itertools.combinations(sound, 2):
        if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i].add(j)
            links[j].add(i)
    for i, *_ in rows + odd:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i] == (len(links[i]), min(seen), i == min(seen)), i
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(u)
    approx = (q * s[:, None]) @ (q * s[:, None]).T
    bound = e[:, None] + np.linalg.norm(q * s[:, None], axis=1)[:, None] * e[None, :] + 1e-12
    assert (np.abs(approx - u @ u.T) <= bound).all()


def test_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 64))
    base[:900] = base[0] + rng.normal(size=(900, 64)) * 0.05
    base /= np.linalg.norm(base, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)] + [(5000, None), (5020, [0.0] * 64), (5040, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(dict)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    single, hits = base.astype(np.float32).astype(float), 0
    assert sorted(got) == list(range(0, 3000, 20))
    for i, found in got.items():
        score = single @ single[i]
        score[i] = -9
        best = np.lexsort((np.arange(3000), -score))[:20]
        hits += len({v for v, _ in found.values()} & set(best.tolist()))
        assert sorted(found) == list(range(1, 21)) and all(abs(s - score[v]) < 1e-12 for v, s in found.values())
        assert [x for _, x in sorted(found.items())] == sorted(found.values(), key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(got)) >= 0.9
    few = ann.search(df.limit(3), df.limit(1)).collect()
    assert len(few) == 2
    assert ann.search(df.limit(0), df).count() == 0


def test_neighbours_of_many_queries_are_found_in_blocks(spark, monkeypatch):
    """No task holds more than a block of queries, and the blocks give what one gives."""
    df = spark.createDataFrame(vectors(8, n=300)[0], "vec_id long, embedding array<double>")
    ask = lambda: {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in ann.search(df, df, k=5, probes=64, rerank=300).collect()}
    whole = ask()
    monkeypatch.setattr(ann, "QUERY_ROWS", 50)
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    held, asked = ann.dealt(df, df)
    assert max(r["count"] for r in asked.groupBy("shard", "block").count().collect()) <= 100
    assert held.alias("a").join(asked.alias("b"), ["shard", "block"]).count() == df.count() ** 2
    assert ask() == whole


def toxic_texts(seed, n=600):
    rnd = random.Random(seed)
    words = vocabulary(rnd, 300)
    out = []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        if i % 4 == 0:
            own[rnd.randrange(len(own))] = rnd.choice(["wretchling", "scumbucket", "vileheart"])
        out.append((i, " ".join(own), int(i % 4 == 0)))
    return out


def test_toxicity_held_out_accuracy(spark):
    rows = toxic_texts(4)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS).withColumn("toxicity_score", F.lit("x"))
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxicity_label"] for r in toxicity.toxicity(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    texts = [t for _, t, _ in rows]
    bare, more = (toxicity.score_texts(model, pa.array([p + t for t in texts])) for p in ("", f"{texts[0].split()[0]} "))
    assert ((bare >= 0.5) == (more >= 0.5)).mean() > 0.99  # a word in front flips no labels
    assert np.allclose(bare[:60], [brute_toxicity(model, t) for t in texts[:60]])
    assert toxicity.score_texts(model, pa.array(["you wretchlinng"]))[0] > toxicity.score_texts(model, pa.array([""]))[0]
    unseen = [(t.encode(), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    slips = toxicity.score_texts(model, pa.array(toxicity.misspelt([t for t, _ in unseen], 99), pa.binary())) >= 0.5
    real = np.array([y == 1 for _, y in unseen])
    assert slips[real].mean() >= 0.7 and slips[~real].mean() <= 0.05
    odd = toxicity.toxicity(spark.createDataFrame(ODD, DOCS), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["toxicity_score"] <= 1 for r in odd)
    empty = toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, empty).where("toxicity_label = 1").count() == 0


def test_toxicity_sample_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "calibrated", lambda texts, labels: seen.append((texts, labels.tolist())))
    docs = spark.createDataFrame([(i, f"{i} " * 50) for i in range(40)] + [(1, "again"), (1, "again"), (2, None)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for sample, most in ((1000, 1 << 20), (10, 1 << 20), (1000, 1000), (1000, 3)):
        toxicity.fit(docs, labels, sample, most)
    whole = seen[0][0]
    assert sorted(whole) == sorted((r["text"] or "").encode() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    assert all(texts == whole[: len(texts)] for texts, _ in seen) and len(seen[1][0]) <= 10
    assert sum(map(len, seen[2][0])) <= 1000 and sum(map(len, seen[3][0])) <= 3
    assert all(y == int(t.split()[0]) % 2 for t, y in zip(*seen[0]) if t[:1].isdigit())


def brute_toxicity(model, text):
    """The score word by word and n-gram by n-gram."""
    values = []
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        whole = f" {w} ".encode()
        own = common.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]
        held = [model.weight[int(own) % len(model.weight)]]
        for n in (3, 4, 5):
            for k in range(len(whole) - n + 1):
                packed = np.array([int.from_bytes(bytes([0, 0, 0, *[0] * (5 - n)]) + whole[k : k + n], "big") | n << 8 * n], np.uint64)
                held.append(model.weight[int(common.mix(packed)[0]) % len(model.weight)])
        values.append(np.mean(np.array(held, float)))
    pairs = [(a + b) / 2 for a, b in zip(values, values[1:])] or values
    logit = max([min(model.bias, -4.0), *(p + model.bias for p in pairs)]) - model.shift
    return 1 / (1 + math.exp(-logit))


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>menu</a></nav><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text<br>more<p>Two &lt;x&gt;<div class="comments">nice</div><script>var a="<p>no</p>"</script></article><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (4, "x", "plain <b>text"), (5, "http://h/5", "<article><p>cut off he"), (6, "http://h/6", "<p>a</p><p>b &am")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "Head & line\nOne bold text more\nTwo <x>"
    assert got[2] == ("", 0) and got[3] == ("", 0)
    assert got[4][0] == "plain text" and got[5][0] == "cut off he" and got[6][0] == "a\nb &am"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "html_, expected",
    [
        ('<div class="layout no-sidebar"><article><p>kept</p></article></div>', "kept"),
        ('<div class="sidebar-left page"><main id="search-results"><p>kept</p></main></div>', "kept"),
        ('<article class="post has-comments"><p>kept</p><div class="comments"><p>nice</p></div></article>', "kept"),
        ('<main><p>a</p><article class="comment"><p>me too</p></article><p>b</p></main>', "a\nb"),
        ('<article><p>see <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here</p><div class="alert">mind the gap</div></article>', "see x+1 here\nmind the gap"),
        ('<form action="/"><div class="menu">m</div><article><p>kept</p></article><input></form>', "kept"),
        ('<article><p>a</p><form><p>sign</p></form><div class="ad">buy</div><aside>s</aside></article>', "a"),
        ('<div class="has-sidebar"><p>kept</p></div><div id="sidebar"><p>gone</p></div><div class="cookie-notice">gone</div>', "kept"),
        ("<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article>" + "<p>long words </p>" * 100_000 + "</article>", "\n".join(["long words"] * 100_000)),
    ],
)
def test_html_keeps_what_is_the_article(html_, expected):
    page = html.Page(html_)
    assert "\n".join(page.main if page.has_main else page.blocks) == expected


def brute_templates(rows):
    """Pages by host and subtree, counted one by one."""
    pages = collections.defaultdict(dict)
    for _, url, text in rows:
        page = html.Page(text or "")
        m = re.match(r"[A-Za-z][\w+.-]*://([^/?#:]*)", url or "")
        pages[m[1].lower() if m else ""][page.body] = page.subtrees
    out = {}
    for name, bodies in pages.items():
        counts = collections.Counter(x for own in bodies.values() for x in own)
        drop = {x for x, n in counts.items() if n >= 5 and n >= 0.05 * len(bodies)}
        if drop:
            out[name] = drop
    return out


def test_html_templates_are_counted_per_host(spark):
    page = "<body><div><p>Our site says hello</p></div><div><p>Story {0}</p></div></body>"
    rows = [(i, f"http://a/{i}", page.format(i)) for i in range(8)] + [(100 + i, f"http://b{i}/", page.format(i)) for i in range(8)]
    rows += [(200 + i, f"http://c/{i}", page.format("same")) for i in range(8)]
    note = '<article><p>Story {0}</p><div class="notice">Read our terms</div><p>A line that many quote</p></article>'
    rows += [(300 + i, f"http://d/{i}", note.format(i)) for i in range(8)] + [(400, "http://e/", note.format(1))]
    rows += rows[:8]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("other")).withColumn("drop", F.lit(1))
    lists = {r["host"]: set(r["drop"]) for r in html.templates(df).collect()}
    assert lists == brute_templates(rows) and set(lists) == {"a", "d"}
    found = html.extract(df).collect()
    got = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert got[3] == "Story 3" and got[103] == "Our site says hello\nStory 3"
    assert got[203] == "Our site says hello\nStory same"
    # a notice within articles goes where the host repeats it, a line that they share stays
    assert got[303] == "Story 3\nA line that many quote" and got[400] == "Story 1\nRead our terms\nA line that many quote"


def test_html_templates_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert {r["host"]: set(r["drop"]) for r in html.templates(pages).collect()} == brute_templates([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])


def test_packing_covers_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    rows = [*ODD, (50, "a<|endoftext|>b"), (51, "<|endoftext|>"), (52, " <|endoftext|> <|endoftext|"), (53, "é<|endoftext|>" * 40000), *((100 + i, " ".join(rnd.choice(["the", "quick", "<|endoftext|>", "éa", "\n"]) for _ in range(rnd.randint(0, 3000)))) for i in range(40))]
    pieces = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(2)).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*own.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    copies = collections.Counter(d for d, _ in rows)
    sequences, covered = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own_ids = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own_ids)
        assert p["ids_crc32"] == zlib.crc32(np.array(own_ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        covered[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert all(sorted(covered[d]) == sorted(list(range(len(x))) * copies[d]) for d, x in ids.items())
    total = sum(len(ids[d]) for d, _ in rows)
    assert len(sequences) <= total // 1024 + 3
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind", ["lognormal", "uniform"])
def test_pieces_are_cut_only_where_none_fits(kind):
    rng, room = np.random.default_rng(4), 1024
    lengths = rng.integers(1, room, 1500) if kind == "uniform" else np.clip(rng.lognormal(5.5, 1, 1500).astype(np.int64), 1, room - 1)
    open_, expected = [[0.0, k, room] for k in range(-(-int(lengths.sum()) // room))], []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        begin, left = 0, int(lengths[piece])
        while left:
            best = min([x for x in open_ if x[2] >= left] or [x for x in open_ if x[2]])
            put = min(left, best[2])
            expected.append((piece, begin, put, best[1], room - best[2]))
            best[0], best[2] = best[0] + packing.cost(put), best[2] - put
            begin, left = begin + put, left - put
    assert list(packing.assign(lengths, room)) == expected


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "same " * 40 + "</p>"
    rows = [(3, "http://a/x y", big), (1, "http://b/", big), (2, None, "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né" * 9)]
    rows += [(7, "u", "".join(random.Random(3).choices("abcdefghij<>é \0\n\r", k=300_000))), (8, "u", "z" * 17_000_000), (9, "u", "end")]
    path = str(tmp_path / "w")
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string").withColumn("digest", F.lit("other"))
    warc.write(df.coalesce(1), path, file_bytes=1000)
    archives = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert len(archives) > 3 and max(len(list(warc.unpack(a))) for a in archives) <= 12
    assert sum(len([m for m in warc.unpack(a) if m]) for a in archives) == 3 * (len(rows) + 1)  # a member for each record
    assert all(gzip.decompress(a) == b"".join(warc.unpack(a)) for a in archives)
    records = warc.read(spark, path)
    got = {int(r["metadata"]["fields"]["page-id"]): r for r in warc.assemble(records).collect()}
    assert {k: r["response"]["type"] for k, r in got.items()} == {k: "revisit" if k == 3 else "response" for k in range(1, 10)}
    for i, _, text in rows:
        body = (text or "").encode()
        assert got[i]["response"]["payload_digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert got[i]["request"] is not None
        if got[i]["response"]["type"] == "response":
            assert bytes(got[i]["response"]["block"]).split(b"\r\n\r\n", 1)[1] == body
            assert (got[i]["response"]["payload_bytes"], got[i]["response"]["payload_sha256"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert got[3]["response"]["refers_to"] == next(r["record_id"] for r in records.where("type = 'response'").collect() if r["uri"] == "http://b/")
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense\r\n\r\n"))
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("damage", ["payload", "cut", "member"])
def test_warc_damage_is_found(spark, tmp_path, damage):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(1, "http://a/", "<p>a payload</p>" * 20)], "page_id long, url string, html string"), path)
    [part] = (p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size)
    members = list(warc.unpack(part.read_bytes()))
    if damage == "payload":
        data = b"".join(gzip.compress(m.replace(b"a payload", b"a poyload", 1)) for m in members)
    elif damage == "cut":
        data = b"".join(members)[:-600]
    else:
        data = part.read_bytes()[:-40]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / f"x.warc{'' if damage == 'cut' else '.gz'}").write_bytes(data)
    with pytest.raises(Exception, match="not what its digest says|breaks off|no WARC record"):
        warc.read(spark, str(tmp_path / "x"), blocks=False).collect()


def test_language_evidence_is_fused(spark):
    rnd = random.Random(3)
    words = {"aa": ["kalo", "mira", "tolu", "sena"], "bb": ["xyzzy", "grunt", "plugh", "fnord"]}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(30)), x, None, f"www.{x}.example.org") for i, x in ((i, "aa" if i % 3 else "bb") for i in range(120))]
    rows += [(500, "mira sena tolu kalo", None, None, "other.net"), (501, "grunt fnord plugh", "aa", None, "other.net"), (502, "123 !!", None, None, "www.bb.example.org"), (503, None, "bb", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df), ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["language"] == x for i, _, x, *_ in rows[:120])
    assert (got[500]["language"], got[501]["language"], got[502]["language"], got[503]["language"]) == ("aa", "bb", "bb", "bb")
    assert got[502]["evidence"] <= 2 and 0.5 <= got[500]["posterior"] <= 1
    blank = df.withColumn("declared", F.lit(None).cast("string"))
    assert langid.identify(blank, langid.fit(blank), ["doc_id"]).where("language is not null").count() == 0
    assert langid.identify(df.limit(0), langid.fit(df), ["doc_id"]).count() == 0


def brute_languages(rows):
    """(language, posterior) of (id, text, declared, suffix, host), evidence by evidence."""
    held = {k: langid._trigrams((t or "").encode()) for k, t, *_ in rows}
    names = sorted({x for _, _, x, *_ in rows if x})
    counts = {x: collections.Counter(g for k, _, own, *_ in rows if own == x for g in held[k].tolist()) for x in names}
    totals = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    share = {x: sum(own == x for _, _, own, *_ in rows) / sum(bool(own) for _, _, own, *_ in rows) for x in names}
    parent = lambda h: (re.findall(r"[^.]+\.[^.]+$", h or "") or [""])[0]
    seen, first = {}, {}
    for k, _, declared, suffix, _ in rows:
        at = held[k].tolist()
        x = {n: sum(math.log((counts[n][g] + 0.5) / totals[n]) for g in at) / len(at) * min(len(at), 40) if at else 0.0 for n in names}
        for tag, right in ((declared, 0.9), (suffix, 0.7)):
            if tag in names:
                x = {n: v + math.log(right if n == tag else (1 - right) / max(1, len(names) - 1)) for n, v in x.items()}
        seen[k] = x
        first[k] = max(names, key=lambda n: x[n] + math.log(share[n]))
    out = {}
    for k, _, _, _, host in rows:
        mine = collections.Counter(first[i] for i, *_, h in rows if (h or "") == (host or ""))
        above = collections.Counter(first[i] for i, *_, h in rows if parent(h) == parent(host))
        prior = {n: 20 * (20 * share[n] + above[n]) / (above.total() + 20) + mine[n] for n in names}
        x = {n: v + math.log(prior[n] / (mine.total() + 20)) for n, v in seen[k].items()}
        best = max(names, key=x.get)
        out[k] = best, 1 / sum(math.exp(v - x[best]) for v in x.values())
    return out


@pytest.mark.parametrize("dense", [256, 0])
def test_language_posteriors_match_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    rnd = random.Random(31)
    words = {x: vocabulary(random.Random(k), 12) for k, x in enumerate(("aa", "bb", "cc"))}
    rows = []
    for k in range(90):
        own = rnd.choice(["aa", "aa", "bb", "cc"])
        text = " ".join(rnd.choice(words[own if rnd.random() < 0.7 else "cc"]) for _ in range(rnd.randint(0, 12)))
        rows.append((k, rnd.choice([text, text, None]), rnd.choice([own, own, None, "bb"]), rnd.choice([None, None, "cc", "zz"]), rnd.choice(["a.x.org", "b.x.org", "y.net", "local", None, ""])))
    rows.append((500, " ".join(rnd.choice(words["bb"]) for _ in range(120_000)), None, None, "y.net"))
    fields = "doc_id long, text string, declared string, suffix string, host string"
    df = spark.createDataFrame(rows + rows[:3], fields).withColumn("says", F.lit(1)).withColumn("posterior", F.lit("x")).withColumn("hk", F.lit(2))
    found = langid.identify(df, langid.fit(df.where("doc_id is not null")), ["doc_id", "says", "posterior", "hk"])
    assert found.columns == ["doc_id", "says", "hk", "language", "posterior", "evidence", "likelihood", "declared"]
    got = found.collect()
    expected = brute_languages(rows + rows[:3])
    assert len(got) == len(rows) + 3 and all(r["says"] == 1 and r["hk"] == 2 for r in got)
    assert all(r["language"] == expected[r["doc_id"]][0] and abs(r["posterior"] - expected[r["doc_id"]][1]) < 1e-4 for r in got)


@pytest.mark.parametrize("dense", [256, 0])
def test_language_of_few_rows_is_known(spark, monkeypatch, dense):
    """A language on less than one row in a thousand, and more languages than 200, are found in texts that declare none."""
    monkeypatch.setattr(langid, "DENSE", dense)
    rnd = random.Random(23)
    tags = ["".join(x) for x in itertools.product("abcdefghijkl", repeat=2)][:120] + ["".join(x) for x in itertools.product("mnopqr", repeat=3)][:100]
    words = {t: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9))) for _ in range(25)] for t in tags}
    text = lambda t: " ".join(rnd.choice(words[t]) for _ in range(60))
    rows = [(tags[0], text(tags[0])) for _ in range(7000)] + [(t, text(t)) for t in tags[1:] for _ in range(6)] + [(None, text(t)) for t in tags]
    df = spark.createDataFrame([(k, x, t, None, f"h{k % 3}.example.org") for k, (t, x) in enumerate(rows)], "doc_id long, text string, declared string, suffix string, host string")
    got = {r["doc_id"]: r["language"] for r in langid.identify(df, langid.fit(df), ["doc_id"]).collect()}
    assert [got[k] for k in range(len(rows) - len(tags), len(rows))] == tags
    assert all(got[k] == t for k, (t, _) in enumerate(rows) if t)


def test_pipeline_of_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    toxic = toxic_texts(6, 300)
    rows = [(i, t, "en", "src0", len(t)) for i, t, _ in toxic] + [(1000, toxic[1][1], "en", "src1", 5), (1001, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 1000 not in ids and {1, 2, 3} <= ids
    assert sum(i in ids for i, _, y in toxic if y) <= 5 and sum(i not in ids for i, _, y in toxic if not y) <= 8


CORPUS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_language_stage(spark):
    """Texts that contradict their declared language or that none explains go; clean ones stay, short ones too."""
    import corpus_pipeline

    rnd = random.Random(3)
    words = {"aa": ["kalo", "mira", "tolu", "sena", "peto"], "bb": ["xyzzy", "grunt", "plugh", "fnord", "quux"]}
    text = lambda x, n: " ".join(rnd.choice(words[x]) for _ in range(n))
    rows = [(i, text(x, 30), x, f"s{i % 3}", 1) for i in range(120) for x in [("aa", "bb")[i % 2]]]
    rows += [(500, text("aa", 2), "aa", "s1", 1), (501, text("bb", 40), None, None, 1), (0, rows[0][1], "aa", "s0", 1)]
    bad = [(600, text("bb", 60), "aa", "s1", 1), (601, "αβγδ εζηθ ικλμ νξοπ " * 20, None, "s1", 1), (602, None, "aa", "s1", 1), (603, "", None, None, None), (604, "12 ..", "bb", "s2", 1)]
    docs = spark.createDataFrame(rows + bad, CORPUS)
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_pipeline_of_an_empty_corpus(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], CORPUS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_of_copies_and_repeats(spark):
    import corpus_pipeline

    one, two = "one two three four five six seven eight nine ten " * 3, "z" * 120 + " y " * 50
    docs = spark.createDataFrame([(1, one, "en", "a", 1), (2, one, "en", "b", 1), (2, one, "en", "b", 1), (3, two, "en", "a", 1), (4, "x" * 130 + two, "en", "a", 1), (5, None, None, None, None), (6, "", "en", "a", 0)], CORPUS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    left = {r["doc_id"]: r for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert left[1]["text"] == one and left[2]["text"] == "" and left[5]["text"] == "" and left[4]["n_chars"] == len(left[4]["text"]) < 130 + len(two)
    assert left[4]["source"] == "a" and left[4]["lang"] == "en"
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r["length"] for r in packed if r["doc_id"] in (5, 6)) == 2
