"""Toxicity of texts: subword-bag embeddings averaged into a linear softmax, trained here in numpy."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, arrow_map, give_back, mix, span_hashes, text_blocks

GRAMS = (3, 4, 5)
#: Everything but ASCII letters and digits and non-ASCII bytes becomes a space.
_CLEAN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass
class ToxicityModel:
    """`weight`: per n-gram bucket, the difference of the two classes' logits; `bias`: theirs without words;
    `shift`: what calibration takes off a text's logit.

    As the softmax is linear in the average, a bucket's vector times the class weights is all that scoring needs.
    """

    weight: np.ndarray
    bias: float
    shift: float = 0.0


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cleaned bytes of a block of texts, begin and end of every word in them, and the number of words of each text."""
    clean = [b" " + t.decode("utf-8", "replace").lower().encode().translate(_CLEAN) for t in texts]
    sizes = np.array([len(c) for c in clean], np.int64)
    data = np.frombuffer(b"".join(clean) + b" " * 8, np.uint8)
    space = data == 32
    start = (np.flatnonzero(space[:-1] & ~space[1:]) + 1).astype(np.int32 if len(data) < 2**31 else np.int64)
    end = (np.flatnonzero(~space[:-1] & space[1:]) + 1).astype(start.dtype)
    return data, start, end, np.bincount(np.searchsorted(np.cumsum(sizes), start, side="right"), minlength=len(texts))


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and word of the words' n-grams, one length at a time, and of the words themselves, whose hashes are `own`."""
    for n in GRAMS:
        # a gram starts at a word's byte or the space before it and ends at most with the space after it
        many = np.maximum(end - start + 3 - n, 0)
        at = np.repeat(start - 1 - np.cumsum(many, dtype=start.dtype) + many, many) + np.arange(many.sum(), dtype=start.dtype)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | data[at + k]
        yield (mix(value) % np.uint64(buckets)).astype(np.int32), np.repeat(np.arange(len(start), dtype=np.int32), many)
    yield (own % np.uint64(buckets)).astype(np.int32), np.arange(len(start), dtype=np.int32)


def _pairs(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each word the mean of its value and the next word's; the last word of a text has none, unless it is the only one."""
    out = value.copy()
    out[:-1] += value[1:]
    out /= 2
    last = np.cumsum(counts)[counts > 0] - 1
    out[last] = np.where(counts[counts > 0] == 1, value[last], -np.inf)
    return out


def train(texts: list[bytes], labels: np.ndarray, buckets: int = 1 << 16, dim: int = 4, steps: int = 60, seed: int = 7) -> ToxicityModel:
    """Fit bucket vectors and class weights jointly by full-batch descent with momentum.

    Every two neighbouring words, and a word that is alone in its text, are an example. In the
    first third of the steps each has its text's label. Then those of toxic texts count as toxic
    where scored 0.5 or more, and the highest of each always, and no others of theirs are used; of
    other texts each is clean, and those of high scores weigh most. N-grams met in fewer than 3
    texts stay at zero. Without both classes among the labels the model gives all texts one score.
    """
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(buckets, np.float32), 9.0 if labels.any() else -9.0)
    counts, words, grams, share, names = [], [], [], [], np.zeros(0, np.uint64)
    known = names
    for block in _runs(texts):
        data, start, end, many = _words(block)
        own = span_hashes(data, start, end)
        counts.append(many)
        words.append(own)
        new, at = np.unique(own, return_index=True)
        slot = np.searchsorted(known, new)
        at = at[~((slot < len(known)) & (known[np.minimum(slot, len(known) - 1)] == new))] if len(known) else at
        names = np.concatenate((names, own[at]))
        known = np.sort(names)
        for run in (at[k : k + 4096] for k in range(0, len(at), 4096)):
            where, which = (np.concatenate(x) for x in zip(*_grams(data, start[run], end[run], own[run], buckets), strict=True))
            grams.append(where[np.argsort(which, kind="stable")])
            share.append(np.bincount(which, minlength=len(run)).astype(np.int32))
    # run by run, as arrays of all words' n-grams are what takes most memory
    give_back()
    order = np.argsort(names)
    texts_of, met_by = np.zeros(len(names), np.int64), np.zeros(buckets)
    for k, (own, many) in enumerate(zip(words, counts, strict=True)):
        words[k] = order[np.searchsorted(known, own)].astype(np.int32)
        met = np.unique(words[k] * np.int64(len(many)) + np.repeat(np.arange(len(many)), many))
        texts_of += np.bincount(met // len(many), minlength=len(names))
    del known, order
    begin = 0
    for own, each in zip(grams, share, strict=True):
        met_by += np.bincount(own, np.repeat(texts_of[begin : begin + len(each)], each), minlength=buckets)
        begin += len(each)
    usual, held_by = met_by >= 3, []
    for k, (own, each) in enumerate(zip(grams, share, strict=True)):
        held = usual[own]
        held_by.append(np.bincount(np.repeat(np.arange(len(each)), each)[held], minlength=len(each)))
        grams[k] = own[held]
    counts, kind, share, held_by = (np.concatenate(x) for x in (counts, words, share, held_by))
    del words
    grams = np.concatenate(grams)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    live = np.flatnonzero(held_by)  # words with n-grams that are learnt, how many, and where theirs begin and end
    some = held_by[live]
    ends = np.cumsum(some)
    cut = ends - some
    share = share.astype(np.float32)
    lots = [slice(k, k + 32768) for k in range(0, len(live), 32768)]
    last = np.cumsum(counts)[counts > 0] - 1
    used = np.ones(len(kind), bool)
    used[last] = counts[counts > 0] == 1
    used = np.flatnonzero(used).astype(np.int32)
    text = text[used]
    left, right = kind[used], kind[np.where(counts[text] == 1, used, np.minimum(used + 1, len(kind) - 1))]
    del kind, used
    give_back()
    parts = [slice(k, k + PART) for k in range(0, len(text), PART)]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (buckets, dim)).astype(np.float32) * usual[:, None], rng.normal(0, 1, dim).astype(np.float32), np.float32([-2.0])]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    y, weight = labels[text].astype(np.float32), np.ones(len(text), np.float32)
    toxic = labels[text] == 1
    kinds = np.zeros((len(names), dim), np.float32)
    p = np.zeros(len(text), np.float32)
    for step in range(1, steps + 1):
        for lot in lots:
            a, b = cut[lot][0], ends[lot][-1]
            kinds[live[lot]] = np.add.reduceat(params[0][grams[a:b]], cut[lot] - a, axis=0) / share[live[lot], None] * SCALE
        value = kinds @ params[1]
        for part in parts:
            logit = (value[left[part]] + value[right[part]]) / 2 + params[2][0]
            p[part] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if step > steps // 3:
            best = np.zeros(len(counts), np.float32)
            for part in parts:
                np.maximum.at(best, text[part], p[part])
            for part in parts:
                y[part] = toxic[part] & (p[part] >= np.minimum(best[text[part]], 0.5))
                weight[part] = np.where(toxic[part], y[part], np.maximum(p[part], 0.05))
        error = p - y
        error *= weight
        error /= max(1.0, y.sum())
        error /= 2
        toward = np.bincount(left, error, minlength=len(names))
        toward += np.bincount(right, error, minlength=len(names))
        toward *= SCALE
        each, down = toward / share, np.zeros(buckets)
        for lot in lots:
            a, b = cut[lot][0], ends[lot][-1]
            down += np.bincount(grams[a:b], np.repeat(each[live[lot]], some[lot]), minlength=buckets)
        down = down.astype(np.float32)
        grads = [down[:, None] * params[1][None, :], (toward / SCALE @ kinds).astype(np.float32), np.float32([2 * error.sum()])]
        for k, (x, grad) in enumerate(zip(params, grads, strict=True)):
            moments[k][0] += 0.2 * (grad - moments[k][0])
            moments[k][1] += 0.05 * (grad * grad - moments[k][1])
            size_of = np.sqrt(moments[k][1] / (1 - 0.95**step))
            x -= RATE[k] * moments[k][0] / (1 - 0.8**step) / (size_of + FLOOR * size_of.max() + 1e-12)
        params[0] *= DECAY
    return ToxicityModel((params[0] @ params[1] * SCALE).astype(np.float32), float(params[2][0]))


#: Step sizes of the vectors, the class weights and the bias.
RATE = (0.5, 0.1, 0.2)
#: Gradients under this share of the largest move a value less, so that what few texts hold is learned late or not at all.
FLOOR = 0.03
#: What a step leaves of the vectors, against what few texts taught.
DECAY = np.float32(0.97)
#: Times the averaged vector, as averages over n-grams are small.
SCALE = np.float32(4.0)


#: Examples whose scores are reckoned at once.
PART = 1 << 17


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    for _, _, block in text_blocks(pa.array(texts, pa.binary())):
        yield block


def score_texts(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    """The probability of the toxic class in the two neighbouring words of each text where it is highest."""
    out = []
    for _, _, block in text_blocks(texts):
        data, start, end, counts = _words(block)
        logit = np.full(len(block), min(model.bias, -4.0))
        if len(start):
            own = span_hashes(data, start, end)
            names, at, kind = np.unique(own, return_index=True, return_inverse=True)
            total, many = np.zeros(len(names)), np.zeros(len(names))
            for where, which in _grams(data, start[at], end[at], names, len(model.weight)):
                total += np.bincount(which, model.weight[where], minlength=len(names))
                many += np.bincount(which, minlength=len(names))
            some = np.flatnonzero(counts)
            begins = (np.cumsum(counts) - counts)[some]
            logit[some] = np.maximum(logit[some], np.maximum.reduceat(_pairs((total / many)[kind], counts), begins) + model.bias)
        out.append(1 / (1 + np.exp(-np.clip(logit - model.shift, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def misspelt(texts: list[bytes], seed: int = 5) -> list[bytes]:
    """The texts with a slip in every word of five letters and more: a letter left out, two swapped or one doubled, never the first."""
    rng = random.Random(seed)

    def slip(found: re.Match) -> str:
        word = found.group()
        at, kind = rng.randrange(1, len(word) - 1), rng.randrange(3)
        return word[:at] + (word[at + 1 :], word[at + 1] + word[at] + word[at + 2 :], word[at] + word[at:])[kind]

    return [_LONG.sub(slip, t.decode("utf-8", "replace")).encode() for t in texts]


#: A word of five letters and more.
_LONG = re.compile(r"[^\W\d_]{5,}")


def calibrated(texts: list[bytes], labels: np.ndarray) -> ToxicityModel:
    """Train on four texts of five and misspelt copies of them; set the shift so that 0 parts the classes of the fifth well.

    With the copies, n-grams that words share with their misspellings must carry what a word says.
    The shift is the mean of all cuts between its scores, those that part it best weighing most.
    """
    rest = np.arange(len(texts)) % 5 == 4
    own = [t for t, r in zip(texts, rest, strict=True) if not r]
    model = train(own + misspelt(own), np.concatenate((labels[~rest], labels[~rest])))
    texts, y = [t for t, r in zip(texts, rest, strict=True) if r], labels[rest]
    if len(set(y.tolist())) < 2 or not model.weight.any():
        return model
    p = np.clip(score_texts(model, pa.array(texts, pa.binary())), 1e-12, 1 - 1e-12)
    logit = np.log(p / (1 - p))
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    right = np.cumsum(y == 0)[:-1] + (y == 1).sum() - np.cumsum(y == 1)[:-1]
    share = np.diff(logit) * np.exp(right - right.max())
    model.shift = float((share * (logit[1:] + logit[:-1]) / 2).sum() / share.sum()) if share.sum() > 0 else float(logit.mean())
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_bytes: int = 16 << 20) -> ToxicityModel:
    """Train on at most `sample` labelled rows of together at most `sample_bytes` of text, those of the smallest hash of doc_id.

    Held-out rows never take part. Labels that are null are left out; of several labels of one
    document the largest counts. Rows of a repeated doc_id each count. Only the bounded sample reaches the driver, where it is trained.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("doc_id")).select("doc_id", "toxic", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(sample)
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    digest = F.sha2("text", 256).alias("digest")
    order = ["place", "doc_id", "toxic", "digest"]
    rows = Stage(docs.sparkSession, "labelled").keep(docs.select("doc_id", text.alias("text")).join(F.broadcast(marks), "doc_id").select("*", digest))
    # the first rows by their lengths alone, then the texts of those
    first = rows.select(*order, F.octet_length("text").alias("bytes")).orderBy(*order).limit(sample).toPandas()
    first = first[first["bytes"].cumsum() <= sample_bytes]
    if not len(first):
        return calibrated([], np.zeros(0, np.int64))
    last = [F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(order, first[order].to_numpy(object)[-1].tolist(), strict=True)]
    found = rows.where(F.struct(*order) <= F.struct(*last)).orderBy(*order).limit(len(first)).select("text", "toxic").toArrow()
    texts, toxic = found.column("text").to_pylist(), found.column("toxic").to_numpy().astype(np.int64)
    del found
    give_back()
    model = calibrated(texts, toxic)
    give_back()
    return model


def held_out(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` and the columns toxicity_score (0 to 1) and toxicity_label (1 from 0.5 on).

    Whole texts count: a text scores as its two neighbouring words of the highest average, so a
    word more changes nothing but the one or two averages it takes part in. Null and empty texts
    get the score of a text without words, which is low. An empty table gives no rows. Rows are neither dropped nor merged; other columns pass through, and columns that
    already have the two names are replaced.
    """
    docs = docs.drop("toxicity_score", "toxicity_label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(model, batch.column(batch.schema.get_field_index("text")))
            extra = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "toxicity_score", "toxicity_label"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(docs, work, f"{fields}, toxicity_score double, toxicity_label int")
