"""Language of texts by Bayesian fusion of what the text, the markup, the address and the host say."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, arrow_map, mix, text_blocks
from .html import host

#: Country endings of addresses that mostly one language uses.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en"}
BUCKETS, ORDER = 1 << 15, 3


#: Languages up to which a worker holds the whole table of likelihoods; beyond it holds the trigrams that were counted.
DENSE = 256


@dataclass
class LanguageModel:
    """Log likelihoods of hashed byte trigrams by language, as far as they differ from an unseen one's.

    `unseen`: log likelihood of a trigram that the language was not seen with; `begins`, `which`,
    `gains`: of bucket b the languages that hold it are which[begins[b]:begins[b + 1]], and gains
    what it adds to `unseen` in them; `prior`: of the languages.
    """

    languages: list[str]
    unseen: np.ndarray
    begins: np.ndarray
    which: np.ndarray
    gains: np.ndarray
    prior: np.ndarray

    def table(self) -> np.ndarray | None:
        """(buckets, languages), if there are few languages."""
        if len(self.languages) > DENSE:
            return None
        out = np.zeros((BUCKETS, len(self.languages)), np.float32)
        out[np.repeat(np.arange(BUCKETS), np.diff(self.begins)), self.which] = self.gains
        return out

    def score(self, at: np.ndarray, table: np.ndarray | None) -> np.ndarray:
        """Per language the mean log likelihood of a text's trigrams, which are not none."""
        if len(at) > BUCKETS or table is None:
            count = np.bincount(at, minlength=BUCKETS)
            held = np.flatnonzero(count)
            if table is not None:
                return self.unseen + count[held] @ table[held] / len(at)
            sizes = self.begins[held + 1] - self.begins[held]
            place = np.repeat(self.begins[held] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            return self.unseen + np.bincount(self.which[place], self.gains[place] * np.repeat(count[held], sizes), len(self.languages)) / len(at)
        return self.unseen + table[at].mean(axis=0, dtype=np.float64)


def _trigrams(data: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text without digits and marks, word borders included."""
    clean = b" " + data.decode("utf-8", "replace").lower().encode().translate(_LETTERS) + b" "
    x = np.frombuffer(b" ".join(clean.split()).join((b" ", b" ")), np.uint8).astype(np.uint64)
    if len(x) < ORDER:
        return np.zeros(0, np.int64)
    return (mix(x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)


_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def declared(column: str) -> Column:
    """The primary subtag of a declared language, such as `de` of `de-AT`; null where it is not one."""
    tag = F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9]+)*\s*$", 1))
    return F.when(tag != "", tag)


def fit(texts: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Count the trigrams of all rows (text, declared) by declared language; every language that any row declares is known.

    A language of little text stays near the even likelihoods of the smoothing, so it takes no
    others' texts. Each block of texts adds up its own counts, so a language of most rows is no
    hot key. The model holds the counts that are not zero. Rows without a declared language teach
    nothing; where no row has one the model knows no language.
    """
    rows = texts.where("declared is not null").groupBy("declared").count().collect()
    usual = {r["declared"]: r["count"] for r in rows}
    languages = sorted(usual)
    place = {x: k for k, x in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_pylist()
            for first, _, block in text_blocks(batch.column(0)):
                found = [place[own[first + k]] * BUCKETS + _trigrams(text) for k, text in enumerate(block) if own[first + k] is not None]
                at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["at", "n"])

    found = arrow_map(texts.select("text", "declared"), work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    at, n = found["at"].to_numpy(np.int64), found["n"].to_numpy(float)
    order = np.lexsort((at // BUCKETS, at % BUCKETS))
    which, bucket, n = at[order] // BUCKETS, at[order] % BUCKETS, n[order]
    totals = np.bincount(which, n, len(languages)) + smoothing * BUCKETS
    prior = np.array([usual[x] for x in languages], float)
    return LanguageModel(languages, np.log(smoothing / totals), np.searchsorted(bucket, np.arange(BUCKETS + 1)), which.astype(np.int32), np.log1p(n / smoothing).astype(np.float32), np.log(prior / prior.sum()))


def identify(rows: DataFrame, model: LanguageModel, keep: list[str], trust: float = 0.9, strength: float = 20.0, effective: float = 40.0) -> DataFrame:
    """`keep`, language, posterior (of it), evidence (trigrams read), likelihood and declared of every row.

    `likelihood` is the mean log likelihood of the text's trigrams in that language, null where
    the text has none: what the text alone says, beside the relative posterior. Kept columns may
    have any name; one that is named like a result is left out, the result takes its place. An
    empty table gives no rows.

    `rows` has text, declared, suffix (a language or null) and host. Per language the log
    posterior is the sum of: the host's prior; the text's mean log likelihood times its trigrams,
    of which at most `effective` count as independent; the log probability of the declared
    language and of the suffix, each right with probability `trust` or 0.7.

    A host's prior is its counts of languages that the other evidence finds likeliest, smoothed
    with `strength` rows of its parent domain's shares, those with `strength` rows of all rows'
    shares. The counts are grouped by host and language, so partial aggregation takes a host of
    any size. Texts are read twice, for the counts and with them, so that no row's scores are
    stored, whose length is the number of languages. Null and empty texts and those without
    letters have only the other evidence; where the model knows no language, language and
    posterior are null. Rows are kept whole, repeated ones too.
    """
    stage = Stage(rows.sparkSession, "language")
    names = model.languages
    keep = [c for c in keep if c not in RESULTS]
    if not names:
        nothing = [F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(0).cast("long").alias("evidence"), F.lit(None).cast("double").alias("likelihood")]
        return rows.select(*keep, *nothing, "declared")
    place = {x: k for k, x in enumerate(names)}
    other = max(1, len(names) - 1)

    def likely(batch: pa.RecordBatch, table: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Trigrams, their mean log likelihood by language and all evidence's of each row, whose first columns are text, declared and suffix."""
        said = [(batch.column(k).to_pylist(), right) for k, right in ((1, trust), (2, 0.7))]
        for first, _, block in text_blocks(batch.column(0)):
            for k, text in enumerate(block):
                at = _trigrams(text)
                mean = model.score(at, table) if len(at) else np.zeros(len(names))
                out = mean * min(len(at), effective)
                for tags, right in said:
                    own = place.get(tags[first + k])
                    if own is not None:
                        out += np.log((1 - right) / other)
                        out[own] += np.log(right) - np.log((1 - right) / other)
                yield len(at), mean, out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            first = [int((x + model.prior).argmax()) for _, _, x in likely(batch, table)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(first, pa.int32())], ["host", "k"])

    rows = rows.withColumn("host", F.coalesce("host", F.lit("")))
    counts = arrow_map(rows.select("text", "declared", "suffix", "host"), count, "host string, k int").groupBy("host", "k").agg(F.count(F.lit(1)).alias("n"))
    counts = stage.keep(counts.withColumn("parent", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)))
    hosts = counts.groupBy("host", "parent").agg(F.collect_list("k").alias("hk"), F.collect_list("n").alias("hn"))
    parents = counts.groupBy("parent", "k").agg(F.sum("n").alias("n")).groupBy("parent").agg(F.collect_list("k").alias("pk"), F.collect_list("n").alias("pn"))
    hosts, parents = stage.keep(hosts), stage.keep(parents)
    # else joined by host and parent, where Spark splits a hot one
    hosts, parents = (F.broadcast(x) if x.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0] <= 800_000 else x for x, c in ((hosts, "hk"), (parents, "pk")))
    carried = [c for c in keep if c != "text"]
    inner = [f"_kept_{k}" for k in range(len(carried))]
    share = np.exp(model.prior)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            lists = [batch.column(k).to_pylist() for k in (3, 4, 5, 6)]
            language, posterior, grams, likelihood = [], [], [], []
            for (n, mean, x), hk, hn, pk, pn in zip(likely(batch, table), *lists, strict=True):
                above = strength * share
                above[pk] += pn
                prior = above * (strength / (sum(pn) + strength))
                prior[hk] += hn
                x += np.log(prior / (sum(hn) + strength))
                best = int(x.argmax())
                language.append(names[best])
                posterior.append(float(1 / np.exp(x - x[best]).sum()))
                grams.append(n)
                likelihood.append(float(mean[best]) if n else None)
            columns = [pa.array(language, pa.string()), pa.array(posterior, pa.float64()), pa.array(grams, pa.int64()), pa.array(likelihood, pa.float64()), batch.column(1), *([batch.column(0)] if "text" in keep else []), *batch.columns[7:]]
            yield pa.RecordBatch.from_arrays(columns, [*RESULTS, *(["text"] if "text" in keep else []), *inner])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(["language string, posterior double, evidence long, likelihood double, declared string", *(["text string"] if "text" in keep else []), *(f"`{n}` {kinds[c]}" for n, c in zip(inner, carried, strict=True))])
    bare = rows.select("text", "declared", "suffix", "host", *(F.col(f"`{c}`").alias(n) for n, c in zip(inner, carried, strict=True)))
    met = bare.join(hosts, "host").join(parents, "parent").select("text", "declared", "suffix", "hk", "hn", "pk", "pn", *inner)
    held = dict(zip(carried, inner, strict=True)) | {"text": "text"}
    return arrow_map(met, fuse, schema).select(*(F.col(held[c]).alias(c) for c in keep), *RESULTS)


#: What `identify` adds.
RESULTS = ["language", "posterior", "evidence", "likelihood", "declared"]


def of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, declared, suffix, host) of web pages: the visible text without tags, and the markup's and address's evidence."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    tag = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    ending = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    by_suffix = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    rows = pages.select("page_id", "url", F.coalesce(bare, F.lit("")).alias("text"), tag.alias("tag"), host("url").alias("host"))
    return rows.select("page_id", "url", "text", declared("tag").alias("declared"), F.try_element_at(by_suffix, ending).alias("suffix"), "host")
