"""From raw documents to packed training sequences: stages, each over all that the one before kept."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, minhash, packing, suffix
from graphloom.llm import toxicity as toxic
from graphloom.llm.common import Stage, few, table

#: Trigrams and probability from which on a text is held to be in another language than it declares.
EVIDENCE, SURE = 40, 0.99
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on `labels`, calls toxic; repeated rows are judged alike, null and empty texts stay."""
    raw = spark.read.parquet(table(sf_dir, "documents"))
    model = toxic.fit(raw, spark.read.parquet(table(sf_dir, "labels")))
    return toxic.toxicity(docs.select(COLUMNS), model).where("toxicity_label = 0").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents by what their text says of its language; `lang` is what the model is fitted on, and no evidence.

    Gone are documents without letters (null and empty texts too), those that no language explains
    better than even chance does (foreign scripts, random characters), and those of at least
    EVIDENCE trigrams whose text and source give another language than the declared one with a
    probability of SURE or more. Where no document declares a language, nothing is known of
    languages, and only documents without letters go. The source takes the place of the host.
    Repeated rows are judged alike.
    """
    carried = [F.col(c).alias(f"own_{c}") for c in COLUMNS if c != "text"]
    rows = docs.select("text", langid.declared("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), *carried)
    unsaid = rows.withColumn("said", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    known = langid.identify(unsaid, langid.fit(rows), ["said", "text", *(f"own_{c}" for c in COLUMNS if c != "text")])
    lettered = F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    explained = F.col("language").isNull() | (F.col("likelihood") >= -math.log(langid.BUCKETS))
    other = F.coalesce((F.col("language") != F.col("said")) & (F.col("posterior") >= SURE) & (F.col("evidence") >= EVIDENCE), F.lit(False))
    return known.where(lettered & explained & ~other).select(*(F.col(c if c == "text" else f"own_{c}").alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates; those without words, and rows with a null doc_id, stay, and so do all rows of a doc_id that is kept."""
    gone = Stage(spark, "near").keep(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    return docs.join(few(gone), "doc_id", "left_anti").select(COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 100 bytes that occur earlier; documents stay, if only with an empty text."""
    left = suffix.remove_repeats(docs, with_text=True, carry=("lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens; of empty texts and repeated rows too."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", pack),
]

#: SQL cannot express the classifiers, the sketches or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again, and what no later stage reads is deleted."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for number, (_, step) in enumerate(STAGES, 1):
        before = len(Stage.written)
        docs = stage.keep(step(spark, docs, sf_dir))
        Stage.forget(spark, before)
        if number > 1:
            stage.drop(number - 1)
    return docs
