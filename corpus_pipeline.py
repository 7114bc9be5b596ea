"""A training corpus from raw documents: language, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import jaccard, lang_id, packing, suffix_dedup, toxicity
from tracewell.llm.common import digest_bucket, materialize, table
from tracewell.session import ship_package

#: Passages of over 50 words that repeat go, besides strings of 400 bytes.
PASSAGE_WORDS = 51
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts without letters go, and those for which no language is likelier than not.

    Null and empty texts go; rows that repeat an id or have none are judged each by their text; an empty table gives none.
    """
    ship_package(spark)
    model = lang_id.fit(docs, digest_bucket(F.col("doc_id"), 4) != 2)
    found = docs.withColumn("_p", lang_id.language_column(model, "text"))
    return found.filter((F.col("_p.lang") != lang_id.UNDETERMINED) & (F.col("_p.score") >= 0.5)).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic by a model of the labelled ones.

    Null and empty texts stay; rows that repeat an id or have none are judged each by their text; an empty table gives none.
    """
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), digest_bucket(F.col("doc_id"), 5) != 0)
    return docs.withColumn("_s", toxicity.score_column(model, "text")).filter(F.col("_s") < 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, the one of the smallest id.

    Rows whose id is null or repeated are documents by their id and text: equal ones are one, different ones stay unless
    they link, and in a group with others one of them is the one that stays. Texts without words link with nothing.
    """
    odd = materialize(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_odd")), "ids")
    keyed = docs.withColumn("_key", F.col("doc_id"))
    if odd.take(1):
        by_text = -1 - F.abs(F.shiftright(F.xxhash64("doc_id", "text"), 1))
        keyed = docs.hint("merge").join(odd, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_key", F.when(F.col("_odd"), by_text).otherwise(F.col("doc_id")))
    parts = jaccard.jaccard_components(keyed.select("_key", "text"), "_key")
    others = materialize(parts.filter("component_id <> _key").select("_key").distinct(), "others")
    kept = keyed.hint("merge").join(others, "_key", "left_anti")
    if odd.take(1):
        kept = kept.dropDuplicates(["_key"])
    return kept.select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated strings of 400 bytes and repeated passages of over 50 words; characters cut in two go with
    them, and so do documents of which nothing is left.

    Null and empty texts go; rows that repeat an id or have none are texts each; an empty table gives none.
    """
    left = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, words=PASSAGE_WORDS).withColumn("text", F.col("kept"))
    return left.filter(F.length("text") > 0).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences. Null and empty texts take a separator's place; repeated rows are packed each."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", pack)]

#: Learned models, components and packing can't be put in SQL. Tests compare near-duplicates, repeats and packing with
#: brute-force versions, and language and toxicity with the models' own scores and the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
