"""Registered queries of the training-data operators: one opN_<name> for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_topk, jaccard, lang_id, main_text, ordered_packing, packing, prefix_trie, spelling, sql, suffix_dedup, token_counts, toxicity, transport_stream
from .common import digest_bucket, table
from .vocab import byte_ranks, english_path, multi_path, pretoken_pattern

VOCABULARY = "byte_bpe_multi_50k"
PASSAGE_WORDS = 51


def _n_bytes(text: str = "text"):
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = digest_bucket(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train)
    scored = docs.select("doc_id", (~train).alias("held_out"), toxicity.score_column(model, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", transport_stream.digest_column("text").alias("m"))
    return docs.select("doc_id", "m.*")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@lru_cache(maxsize=2)
def _longest_match(path: str) -> token_counts.LongestMatch:
    return token_counts.LongestMatch(list(byte_ranks(path)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = token_counts.count_column(_longest_match(multi_path()), "text", VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", count.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = digest_bucket(F.col("doc_id"), 4) != 2
    model = lang_id.fit(docs, train)
    found = docs.select("doc_id", (~train).alias("held_out"), lang_id.language_column(model, "text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@lru_cache(maxsize=2)
def _codec(path: str) -> byte_bpe.ByteBpe:
    return byte_bpe.ByteBpe(byte_ranks(path), pretoken_pattern())


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = byte_bpe.round_trip_column(_codec(multi_path()), "text", VOCABULARY)
    return table(spark, sf_dir, "documents").select("doc_id", both.alias("b")).select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text.main_text_column("html").alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns are of strings of 400 bytes; n_passage_bytes also tells how many bytes lie in passages of over 50 words that repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, words=PASSAGE_WORDS, mark_words=True).select(
        "doc_id",
        _n_bytes().alias("n_bytes"),
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("n_passage").alias("n_passage_bytes"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_packing.pack_in_order(table(spark, sf_dir, "documents"), english_path())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_media_ts, op3_exact_topk, op4_packing, op5_token_counts, op6_lang_id, op7_byte_bpe, op8_jaccard_join, op9_main_text, op10_suffix_dedup, op11_spelling, op12_ordered_packing, op13_prefix_trie)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": sql.EXACT_TOPK, "op11_spelling": sql.SPELLING, "op13_prefix_trie": sql.PREFIX_TRIE}
