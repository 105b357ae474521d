"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame, each on the operator of its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination, text_key
from .language_id import identify
from .near_dup import near_duplicates
from .packing import pack, tokenised_pieces
from .runtime import bounded, staged, table
from .substring_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: texts that are null or without a letter go, and only these. Without any labelled
    row all others stay. Repeated rows are judged each; an empty table gives no rows."""
    others = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    told = identify(docs, rows=docs.select("doc_id", "text", others.alias("others")), extra=("text", "others"))
    return told.where("has_letter").select("doc_id", "text", "others.*").select(docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null ids last). Rows are judged by
    doc_id and text, so null or repeated ids don't matter; of repeated rows one stays, if any is to be kept. Null texts
    and texts without words all stay. An empty table gives no rows."""
    judged = near_duplicates(docs, hashes=True).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    judged = judged.agg(F.count(F.when(F.col("keep"), 1)).alias("kept"), F.count("*").alias("n"))
    judged = staged(judged.where("kept < n"), "judged")
    own = lambda: F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    once = docs.join(bounded(judged.select("__id", "__hash")), own(), "left_anti").select(docs.columns)
    again = docs.join(bounded(judged.where("kept > 0").select("__id", "__hash")), own(), "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return once.unionAll(again)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document of a smaller doc_id holds too. Rows of null id are one document
    after all others; null and empty texts stay as they are; repeated rows lose the same; an empty table gives no rows."""
    return remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows are judged by their texts, so null or repeated ids don't matter;
    null and empty texts stay. An empty table gives no rows."""
    judged = contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = staged(judged.where("contaminated").select(F.col("key.a").alias("__a"), F.col("key.b").alias("__b")).distinct(), "contaminated")
    own = text_key(docs["text"])
    return docs.join(bounded(hit), (own["a"] == F.col("__a")) & (own["b"] == F.col("__b")), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens. A null or empty text is a piece of one
    token; repeated rows are packed each; null ids are kept; an empty table gives no rows."""
    import public_tokenizers

    return pack(tokenised_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
