"""From raw documents to packed training sequences: the five stages, each a whole pass over what the last one kept."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import lines, mixing, packing, perplexity, sketch
from velum.llm.shared import cut, drop, settle, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band. Null ids are kept like any other."""
    small_batches(spark)
    counts = cut(perplexity.count(docs))
    scored = cut(perplexity.score(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("__t")), counts))
    kept = perplexity.judge(scored).where("kept").select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), "__t").distinct()
    same = docs["doc_id"].eqNullSafe(kept["__id"]) & docs["lang"].eqNullSafe(kept["__lang"]) & (F.xxhash64(docs["text"]) == kept["__t"])
    return docs.join(kept, same, "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those of which no word is left go.

    Rows without an id are not compared, rows of one id with different texts are. Null texts have no word; repeated rows keep the same lines.
    """
    small_batches(spark)
    kept = lines.deduplicate(docs, lines.SHORTEST, lines.NEAR_SHORTEST).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of five-word shingles): the one with the smallest id, and of its texts the smallest digest.

    Rows of one id with different texts are documents of their own, rows without an id come last and are compared too. Of
    repeated rows one stays, of those that differ in other columns the smallest. Texts without a word are linked with nothing.
    """
    small_batches(spark)
    found = sketch.near_duplicates(docs, k=5, percent=80)
    leaders = found.where("leader").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    kept = docs.join(leaders, docs["doc_id"].eqNullSafe(leaders["__id"]) & (F.xxhash64(docs["text"]) == leaders["__t"]), "left_semi")
    return kept.groupBy(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__t")).agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for.

    Null sources are one source; texts without words have no weight and are taken like others of their source; rows of one id share their coin.
    """
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; repeated rows and null ids are packed like any others, null texts as their end alone."""
    small_batches(spark)
    return packing.query(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: Tokens, sketches and the language model have no SQL form; a test compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, before = settle(partial(stage, spark, docs, sf_dir)), docs
        drop(before)  # nothing reads it any more; the input itself is no such table
    return docs
