"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Rows are told
apart by doc_id and a hash of their text; rows that agree in both count as one document repeated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import arrow, exact_dedup, metric_join, mixing, pieces, ppm_language, scratch

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(df: DataFrame, doc_id: str, text_hash: Column) -> DataFrame:
    """Adds _a and _b, never null, that tell rows apart: joins and windows over them need one shuffle."""
    own = F.col(doc_id)
    return df.withColumn("_a", F.coalesce(own.cast("long"), F.lit(0))).withColumn("_b", F.xxhash64(text_hash, own.isNull()))


def _matched(docs: DataFrame, decided: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of docs that have a row in ``decided`` (doc_id, text_hash, and more), with what that has more."""
    return _keyed(docs.select(*DOCUMENTS), "doc_id", arrow.text_hash(F.col("text"))).join(_keyed(decided, "doc_id", F.col("text_hash")).drop("doc_id", "text_hash"), ["_a", "_b"], how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that stands out, go."""
    train = F.coalesce(ppm_language.crc_remainder(F.col("doc_id"), 5) != 0, F.lit(False))
    model = ppm_language.fit(docs, text_col="text", lang_col="lang", id_col="doc_id", train=train)
    return ppm_language.keep_identified(docs.select(*DOCUMENTS), model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    kept = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", "text_hash").distinct()
    once = F.row_number().over(W.partitionBy("_a", "_b").orderBy("source", "lang", "n_chars"))  # rows that agree in all that counts
    return _matched(docs, kept, "left_semi").withColumn("_once", once).filter("_once = 1").select(*DOCUMENTS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word shingles join, the document with the smallest doc_id (null last) and text hash stays."""
    groups = metric_join.near_duplicates(docs)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    alone = F.when(F.col("group_key").isNull(), own)  # without shingles: linked to nothing
    first = groups.groupBy("group_key", alone.alias("alone")).agg(F.min(own).alias("first")).select("first.doc_id", "first.text_hash")
    return _matched(docs, first, "left_semi").select(*DOCUMENTS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.pareto_mix(docs).filter("copies > 0").groupBy("doc_id", "text_hash").agg(F.max("copies").alias("_copies"))
    return _matched(docs, taken).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*DOCUMENTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text, and whether they decode to it."""
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact-dedup", exact_copies), ("near-dedup", near_copies), ("mixing", mix), ("pieces", tokens)]

#: Model fitting, hashing and tokenizers are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
