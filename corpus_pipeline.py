"""The corpus pipeline: documents in, packed training sequences out, in five stages that are each written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm import langid, neardup, packing, pii, quality
from provgraph.llm.common import unused
from provgraph.session import materialize, read_table, scratch_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with a calibrated score that isn't rejected."""
    return langid.filter_languages(docs, langid.fit_languages(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the compression bands, which the good ones of the labels table set."""
    return quality.filter_quality(docs, quality.fit_bands(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Rows that repeat an id are told apart by their texts; of rows that repeat both one stays. Rows without an id are in no
    group and stay.
    """
    least = neardup.near_duplicates(docs).where("doc_id is not null and kept and text_key = component_text").select("doc_id", "text_key")
    keep = materialize(least.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies")))
    ids = [unused(docs, "_id"), unused(docs, "_text")]
    kept = docs.join(keep.select(*(F.col(c).alias(i) for c, i in zip(("doc_id", "text_key"), ids))).hint("merge"), (F.col("doc_id") == F.col(ids[0])) & (F.xxhash64("text") == F.col(ids[1])), "left_semi")
    if not keep.where("copies > 1").isEmpty():
        kept = kept.withColumn(ids[1], F.xxhash64("text")).dropDuplicates(["doc_id", ids[1]]).drop(ids[1])
    return kept.unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and secrets masked."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens as pieces of sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The stages need trained models, sketches and a search, which SQL can't express; tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and reread."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{scratch_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
