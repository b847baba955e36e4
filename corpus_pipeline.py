"""The corpus pipeline: five stages over documents, each stored before the next reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.llm import bpe, decontaminate, neardup, passages, quality
from tarnwick.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_READ = ("doc_id", "text", "n_chars")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with its other columns under private names, so that no operator's result replaces one."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in _READ else f"__own_{n}") for n, c in enumerate(docs.columns)])


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names, without an operator's results."""
    return done.select(*[F.col(c if c in _READ else f"__own_{n}").alias(c) for n, c in enumerate(docs.columns)])


def _with_text(done: DataFrame, docs: DataFrame, changed: F.Column, text: F.Column) -> DataFrame:
    """text where it changed, with its length as n_chars if docs has that column."""
    new = done.withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _back(new, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go; the trees learn from the whole documents table.

    Null and empty texts have no words and go. Repeated rows are judged alike. Columns
    with the name of a result are kept as they are. No documents, no rows.
    """
    trees = quality.fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return _back(quality.judge_quality(_aside(docs), trees).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: SimHash components whose five-word shingles are alike by 0.8 or more.

    Null, empty and blank texts are one group. The least doc_id stays, a null one only
    if the group has no other; of rows that share id and text the least by all columns.
    Extra columns pass through. No documents, no rows.
    """
    scratch.sweep(spark)  # the stage before has been stored
    return neardup.keep_one(spark, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages are cut out of texts; n_chars follows.

    Null and empty texts stay as they are; repeated rows lose every window. Columns with
    the name of a result are kept as they are. No documents, no rows.
    """
    scratch.sweep(spark)
    cut = passages.dedup_passages(spark, _aside(docs))
    return _with_text(cut, docs, F.col("n_removed") > 0, F.col("kept_text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, n_chars follows; documents that are mostly benchmark go.

    Null and empty texts have no hit and stay. Repeated rows are cut alike. Columns with
    the name of a result are kept as they are. No documents, no rows.
    """
    scratch.sweep(spark)
    marked = decontaminate.mark_contamination(spark, _aside(docs), read_table(spark, sf_dir, "benchmark"))
    left = decontaminate.remove_contamination(marked)
    return _with_text(left, docs, F.size("hit_spans") > 0, F.col("text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests that show that they decode to it.

    Null and empty texts have no ids; repeated rows are encoded alike. Columns with the
    name of a result are replaced, others pass through. No documents, no rows.
    """
    scratch.sweep(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality_rules), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminated), ("byte-level BPE", encoded)]

#: The trees' verdicts and the hashes cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored in the shared folder and read again."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch.shared_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.drop(spark, before)
        before = path
    return docs
