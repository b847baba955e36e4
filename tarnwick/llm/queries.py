"""One query per training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.llm import bpe, chat, decontaminate, infill, lines, oracles, passages, quality, sharding, simhash, spelling, tokenfiles, toxicity, warc
from tarnwick.tables import read_table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(spark, docs, read_table(spark, sf_dir, "benchmark"))
    return decontaminate.hit_counts(marked).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SHARDS = [f"shard-{n:03d}" for n in range(64)]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(spark, docs, "doc_id", SHARDS, fallback="text").select("doc_id", "slot", "shard")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, read_table(spark, sf_dir, "documents"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.dedup_passages(spark, docs, keep_text=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "warc")
    warc.write_archives(spark, read_table(spark, sf_dir, "pages"), folder)
    return warc.resolve(warc.assemble(warc.read_records(spark, folder)))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read_table(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(spark, read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_documents(spark, folder, manifest)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge_quality(docs, trees).drop("text")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("fim_text", 256), "restored_sha256": F.sha2(infill.restored(), 256)}
    return made.withColumns(digests).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spark, read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql(SHARDS)
