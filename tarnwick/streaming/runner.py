"""Micro-batches with durable state (STM-05/06/09, STM-01): the scan as a stream.

A file source feeds snapshots; each micro-batch is upserted into a table of hashed
buckets, of which it rewrites those it touches. Its commit row is written last, so a
batch that died before is run again and one that finished is skipped. Miss counters
are per-key state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tarnwick import scratch
from tarnwick.operators.upsert import TableSpec, upsert


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _commits(spark: SparkSession, root: str) -> DataFrame:
    if _exists(spark, f"{root}/_commits"):
        return spark.read.schema("version long").parquet(f"{root}/_commits")
    return spark.createDataFrame([], "version long")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions of a table, from its commit rows."""
    return sorted(r["version"] for r in _commits(spark, root).collect())


def _manifest(spark: SparkSession, root: str, version: int | None) -> dict[int, str]:
    """Bucket -> folder of a version; there are as many rows as buckets."""
    if version is None:
        return {}
    return {r["bucket"]: r["path"] for r in spark.read.schema("bucket int, path string").parquet(f"{root}/_manifests/v={version}").collect()}


def _read(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    return spark.read.parquet(*paths) if paths else None


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The table as of its last (or a given) commit: the folders that its manifest names, whatever is being written."""
    last = _commits(spark, root).agg(F.max("version")).first()[0] if version is None else version
    return None if last is None else _read(spark, sorted(_manifest(spark, root, last).values()))


def commit_batch(root: str, spec: TableSpec, order: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one new version per batch id; a replayed id changes nothing.

    Rows are dealt into buckets by a hash of their key. A batch reads and rewrites the
    buckets that its keys are in and no others; its manifest names the new folders and,
    for all other buckets, the old ones. The commit row comes last and points at the
    manifest, so a reader sees one version and a batch that died is written again over
    what it left. Of several rows of a key in a batch the one with the largest order
    stays, then the largest by all columns of the table. The number of buckets is fixed
    by the first commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = _commits(spark, root)
        if not done.where(F.col("version") == number).isEmpty():
            return
        held = _manifest(spark, root, done.agg(F.max("version")).first()[0])
        bucket = F.pmod(F.xxhash64(spec.key), F.lit(buckets)).cast("int")
        given = [c for c in spec.columns if c in batch.columns]
        row = F.struct(*[c for c in batch.columns if c != spec.key])
        rank = F.struct(*([order] if order else []), *given)
        latest = scratch.table(spark, batch.groupBy(spec.key).agg(F.max_by(row, rank).alias("row")).select(spec.key, "row.*").withColumn("__bucket", bucket), "batch")
        touched = sorted(r["__bucket"] for r in latest.select("__bucket").distinct().collect())
        old = _read(spark, [held[b] for b in touched if b in held])
        fresh = upsert(latest.select(*spec.columns).limit(0) if old is None else old, latest.drop("__bucket"), spec).drop("change").withColumn("__bucket", bucket)
        folder = f"{root}/data/v={number}"
        fresh.repartition(max(1, len(touched)), "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(folder)
        named = held | {b: f"{folder}/__bucket={b}" for b in touched}
        spark.createDataFrame(sorted(named.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifests/v={number}")
        spark.range(number, number + 1).select(F.col("id").alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/_commits")
        scratch.drop(spark, latest)

    return write


def start_upserts(stream: DataFrame, root: str, spec: TableSpec, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(commit_batch(root, spec)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MissCounter(StatefulProcessor):
    """STM-01 for one appearance: its misses and the last one's time as value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("misses", "misses long, last double")

    def handleInitialState(self, key: tuple[Any, ...], initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[-1]
        self.kept.update((int(row["misses"]), None if pd.isna(row["last_missing_at"]) else row["last_missing_at"].timestamp()))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        misses, last = self.kept.get() if self.kept.exists() else (0, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            if row.seen:
                misses, last = 0, None
            elif row.eligible and (last is None or row.at.timestamp() - last >= 12 * 3600):
                misses, last = misses + 1, row.at.timestamp()
            out.append((key[0], row.at, misses, "CLOSED" if misses >= 3 else "POSSIBLY_CLOSED" if misses >= 2 else "ACTIVE"))
        self.kept.update((misses, last))
        yield pd.DataFrame(out, columns=["appearance_uid", "at", "misses", "state"])

    def close(self) -> None:
        pass


def miss_stream(presence: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """STM-01 as a stateful operator: (appearance_uid, at, seen, eligible) -> misses and state after each row.

    A miss counts if the snapshot is eligible and the last one is at least 12 hours back.
    A stream that starts afresh takes up the counters of committed (appearance_uid,
    misses, last_missing_at), one row an appearance; a restarted one has its own state.
    """
    presence.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    initial = None if committed is None else committed.select("appearance_uid", F.coalesce("misses", F.lit(0)).cast("long").alias("misses"), F.col("last_missing_at").cast("timestamp").alias("last_missing_at")).groupBy("appearance_uid")
    return presence.groupBy("appearance_uid").transformWithStateInPandas(MissCounter(), "appearance_uid string, at timestamp, misses long, state string", "append", "None", initial)
