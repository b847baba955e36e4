"""Replay of user commands against a state machine (WFL-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch
from tarnwick.functions.hashing import digest
from tarnwick.functions.text import plain_text

# The stages of an application in order, and of a referral and an outreach.
STAGES = ("NOT_REVIEWED", "REVIEWING", "READY_TO_APPLY", "SKIPPED", "APPLIED", "OA", "RECRUITER_SCREEN", "TECH_SCREEN", "HM_ROUND", "INTERVIEW_LOOP", "OFFER", "ACCEPTED", "DECLINED", "REJECTED", "WITHDRAWN", "ROLE_CLOSED")
REFERRAL = ("NOT_STARTED", "WARM_CONNECTION_FOUND", "DRAFT_READY", "ASK_SENT", "AGREED", "REFERRED", "DECLINED", "NO_RESPONSE", "NOT_NEEDED", "STOPPED")
OUTREACH = ("DRAFTED", "REVIEWED", "SENT_MANUALLY", "REPLIED", "FOLLOW_UP_DUE", "CLOSED", "DO_NOT_CONTACT")
BEFORE = STAGES[:4]
ENDED = STAGES[11:]
RUNNING = STAGES[4:11]


def allowed(before: str, after: str) -> bool:
    """WFL-02 on one pair, without a reason."""
    if before in ENDED:
        return after == before
    return after not in ("ACCEPTED", "DECLINED") if before in BEFORE else after in RUNNING + ENDED


def transitions(spark: SparkSession) -> DataFrame:
    """WFL-02 as a dimension: every allowed (from_stage, to_stage)."""
    return spark.createDataFrame([(a, b) for a in STAGES for b in STAGES if allowed(a, b)], "from_stage string, to_stage string")


def valid(before: str, after: str, why: str) -> bool:
    if before not in STAGES or after not in STAGES or (after == "SKIPPED" and not why):
        return False
    return True if why.startswith("CORRECTION:") else allowed(before, after)


PAYLOAD = ("job_uid", "application_stage_update", "referral_stage_update", "outreach_stage_update", "update_note", "reason")


def with_identity(commands: DataFrame) -> DataFrame:
    """HSH-07: payload_hash and event_uid of each command, from its cleaned payload."""
    clean = commands.withColumns({f: F.coalesce(plain_text(F.col(f)), F.lit("")) for f in PAYLOAD})
    hashed = clean.withColumn("payload_hash", digest(**{f: F.col(f) for f in PAYLOAD}))
    return hashed.withColumn("event_uid", F.concat(F.lit("action:"), F.sha2(F.concat_ws(":", F.coalesce("row_uid", F.lit("")), "payload_hash"), 256)))


def triage(commands: DataFrame, registrations: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """JON-13: commands with ``result`` where they end before the state machine, else null.

    commands carry row_pos; registrations map row_pos to the row_uid issued for it.
    """
    known = with_identity(commands.where("submit")).join(registrations.select("row_pos", F.col("row_uid").alias("issued")), "row_pos", "left")
    known = known.join(jobs.select("job_uid", F.lit(True).alias("is_job")).distinct(), "job_uid", "left").join(events.select("event_uid", F.lit(True).alias("is_done")).distinct(), "event_uid", "left")
    done = F.coalesce(F.col("processed_payload_hash"), F.lit(""))
    result: Column = F.when(~F.col("issued").eqNullSafe(F.col("row_uid")), "INVALID_ROW_UID").when((done != "") & (done != F.col("payload_hash")), "CHANGED_AFTER_SUBMIT").when(F.col("is_done"), "REPLAY").when(F.col("is_job").isNull(), "UNKNOWN_JOB_UID")
    return known.withColumn("result", result).drop("issued", "is_job", "is_done")


_PLACES = {stage: n for n, stage in enumerate(STAGES)}
#: A stage that is none of STAGES: nothing moves it but a replay of its own name, which is no transition.
_OTHER = len(STAGES)


def _steps(pdf: pd.DataFrame) -> list[tuple[int, list[int]]]:
    """(row_pos, stage after the row for each stage before it) in order; rows that change nothing map each stage to itself."""
    same, out, met = list(range(_OTHER + 1)), [], {}
    for r in pdf.sort_values("row_pos").itertuples():
        key = (r.after, r.why) if r.counts else None
        if key not in met:
            met[key] = same if key is None else [n if n == _OTHER or not valid(STAGES[n], r.after or STAGES[n], r.why) else _PLACES[r.after] if r.after else n for n in same]
        out.append((r.row_pos, met[key]))
    return out


def _stages_before(spark: SparkSession, commands: DataFrame, started: DataFrame) -> DataFrame:
    """(row_pos, before): the stage that each command finds.

    A command is a map of stages to stages, and maps compose: a block of commands is
    composed where it is, the few blocks of a record are put in order, and rows then
    start from what their block found. commands: job_uid, block, row_pos, counts, after, why.
    """

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = list(range(_OTHER + 1))
        for _, step in _steps(pdf):
            whole = [step[n] for n in whole]
        return pd.DataFrame({"job_uid": [pdf["job_uid"].iloc[0]], "block": [pdf["block"].iloc[0]], "whole": [whole]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        place, found = int(pdf["start"].iloc[0]), []
        for r in pdf.sort_values("block").itertuples():
            found.append((r.job_uid, r.block, place))
            place = int(r.whole[place])
        return pd.DataFrame(found, columns=["job_uid", "block", "start"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        place, found = int(pdf["start"].iloc[0]), []
        for row_pos, step in _steps(pdf):
            found.append((row_pos, place))
            place = step[place]
        return pd.DataFrame(found, columns=["row_pos", "before"])

    blocks = commands.groupBy("job_uid", "block").applyInPandas(compose, "job_uid string, block long, whole array<int>")
    found = scratch.table(spark, blocks.join(started, "job_uid").groupBy("job_uid").applyInPandas(carry, "job_uid string, block long, start int"), "blocks")
    return commands.join(found, ["job_uid", "block"]).groupBy("job_uid", "block").applyInPandas(walk, "row_pos long, before int")


def _folded(rows: DataFrame, started: DataFrame) -> DataFrame:
    """(row_pos, job_uid, job, event_uid, from_stage, to_stage, result) of records whose commands one task may pass in order.

    Tasks hold the stage and the applied events of one record at a time. rows as in
    replay; started: job, stage.
    """
    asked = rows.join(started.select("job", "stage"), "job").select("job", "row_pos", "job_uid", "event_uid", "after", "early", "why", "bad", "stage")
    lined = asked.repartition("job").sortWithinPartitions("job", "row_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stage, done, known = None, None, set(), {}
        for batch in batches:
            took, befores, afters = [], [], []
            for job, event, after, early, why, bad, start in zip(*(batch.column(n).to_pylist() for n in ("job", "event_uid", "after", "early", "why", "bad", "stage")), strict=True):
                if job != current:
                    current, stage, done = job, start, set()
                to = after or stage
                if early is not None:
                    result = early
                elif event in done:
                    result = "REPLAY"
                else:
                    key = (stage, to, why)
                    if key not in known:
                        known[key] = valid(stage, to, why)
                    result = "INVALID_TRANSITION" if bad or not known[key] else "APPLIED"
                befores.append(stage)
                afters.append(to)
                took.append(result)
                if result == "APPLIED":
                    stage = to
                    if event is not None:
                        done.add(event)
            columns = [batch.column(n) for n in ("row_pos", "job_uid", "job", "event_uid")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.string()) for x in (befores, afters, took))], names=["row_pos", "job_uid", "job", "event_uid", "from_stage", "to_stage", "result"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return lined.mapInArrow(run, f"row_pos {kinds['row_pos']}, job_uid string, job string, event_uid string, from_stage string, to_stage string, result string")


def replay(spark: SparkSession, commands: DataFrame, applications: DataFrame, block_rows: int = 100_000, most_rounds: int = 200) -> DataFrame:
    """WFL-01: outcome of each triaged command; those of one record count in row order.

    row_pos is unique. Records of at most block_rows commands are folded one after another
    where they are. A larger record is many tasks: its commands are
    composed in blocks of row_pos. A command is a replay if an earlier one of the same
    event was applied, which depends on the stage that one found; rounds take for granted
    what was applied in the round before and end when nothing changes (the first command
    is right after one round, and each is right as soon as all earlier ones are).
    Commands without a job_uid are of one record. Unknown stages of applications stay.
    """
    known = applications.groupBy("job_uid").agg(F.max("application_stage").alias("stage"))
    odd = lambda c, names: (F.coalesce(c, F.lit("")) != "") & ~F.coalesce(c.isin(*names), F.lit(False))
    why = F.coalesce("reason", F.lit(""))
    rows = commands.select(
        "row_pos", "job_uid", F.coalesce("job_uid", F.lit("")).alias("job"), "event_uid", F.floor(F.col("row_pos") / F.lit(block_rows)).cast("long").alias("block"), F.coalesce("application_stage_update", F.lit("")).alias("after"), F.col("result").alias("early"),
        F.when(F.startswith(why, F.lit("CORRECTION:")), "CORRECTION:").when(why != "", "given").otherwise("").alias("why"), (odd(F.col("referral_stage_update"), REFERRAL) | odd(F.col("outreach_stage_update"), OUTREACH)).alias("bad"),
    )
    rows = scratch.table(spark, rows, "commands")
    named = known.select(F.coalesce("job_uid", F.lit("")).alias("job"), F.coalesce("stage", F.lit(STAGES[0])).alias("stage"))
    started = scratch.table(spark, rows.select("job").distinct().join(named, "job", "left").select("job", F.coalesce("stage", F.lit(STAGES[0])).alias("stage")).withColumn("start", F.coalesce(F.try_element_at(F.create_map(*[x for k, v in _PLACES.items() for x in (F.lit(k), F.lit(v))]), F.col("stage")), F.lit(_OTHER))), "started")
    outcome = lambda frame: frame.select("row_pos", "job_uid", "event_uid", "from_stage", F.when(F.col("result") == "APPLIED", F.col("to_stage")).alias("to_stage"), "result")
    large = scratch.table(spark, rows.groupBy("job").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("job"), "large")
    if large.isEmpty():
        return outcome(_folded(rows, started))
    folded = outcome(_folded(rows.join(large, "job", "left_anti"), started))
    rows, started = scratch.table(spark, rows.join(large, "job", "left_semi"), "commands"), started.join(large, "job", "left_semi")
    open_rows = rows.where("early is null and not bad")
    first = scratch.table(spark, open_rows.groupBy("job", "event_uid").agg(F.min("row_pos").alias("done")), "applied")
    names = F.array(*map(F.lit, STAGES))
    rules = transitions(spark).select("from_stage", "to_stage", F.lit(True).alias("listed"))
    for _ in range(most_rounds):
        told = rows.join(first, ["job", "event_uid"], "left").withColumn("again", F.coalesce(F.col("done") < F.col("row_pos"), F.lit(False)))
        ready = told.select(F.col("job").alias("job_uid"), "block", "row_pos", (F.col("early").isNull() & ~F.col("bad") & ~F.col("again")).alias("counts"), "after", "why")
        before = _stages_before(spark, ready, started.select(F.col("job").alias("job_uid"), "start"))
        full = told.join(before, "row_pos").join(started.select("job", F.col("stage").alias("own")), "job")
        from_stage = F.coalesce(F.get(names, F.col("before")), "own")
        full = full.withColumn("from_stage", from_stage).withColumn("to_stage", F.when(F.col("after") != "", F.col("after")).otherwise(F.col("from_stage"))).join(F.broadcast(rules), ["from_stage", "to_stage"], "left")
        real = F.col("from_stage").isin(*STAGES) & F.col("to_stage").isin(*STAGES) & ~((F.col("to_stage") == "SKIPPED") & (F.col("why") == ""))
        passes = real & ((F.col("why") == "CORRECTION:") | F.coalesce("listed", F.lit(False)))
        result = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("again"), "REPLAY").when(F.col("bad") | ~passes, "INVALID_TRANSITION").otherwise("APPLIED")
        decided = scratch.table(spark, full.select("row_pos", "job_uid", "job", "event_uid", "from_stage", "to_stage", result.alias("result")), "outcomes")
        following = scratch.table(spark, decided.where("result = 'APPLIED'").groupBy("job", "event_uid").agg(F.min("row_pos").alias("done")), "applied")
        ahead = first.select("job", "event_uid", F.col("done").alias("was")).join(following, ["job", "event_uid"], "full_outer")
        if ahead.where("not (was <=> done)").isEmpty():
            return outcome(decided).unionByName(folded)
        first = following
    raise RuntimeError(f"commands did not settle in {most_rounds} rounds")
