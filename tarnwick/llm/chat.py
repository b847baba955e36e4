"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Every turn gets the
hash of the conversation up to it; a conversation whose last hash is a prefix hash
of a longer one is a snapshot and is dropped by an anti-join, of equal ones the
smallest conv_id stays, and the maximal ones are rendered.

The prefix hash is the exclusive or of the turns' hashes, each with its position,
so it is a running aggregate that can be cut into blocks: positions and hashes run
within blocks of ``block`` turn numbers, block totals run over blocks, and no task
needs all turns of a long conversation. Rendering gives one row per block for the
same reason. Prefix hashes are made distinct map-side before they are joined, so a
first turn that a third of all conversations share is one row per task. Two
64-bit hashes make a chance collision negligible.

Edge cases: rows with a null conv_id or a null turn belong to no conversation and
are dropped; a null role or text is an empty one; exact repeats of a row count
once; different rows of one turn number follow each other by role, then text. Other
columns are not read, whatever their names. No rows, no conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HASHES = ("h1", "h2")


def ordered_turns(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, position, role, text, h1, h2): positions from 1, hashes of the prefix that ends here."""
    clean = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    cut = clean.withColumn("block", F.floor(F.col("turn") / block))
    by_block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    counted = cut.withColumn("within", F.row_number().over(by_block).cast("long"))
    sizes = cut.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    placed = counted.join(starts, ["conv_id", "block"]).withColumn("position", F.col("start") + F.col("within"))
    own = placed.withColumns({"g1": F.xxhash64("position", "role", "text"), "g2": F.xxhash64("text", "role", "position", F.lit("second"))})
    totals = own.groupBy("conv_id", "block").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    earlier = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(before), F.lit(0).cast("long")).alias(f"e{i}") for i in (1, 2)])
    run = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    running = own.select("*", *[F.bit_xor(f"g{i}").over(run).alias(f"r{i}") for i in (1, 2)]).join(earlier, ["conv_id", "block"])
    return running.select("conv_id", "block", "position", "role", "text", *[F.col(f"r{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"h{i}") for i in (1, 2)])


def maximal(ordered: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another one."""
    lengths = ordered.groupBy("conv_id").agg(F.max("position").alias("n_turns"), F.max_by(F.struct(*_HASHES), "position").alias("last"))
    whole = lengths.select("conv_id", "n_turns", "last.*")
    alike = whole.groupBy("n_turns", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    inner = ordered.join(lengths.select("conv_id", "n_turns"), "conv_id").where("position < n_turns").select(F.col("position").alias("n_turns"), *_HASHES).distinct()
    return alike.join(inner, ["n_turns", *_HASHES], "left_anti").select("conv_id", "n_turns")


def render(turns: DataFrame, block: int = 256, opening: str = "<|", middle: str = "|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """Maximal conversations as text: (conv_id, part, n_turns, text), parts in order."""
    ordered = ordered_turns(turns, block)
    line = F.concat(F.lit(opening), "role", F.lit(middle), "text", F.lit(closing))
    kept = ordered.join(maximal(ordered), "conv_id")
    parts = kept.groupBy("conv_id", F.col("block").alias("part"), "n_turns").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))
