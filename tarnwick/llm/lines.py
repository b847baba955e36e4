"""Line dedup: lines that recur across documents go, except in the least document that holds them.

1. Texts are cut at line feeds. A line's key is the line without white space at both
   ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points never
   count. Lines are exploded and reduced to a 128-bit hash of the key.
2. Documents are counted by hash: (hash, document) pairs are made distinct and then
   counted, both combined map-side, so a line in a third of all documents is a few
   partial counts. The least document of each recurring hash is its keeper.
3. Lines meet the recurring hashes, a written table of one row a hash; adaptive
   execution splits a hot hash. What comes out are the positions to drop.
4. Documents meet their list of positions and are put together again from the lines
   that are left, in their order. The only rows that carry text are the documents,
   once.

All steps are built-in expressions. A document is known by its id and the hash of its
text, so no row number has to be kept.

Edge cases: a null or empty text is one empty line and the empty text. Rows of one id
are one document when documents are counted. Rows without an id are together one
document, after all others: it keeps a line only if no other document holds it.
Repeated rows lose the same lines; a line that stands several times in its keeper stays
each time. Columns of the input with the name of a result are replaced, others pass
through. No documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick import scratch

#: White space that a key does not begin or end with.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_lines", "n_dropped", "kept_text")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _hashes(value: Column) -> list[Column]:
    """128 bits of a string."""
    return [F.xxhash64(value), F.xxhash64(F.lit(1), value)]


def keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, t1, t2, pos, h1, h2) of the lines whose key counts; rows: id, t1, t2, text."""
    lines = rows.select("id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.length("key") >= min_chars).select("id", "t1", "t2", "pos", *[h.alias(n) for h, n in zip(_hashes(F.col("key")), ("h1", "h2"), strict=True)])


def recurring(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, keeper) of the hashes that at least min_documents documents hold."""
    held = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    return held.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.min("id").alias("keeper")).where(F.col("documents") >= min_documents).select("h1", "h2", "keeper")


def _without(lines: Column, drop: Column) -> Column:
    """Lines but for those at the positions drop, joined. The array is bound to a name, so it is made once a text."""

    def joined(held: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.element_at(held, i + 1)), "\n")

    return F.element_at(F.transform(F.array(lines), joined), 1)


def dedup_lines(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [c for c in docs.columns if c not in RESULTS]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), *[h.alias(n) for h, n in zip(_hashes(value), ("t1", "t2"), strict=True)], value.alias("text"))
    lines = scratch.table(spark, keyed_lines(rows, min_chars), "lines")
    known = scratch.table(spark, recurring(lines, min_documents), "recurring-lines")
    gone = lines.join(known, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "t1", "t2", "pos").distinct()
    drops = scratch.table(spark, gone.groupBy("id", "t1", "t2").agg(F.collect_list("pos").alias("__drop")), "dropped-lines")
    scratch.drop(spark, lines)
    left = docs.select(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns)], *[h.alias(n) for h, n in zip(_hashes(value), ("t1", "t2"), strict=True)])
    at = {c: f"c{n}" for n, c in enumerate(docs.columns)}
    # The positions are the hashed side: texts stream past them, without a sort that holds texts.
    met = left.join(drops.hint("shuffle_hash"), F.col(at[doc_id]).eqNullSafe(F.col("id")) & (left["t1"] == drops["t1"]) & (left["t2"] == drops["t2"]), "left")
    body = F.coalesce(F.col(at[text]), F.lit(""))
    n_lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long")
    whole = F.when(F.col("__drop").isNull(), body).otherwise(_without(F.split(body, "\n"), F.col("__drop")))
    return met.select(*[F.col(at[c]).alias(c) for c in own], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), whole.alias("kept_text"))
