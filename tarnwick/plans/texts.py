"""Queries over documents and pages: text and URL scalars, distributions, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions import text, urls
from tarnwick.operators import reports
from tarnwick.tables import read_table

_CLEAN = "trim(regexp_replace(lower(replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02/03."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(text.normalized_text(F.col("text")), 256).alias("digest"), text.normalized_company(F.concat("source", F.lit(" Pvt Ltd"))).alias("company"))


NORMALIZED_TEXT = f"select doc_id, sha256({_CLEAN}) as digest, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) as company from documents"

TAGS = {"of": ("of",), "the": ("the", "thé"), "with": ("with", "for"), "la-las": ("la", "las"), "und": ("und",), "est": ("est",)}


def tag_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04, ARR-01: names whose spellings stand free, Unicode-aware."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.tags(F.col("text"), TAGS), ",").alias("tags"))


_HIT = " || ".join(f"case when regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_+])({'|'.join(s)})([^\\p{{L}}\\p{{N}}_+]|$)', 'i') then '{name},' else '' end" for name, s in sorted(TAGS.items()))
TAG_DETECT = f"select doc_id, rtrim({_HIT}, ',') as tags from documents"


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06: what is masked, by kind."""
    # Exploding an array of one keeps the filter from masking each text anew for each of its terms.
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(text.redact(F.col("text")))).alias("t"))
    seen = lambda mark: (F.size(F.split("t", mark)) - 1).cast("long")
    return d.select("doc_id", seen(r"\[EMAIL\]").alias("emails"), seen(r"\[PHONE\]").alias("phones"), seen(r"\[REDACTED\]").alias("secrets")).where("emails + phones + secrets > 0")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01."""
    return read_table(spark, sf_dir, "pages").select("page_id", text.guarded_plain_text(F.col("html")).alias("text"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-01 in built-ins."""
    return read_table(spark, sf_dir, "pages").select("page_id", urls.canonical_simple(F.col("url")).alias("url"))


_TRACK = "^(utm_[^=]*|" + "|".join(urls.TRACKING) + ")(=|$)"
URL_CANONICAL = f"""
with p as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages),
s as (select page_id, split_part(u, '?', 1) as f, case when contains(u, '?') then list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{_TRACK}', 'i'))) else [] end as q from p)
select page_id, lower(regexp_extract(f, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(f, '^[A-Za-z]+://([^/]*)', 1)) || case when regexp_extract(f, '^[A-Za-z]+://[^/]*(/.*)?$', 1) = '' then '/' else regexp_extract(f, '^[A-Za-z]+://[^/]*(/.*)?$', 1) end
  || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as url from s
"""


def url_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-01/02, exact: canonical form, its error, and whether the host may be addressed."""
    c = urls.canonical_url(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", c.alias("c"), urls.url_refusal(F.col("url")).alias("refusal")).select("page_id", "c.*", "refusal")


def distribution_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, SRT-06: the ten most frequent sources, blanks as UNKNOWN."""
    d = read_table(spark, sf_dir, "documents").select(F.when(F.col("source").isin("src1", "src2"), "").otherwise(F.col("source")).alias("source"))
    return reports.distribution(d, "source", 10)


DISTRIBUTION_UNKNOWN = "select case when source in ('src1', 'src2') or source is null or source = '' then 'UNKNOWN' else source end as label, count(*) as n from documents group by 1 order by n desc, label limit 10"


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-07/08: sentences, and the first that names a word."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"), text.first_sentence(F.col("text"), "with").alias("first_with"))


SENTENCE_COUNTS = r"""
with s as (select doc_id, regexp_split_to_array(text, '[\n.;]') as parts from documents)
select doc_id, cast(len(parts) as bigint) as sentences, coalesce(substr(trim(list_filter(parts, lambda x: regexp_matches(x, 'with'))[1], ' '), 1, 500), '') as first_with from s
"""


def safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09: cells that need an escape, over the rows of all texts."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("cell"))
    return rows.groupBy("doc_id").agg(F.count_if(text.safe_cell(F.col("cell")) != F.col("cell")).alias("escaped"))


SAFE_CELLS = r"""
with c as (select doc_id, unnest(string_split(text, chr(10))) as cell from documents)
select doc_id, count(*) filter (where regexp_matches(cell, '^[=+\-@\t\r\n]') or regexp_matches(cell, '^\s*[=+\-@]')) as escaped from c group by doc_id
"""


def theta_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02, JON-05: token Jaccard of short documents against every tag phrase that shares a word.

    The phrases are few literals, so each row is compared where it is, without a shuffle.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(text.normalized_text(F.col("text")), " ")).alias("t"))
    shared = [F.struct(F.lit(k).alias("phrase"), F.lit(len(v)).cast("long").alias("m"), F.size(F.array_intersect("t", F.array(*map(F.lit, v)))).cast("long").alias("k")) for k, v in PHRASES.items()]
    met = d.select("doc_id", F.size("t").cast("long").alias("n"), F.inline(F.array(*shared))).where("k > 0")
    return met.select("doc_id", "phrase", F.round(F.col("k") * 100.0 / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


PHRASES = {"english": ("the", "of", "and", "to", "in"), "french": ("le", "la", "de", "est", "une"), "german": ("der", "die", "und", "ist", "den"), "spanish": ("el", "los", "de", "que", "las")}
_PHRASE_ROWS = ", ".join(f"('{k}', '{w}', {len(v)})" for k, v in PHRASES.items() for w in v)
THETA_OVERLAP = f"""
with d as (select doc_id, list_distinct(string_split({_CLEAN}, ' ')) as t from documents),
w as (select doc_id, len(t) as n, unnest(t) as word from d),
p(phrase, word, m) as (values {_PHRASE_ROWS}),
s as (select doc_id, phrase, n, m, count(*) as k from w join p using (word) group by all)
select doc_id, phrase, round(k * 100.0 / (n + m - k), 6) as jaccard from s
"""

QUERIES = {f.__name__: f for f in (normalized_text, tag_detect, redact, html_text, url_canonical, url_exact, distribution_unknown, sentence_counts, safe_cells, theta_overlap)}
SQL = {"normalized_text": NORMALIZED_TEXT, "tag_detect": TAG_DETECT, "url_canonical": URL_CANONICAL, "distribution_unknown": DISTRIBUTION_UNKNOWN, "sentence_counts": SENTENCE_COUNTS, "safe_cells": SAFE_CELLS, "theta_overlap": THETA_OVERLAP}
