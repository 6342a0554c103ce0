"""Line dedup by site-relative frequency, in built-in functions only.

A line's frequency on a host is the number of the host's pages that contain it, over the number of the host's pages.
Lines above ``RATIO`` are boilerplate and are dropped from every page of that host; the rest of a page stays as it is,
in order.  Lines are compared trimmed of blanks; blank lines always stay.  A line counts once per page, and only lines
on at least ``LEAST_PAGES`` pages of the host can be boilerplate, so a small host loses nothing by chance.

Lines are counted by 128 bits of hash, with partial counts before the shuffle, so neither a hot host nor a line on all
its pages lands in one task.  A host's boilerplate is small for certain: over all lines, frequencies add up to the mean
number of different lines per page, so at most that number divided by ``RATIO`` of them can exceed ``RATIO``.  The list
per host is written to the shared folder, so its size is known when Spark plans the join with the pages: a small one is
broadcast, a large one is a sort-merge join whose hot hosts adaptive execution splits.

A page with a null host belongs to the host null.  A null text stays null and has no lines.  Repeated rows count as
pages of their own.  ``n_lines`` and ``n_dropped`` tell the lines of a page before, and how many went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import written

RATIO = 0.3
LEAST_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _code(line: Column) -> Column:
    """128 bits: the second hash starts from another seed."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, codes): the codes of the lines of each host that are boilerplate."""
    pages = docs.select(F.col(host).alias("host"), F.col("text").alias("text"))
    per_page = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.trim(x)))
    lines = pages.select("host", F.explode(per_page).alias("line")).where(F.col("line") != "")
    counts = (
        lines.select("host", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), F.col("line")).alias("b"))
        .groupBy("host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    often = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    often = often.where(F.col("n") > ratio * F.col("total"))
    return often.groupBy(F.col("c.host").alias("host")).agg(F.collect_list(F.struct("a", "b")).alias("codes"))


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Every row of ``docs`` as ``row``, with its new ``text``, ``n_lines`` and ``n_dropped``."""
    found = written(boilerplate(docs, host, ratio, least_pages), "boilerplate")
    pages = docs.select(docs[host].alias("_host_"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = pages.alias("p").join(found.alias("f"), F.col("p._host_").eqNullSafe(F.col("f.host")), "left")
    lines = _lines(F.col("p.row.text"))
    kept = F.when(F.col("f.codes").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains(F.col("f.codes"), _code(F.trim(x)))))
    out = joined.select(
        F.col("p.row").alias("row"), F.array_join(kept, "\n").alias("text"),
        F.size(lines).alias("before"), F.size(kept).alias("after"))
    # size() of a null is -1 or null, depending on the session's settings.
    none = F.col("text").isNull()
    return out.select(
        "row", "text", F.when(none, 0).otherwise(F.col("before")).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.col("before") - F.col("after")).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents with the remaining lines in ``text``, with the columns they came with."""
    out = drop_boilerplate(docs, host)
    return out.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("row.doc_id", "row.source", "text", "n_lines", "n_dropped")


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents
), counts AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL
), totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
often AS (
  SELECT c.source, c.line FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total
), marked AS (
  SELECT l.*, o.line IS NULL AS stays FROM lines l
  LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND trim(l.line, ' ') = o.line
)
SELECT doc_id, any_value(source) AS source, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped
FROM marked GROUP BY doc_id
"""
