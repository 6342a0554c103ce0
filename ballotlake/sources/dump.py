r"""A whole dump in one file: COPY sections between other statements, read in parallel.

Spark reads the file in splits, and a split does not know which section its first lines belong to.  Every split gives
its few marking lines: headers ``COPY table (columns) FROM stdin;`` and ends ``\.``.  In the order of the file, a header opens
a section if none is open, so a data line that looks like a header stays data.  What is open at the end of a split is handed to
the next ones: one row per split, folded over the splits of a file.  A line's section is that of the last mark above it, found
in the list of its split; lines are never shuffled for it.

``load_dump`` gives the tables of the model, each from its sections, by the reader of COPY text.
``split_dump`` writes each section to a folder of its own in one pass, for dumps of which many tables are read.
``write_dump`` writes such files, whole sections in each.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballotlake.functions.cuts import below
from ballotlake.functions.settle import settle
from ballotlake.model import SCHEMAS, GovTables
from ballotlake.sources.copytext import copy_line, parse_lines

# The tables of a dump, the tables of the model they fill, and columns with another name there.
TABLES = {
    "chains.chain": ("chain", {}),
    "dschief.balances": ("locked_balance", {}),
    "dschief.delegate_lock": ("delegate_lock", {"lock": "lock_amt"}),
    "dschief.lock": ("lock", {"lock": "lock_amt"}),
    "dschief.vote_delegate_created_event": ("delegate", {}),
    "dschief.vote_proxy_created_event": ("proxy", {}),
    "esm.mkr_joins": ("shutdown_v1", {}),
    "esmv2.mkr_joins": ("shutdown_v2", {}),
    "extracted.logs": ("log", {}),
    "extractedarbitrum.logs": ("log2", {}),
    "mkr.balances": ("wallet_balance", {}),
    "mkr.transfer_event": ("transfer", {}),
    "polling.poll_created_event": ("poll", {}),
    "polling.poll_withdrawn_event": ("poll_withdrawal", {}),
    "polling.voted_event": ("vote", {}),
    "polling.voted_event_arbitrum": ("vote2", {}),
    "vulcan2x.block": ("block", {"timestamp": "block_ts"}),
    "vulcan2x.job": ("job", {}),
    "vulcan2x.transaction": ("tx", {}),
    "vulcan2xarbitrum.block": ("block2", {"timestamp": "block_ts"}),
    "vulcan2xarbitrum.transaction": ("tx2", {}),
}

END = "\\."
_HEADER = r"^COPY\s+(\S+)\s*\((.*)\)\s+FROM\s+stdin;\s*$"
_SPLIT = ["file", "start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the first byte of their split, and their place in it."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"))


def _marks(lines: DataFrame) -> DataFrame:
    """Per split: the places where a section opens or ends, from before its first line on, and the header open from there."""
    header = F.col("value").rlike(_HEADER)
    mark = F.when(header | (F.col("value") == END), F.struct("place", F.when(header, F.col("value")).alias("header")))
    per_split = lines.groupBy(*_SPLIT).agg(F.collect_list(mark).alias("marks"))
    order = Window.partitionBy("file").orderBy("start", "place")
    marks = per_split.select(*_SPLIT, F.explode("marks").alias("mark")).select(*_SPLIT, "mark.*")
    before = F.lag(F.struct("place", "header")).over(order)
    marks = marks.withColumn("_before", before).where(
        F.col("header").isNull() | F.col("_before").isNull() | F.col("_before.header").isNull())
    own = marks.groupBy(*_SPLIT).agg(F.sort_array(F.collect_list(F.struct("place", "header"))).alias("marks"))
    whole = per_split.select(*_SPLIT).join(own, _SPLIT, "left")
    last = F.last(F.element_at("marks", -1), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.struct(F.lit(-1).cast("bigint").alias("place"), last["header"].alias("header"))
    return whole.withColumn("carried", carried).select(
        *_SPLIT, F.concat(F.array("carried"), F.coalesce("marks", F.array().cast("array<struct<place:bigint,header:string>>"))).alias("marks"))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(header, value): every data line with the header of its section; lines outside of sections are left out."""
    lines = _lines(spark, path)
    # One row per split; written, so that its size is known when it is joined.
    marks = settle(_marks(lines), "marks")
    marks = marks.select(*_SPLIT, F.transform("marks", lambda m: m["place"]).alias("places"), F.col("marks.header").alias("headers"))
    placed = lines.join(marks, _SPLIT)
    header = F.get("headers", below(F.col("places"), F.col("place")) - 1)
    ends = F.col("value") == END
    return placed.select(header.alias("header"), "value", ends.alias("_ends")).where(
        F.col("header").isNotNull() & ~F.col("_ends")).drop("_ends")


def _named(header: str) -> tuple[str, list[str]]:
    """The table's dotted name and its columns, without quotes."""
    found = re.match(_HEADER, header)
    return found[1].replace('"', ""), [c.strip().strip('"') for c in found[2].split(",")]


def _headers(spark: SparkSession, path: str) -> list[str]:
    """The headers of the dump's sections: a row per section."""
    marks = _marks(_lines(spark, path)).select(F.explode(F.slice("marks", 2, 2**31 - 1)).alias("mark"))
    return [r[0] for r in marks.where(F.col("mark.header").isNotNull()).select("mark.header").distinct().collect()]


def _sections(headers: list[str], names: dict) -> dict[str, dict[str, list[str]]]:
    """Table of the model to the headers of its sections, each with the model's names of its columns."""
    out: dict[str, dict[str, list[str]]] = {}
    for header in headers:
        name, columns = _named(header)
        if name in names:
            table, other = names[name]
            out.setdefault(table, {})[header] = [other.get(c, c) for c in columns]
    return out


def _tables(found: dict[str, dict[str, list[str]]], lines_of) -> GovTables:
    def table(name: str) -> DataFrame:
        parts = [parse_lines(lines_of(h), name, c) for h, c in sorted(found[name].items())]
        return reduce(DataFrame.unionByName, parts)

    return GovTables(**{name: (lambda name=name: table(name)) for name in found})


def load_dump(spark: SparkSession, path: str, names: dict = TABLES) -> GovTables:
    """The tables of the model that the dump has sections of, read when used.

    ``names`` gives for a table of the dump that of the model and the columns with another name; others are left out.
    """
    lines = dump_lines(spark, path)
    return _tables(_sections(_headers(spark, path), names), lambda h: lines.where(F.col("header") == h).select("value"))


def split_dump(spark: SparkSession, path: str, out: str, names: dict = TABLES) -> GovTables:
    """Writes the lines of every section below ``out`` in one pass, and gives the tables from there."""
    found = _sections(_headers(spark, path), names)
    number = {h: k for k, h in enumerate(sorted(h for own in found.values() for h in own))}
    section = F.coalesce(*[F.when(F.col("header") == h, F.lit(k)) for h, k in number.items()], F.lit(-1))
    lines = dump_lines(spark, path).withColumn("section", section).where("section >= 0")
    lines.select("section", "value").write.mode("overwrite").partitionBy("section").text(out)
    return _tables(found, lambda h: _read(spark, f"{out}/section={number[h]}"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a section; one without lines has no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.text(folder) if there else spark.createDataFrame([], "value string")


def write_dump(tables: GovTables, path: str, names: list[str], files: int = 1) -> None:
    """The named tables of the model as ``files`` dump files, each with a section of every table and a share of its rows."""
    dumped = {table: (name, {v: k for k, v in other.items()}) for name, (table, other) in TABLES.items()}
    parts = []
    for k, table in enumerate(names):
        df = getattr(tables, table)
        name, other = dumped[table]
        columns = [c for c in SCHEMAS[table].names if c in df.columns]
        header = f"\nCOPY {name} ({', '.join(other.get(c, c) for c in columns)}) FROM stdin;"
        edges = df.sparkSession.range(files).select(F.col("id").cast("int").alias("file"), F.inline(F.array(
            F.struct(F.lit(0).alias("place"), F.lit(header).alias("value")),
            F.struct(F.lit(2).alias("place"), F.lit(END + "\n").alias("value")))))
        rows = df.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files)).cast("int").alias("file"),
                         F.lit(1).alias("place"), copy_line([F.col(c) for c in columns]).alias("value"))
        parts.append(edges.unionByName(rows).withColumn("section", F.lit(k)))
    whole = reduce(DataFrame.unionByName, parts).repartitionById(files, "file").sortWithinPartitions("file", "section", "place")
    whole.select("value").write.mode("overwrite").text(path)
