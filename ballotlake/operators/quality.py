"""Faults in the tables, and the jobs that repair them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlake.model import (
    FIRST_CHAIN_FACTS, JOB_STATES, SCHEMAS, SECOND_CHAIN_FACTS, GovTables,
)

_EVENT_KEY = ("log_index", "tx_id")
_PARENTS = ("block", "block2", "tx", "tx2")
# What a line of the report says of its key: a row's own fault, a key, or an id that others may hang on; from 0 on, the
# check of a row that hangs on the id.
_ALONE, _KEY, _PARENT = -1, -2, -3


def _unique_keys(table: str) -> list[tuple[str, ...]]:
    """What must be unique: the id, the place of an event, and a few names and hashes."""
    keys = [("id",)]
    if "log_index" in SCHEMAS[table].names:
        keys.append(_EVENT_KEY)
    if table in ("block", "block2", "tx", "tx2"):
        keys.append(("hash",))
    if table in ("chain", "job"):
        keys.append(("name",))
    return keys


def _references(table: str) -> list[tuple[str, str]]:
    """The block and transaction tables a fact hangs on."""
    if table in ("tx", "tx2"):
        return [("block_id", table.replace("tx", "block"))]
    if table in FIRST_CHAIN_FACTS:
        return [("block_id", "block"), ("tx_id", "tx")]
    if table in SECOND_CHAIN_FACTS:
        return [("block_id", "block2"), ("tx_id", "tx2")]
    return []


class _Checks:
    """The checks of some tables, numbered, and what each row hands on for them.

    A row gives one line per key it must not share, one for each thing that is wrong with it alone, one per block or
    transaction it hangs on, and one if others hang on it.  A line is (space, a, b, s, role): ``space`` is the number of its check, or
    of the table whose ids are meant, and the rest the key.
    """

    def __init__(self, t: GovTables, tables: list[str]):
        self.t, self.tables = t, tables
        self.named: list[tuple[str, str, str]] = []

    def number(self, table: str, fault: str, columns: str) -> int:
        self.named.append((table, fault, columns))
        return len(self.named) - 1

    @staticmethod
    def line(space: int, a=None, b=None, s=None, role: int = _ALONE) -> Column:
        none = F.lit(None)
        return F.struct(
            F.lit(space).alias("space"), (none if a is None else a).cast("bigint").alias("a"), (none if b is None else b).cast("bigint").alias("b"),
            (none if s is None else s).cast("string").alias("s"), F.lit(role).alias("role"))

    def ids_of(self, table: str) -> int:
        """The space of a table's ids: below all checks."""
        return -1 - _PARENTS.index(table)

    def own(self, table: str) -> DataFrame:
        """What is wrong with a row alone, and the keys that it must not share."""
        df, out = getattr(self.t, table), []
        for field in SCHEMAS[table].fields:
            if not field.nullable and field.name in df.columns:
                out.append(F.when(F.col(field.name).isNull(), self.line(self.number(table, "null", field.name))))
        for key in _unique_keys(table):
            if set(key) <= set(df.columns):
                texts = [c for c in key if df.schema[c].dataType == T.StringType()]
                numbers = [F.col(c) for c in key if c not in texts]
                out.append(self.line(self.number(table, "duplicate", ", ".join(key)), *numbers, s=F.col(texts[0]) if texts else None, role=_KEY))
        if table == "job":
            wrong = ~F.col("status").isin(*JOB_STATES)
            out.append(F.when(wrong, self.line(self.number(table, "state", "status"))))
        return df.select(F.inline(F.array(*out))).where(F.col("space").isNotNull())

    def references(self, table: str) -> list[DataFrame]:
        """The ids that a table's rows hang on."""
        df = getattr(self.t, table)
        out = [self.line(self.ids_of(parent), F.col(column), role=self.number(table, "orphan", column))
               for column, parent in _references(table) if column in df.columns and parent in self.t]
        return [df.select(F.inline(F.array(*out))).where(F.col("a").isNotNull()).select("space", "a", "role")] if out else []

    def parents(self) -> list[DataFrame]:
        """The ids that may be hung on; of each table that some of ``tables`` need."""
        needed = sorted({parent for table in self.tables for _, parent in _references(table) if parent in self.t})
        return [getattr(self.t, p).select(
            F.lit(self.ids_of(p)).alias("space"), F.col("id").cast("bigint").alias("a"), F.lit(_PARENT).alias("role")) for p in needed]


def integrity_report(t: GovTables, tables: list[str] | None = None) -> DataFrame:
    """Rows that break a rule of the schema, per table, fault and columns; zeros included.

    Faults: ``null`` in a required column, ``duplicate`` of a unique key (rows
    beyond the first), ``orphan`` without its block or transaction, ``state``
    outside the allowed values.

    Two grouped passes over all tables at once: one for what rows must not share, one for the ids they hang on.  Lines are counted
    by key before the shuffle, so that a block with very many events is one line by then.
    """
    names = tables or t.names()
    checks = _Checks(t, names)
    counted = reduce(DataFrame.unionByName, [checks.own(name) for name in names]).groupBy("space", "a", "b", "s", "role").agg(
        F.count("*").alias("n"))
    faults = counted.select(F.col("space").alias("check"), (F.col("n") - (F.col("role") == _KEY).cast("int")).alias("n"))
    if references := [df for name in names for df in checks.references(name)]:
        met = reduce(DataFrame.unionByName, [*references, *checks.parents()]).groupBy("space", "a", "role").agg(F.count("*").alias("n"))
        # At most one line per check and one of the table itself.
        met = met.groupBy("space", "a").agg(F.collect_list(F.struct("role", "n")).alias("lines"))
        orphans = met.where(~F.exists("lines", lambda x: x["role"] == _PARENT)).select(F.inline("lines"))
        faults = faults.unionByName(orphans.select(F.col("role").alias("check"), "n"))
    found = faults.groupBy("check").agg(F.sum("n").alias("n"))
    listed = counted.sparkSession.createDataFrame(
        [(k, *own) for k, own in enumerate(checks.named)], "check int, table_name string, fault string, columns string")
    return listed.join(found, "check", "left").select(
        "table_name", "fault", "columns", F.coalesce("n", F.lit(0)).cast("bigint").alias("bad_rows"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Each event once, by its log index and transaction; of events that differ, the one with the lowest id.

    Copies are combined before the shuffle, so a much repeated event stays small.
    """
    if "id" not in events.columns:
        return events.dropDuplicates(list(_EVENT_KEY))
    order = ["id", *[c for c in events.columns if c != "id"]]
    best = events.groupBy(*_EVENT_KEY).agg(F.min(F.struct(*order)).alias("_first"))
    return best.select(*[F.col(f"_first.{c}").alias(c) for c in events.columns])


def retract_blocks(t: GovTables, blocks: DataFrame, chain: int = 1) -> GovTables:
    """The tables without some blocks of a chain and everything that hangs on them.

    ``blocks`` has one column of block ids.  Facts go with their block and with
    their transaction; stored balances go with theirs, which leaves the rest
    right when the blocks are the end of the chain.
    """
    gone = blocks.toDF("block_id").distinct()
    block, tx = ("block", "tx") if chain == 1 else ("block2", "tx2")
    facts = FIRST_CHAIN_FACTS if chain == 1 else SECOND_CHAIN_FACTS
    gone_tx = None
    if tx in t:
        gone_tx = getattr(t, tx).join(gone, "block_id", "left_semi").select(F.col("id").alias("tx_id"))

    def kept(name: str) -> DataFrame:
        df = getattr(t, name)
        if "block_id" in df.columns:
            df = df.join(gone, "block_id", "left_anti").select(*df.columns)
        if gone_tx is not None and "tx_id" in df.columns:
            df = df.join(gone_tx, "tx_id", "left_anti").select(*df.columns)
        return df

    changes = {name: (lambda name=name: kept(name)) for name in (*facts, tx) if name in t}
    if block in t:
        ids = gone.withColumnRenamed("block_id", "id")
        changes[block] = lambda: getattr(t, block).join(ids, "id", "left_anti")
    return t.replace(**changes)
