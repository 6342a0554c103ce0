"""Every registered query against its plain SQL, and the shape of its plan."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as registered
from ballotlake.plans.oracle import oracle
from ballotlake.plans.registry import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry()
SQL = oracle()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in ("events", "nation"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def _comparable(columns, rows):
    def plain(value):
        return format(value, "f") if isinstance(value, Decimal) else (
            value.isoformat() if isinstance(value, dt.datetime) else value)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


_SPARK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz",
    "DECIMAL(38,18)": "decimal(38,18)",
}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "InPandas", "MapIn"):
        assert slow not in plan, f"{slow} in the plan of {name}"
    answer = sql.execute(SQL[name])
    names = [column[0] for column in answer.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {column[0]: _SPARK_TYPES[str(column[1])] for column in answer.description}
    assert kinds == dict(df.dtypes)
    got = df.collect()
    assert got, f"{name} has no rows, so nothing is compared"
    assert _comparable(df.columns, got) == _comparable(names, answer.fetchall())


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_last_votes_are_thinned_before_the_shuffle(spark):
    plan = _plan(spark, "latest_votes_all")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_votes_and_balances_combine_before_the_shuffle(spark):
    assert "partial_max" in _plan(spark, "canonical_votes_all")
    held = _plan(spark, "canonical_weight")
    assert "partial_max_by" in held and "HashAggregate" in held


def test_balances_need_one_shuffle(spark):
    assert _plan(spark, "combined_balances_now").count("Exchange") == 1
    assert _plan(spark, "token_holders_time").split("Subquery")[0].count("Exchange hash") == 1


def test_windows_are_over_zones_or_zone_totals(spark):
    for name in ("all_locks_running", "lock_history_totals_all", "running_balances_wallet"):
        for line in _plan(spark, name).splitlines():
            if "- Window" in line or "+- Window" in line:
                assert "_zone" in line, line


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["valid_votes_time"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(event_type,click)" in plan and "LessThanOrEqual(ts," in plan
    assert "props" not in plan.split("Physical Plan")[1]


def test_entry_gives_rows(spark):
    result = registered.entry(spark)
    assert result.columns == ["poll_id", "unix", "option_id", "support"] and result.count() > 0


def _aggregates_above(plan: str, needle: str) -> list[str]:
    """The lines of aggregates that have no ``needle`` below them on their branch."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(lines):
        if "Aggregate" in line:
            below = []
            for later in lines[i + 1:]:
                if depth(later) <= depth(line):
                    break
                below.append(later)
            if not any(needle in x for x in below) and any("event_type,click" in x or "event_type,view" in x for x in below):
                out.append(line)
    return out


@pytest.mark.parametrize("name", ["current_vote", "current_votes_by_voter"])
def test_votes_of_others_go_before_anything_is_added_up(spark, name):
    assert _aggregates_above(_plan(spark, name), "LeftSemi") == []


def test_moves_of_others_go_before_balances_are_added_up(spark):
    plan = _plan(spark, "voting_weight_of_time")
    sums = [i for i, line in enumerate(plan.splitlines()) if "partial_sum(change" in line]
    assert sums and all("LeftSemi" in "\n".join(plan.splitlines()[i:i + 8]) for i in sums)


def test_history_is_thinned_to_the_asked_voters(spark):
    plan = _plan(spark, "weighted_votes_time")
    held = [i for i, line in enumerate(plan.splitlines()) if "partial_max_by(wallet_amount" in line]
    assert held and all("LeftSemi" in "\n".join(plan.splitlines()[i:i + 8]) for i in held)
