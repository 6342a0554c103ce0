"""Line dedup: SQL on a table, rules on small rows, the plan."""

from __future__ import annotations

import duckdb
import pytest

from ballotlake.llm import lines

SF = "/root/testdata/sf0.01"


def test_against_sql_with_the_production_and_a_lower_ratio(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for ratio in (lines.RATIO, 0.08):
        sql = lines.OP2_SQL.replace(f"> {lines.RATIO} *", f"> {ratio} *")
        want = sorted(con.execute(f"SELECT doc_id, source, text, n_lines, n_dropped FROM ({sql})").fetchall())
        out = lines.drop_boilerplate(docs, ratio=ratio).select("row.doc_id", "row.source", "text", "n_lines", "n_dropped")
        assert sorted(map(tuple, out.collect())) == want
    assert sum(r[4] for r in want) > 0


def test_odd_rows(spark):
    rows = [(i, "a", f"MENU\nbody {i}\n\n MENU ", "x") for i in range(8)] + [(None, None, None, None), (9, None, "", "y"), (10, "b", "MENU", "z"), (10, "b", "MENU", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, host string")
    out = {(r.row.doc_id, r.row.source): r for r in lines.drop_boilerplate(docs).collect()}
    assert out[3, "a"].text == "body 3\n" and (out[3, "a"].n_lines, out[3, "a"].n_dropped) == (4, 2)
    assert out[None, None].text is None and out[None, None].n_lines == 0
    assert out[9, None].text == "" and out[10, "b"].text == "MENU"
    again = lines.dedup_lines(docs)
    assert again.columns == docs.columns and again.count() == len(rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("word", ["Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"])
def test_plan_is_native(spark, word):
    plan = lines.op2_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert word not in plan
