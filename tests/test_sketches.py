"""Mergeable voter counts: measured error, and sketches of days that add up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballotlake.model import GovTables
from ballotlake.operators.votes import estimated_voters, unique_voters, voter_sketches


def test_error_and_merging(spark):
    day = 86400
    votes = spark.range(120_000).select(
        F.concat(F.lit("v"), (F.col("id") % 40_000).cast("string")).alias("voter"), (F.col("id") % 3).cast("int").alias("poll_id"),
        F.lit(1).alias("option_id"), F.lit("1").alias("option_id_raw"), F.lit(1).cast("bigint").alias("block_id"),
        F.lit(1).cast("bigint").alias("block_number"),
        F.timestamp_add("SECOND", F.col("id") % (10 * day), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("block_ts"))
    poll = spark.createDataFrame([(k, 0, 20 * day) for k in range(3)], "poll_id int, start_date int, end_date int")
    t = GovTables(vote=votes, poll=poll, block=spark.createDataFrame([], "id long"))
    sketches = voter_sketches(t).cache()
    assert sketches.groupBy("poll_id").count().where("count < 2").count() == 0  # several days each
    found = {r.poll_id: r.voters for r in estimated_voters(sketches).collect()}
    exact = {r.poll_id: r.unique_voters for r in unique_voters(t).collect()}
    assert set(found) == set(exact) == {0, 1, 2}
    for k, n in exact.items():
        assert n == 40_000 and abs(found[k] - n) <= 0.03 * n
    # Days that came later are merged with the sum of those before.
    old = sketches.where("day < DATE'1970-01-02'").groupBy("poll_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    both = old.unionByName(sketches.where("day >= DATE'1970-01-02'").select("poll_id", "sketch"))
    assert {r.poll_id: r.voters for r in estimated_voters(both).collect()} == found
