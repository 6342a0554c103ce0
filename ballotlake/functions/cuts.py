"""Many cuts along one axis, answered together.

Cuts are numbered in order.  A fact counts for every cut from the first one at or after its position, so facts are
marked with that cut's number and added up per key and number; a running sum over the numbers then gives the state at each
cut.  Facts are read once, whatever the number of cuts, and a key has at most one row per cut after the partial sums.

The first cut is found by an equi-join over zones of positions, not by comparing facts with cuts: a zone row lists the
cuts inside it and the number of the first of them, and zones without a cut point to the next one.  The numbering runs in one
task; it holds as many numbers as there are cuts, where the answer holds a row per key for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = "_cut"
_ZONE = "_zone"


def numbered(requests: DataFrame) -> DataFrame:
    """(value, _cut): the different values of the first column, NULL left out, numbered from 0 in order."""
    asked = requests.select(F.col(requests.columns[0]).cast("bigint").alias("value")).where("value IS NOT NULL").distinct()
    return asked.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias(CUT))


def below(sorted_values: Column, limit: Column) -> Column:
    """How many of the sorted values are below the limit: by looking at all of a few, by bisection in many."""
    size = F.size(sorted_values)

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        above = F.get(sorted_values, middle) < limit
        return F.when(state["low"] >= state["high"], state).when(
            above, F.struct((middle + 1).alias("low"), state["high"].alias("high"))
        ).otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))
    bisected = F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve, lambda s: s["low"])
    return F.when(size <= 16, F.size(F.filter(sorted_values, lambda x: x < limit))).otherwise(bisected)


def mark_first_cut(
    facts: DataFrame, position: str, cuts: DataFrame, least: int | None, upto: str = "value", bits: int = 16,
) -> DataFrame:
    """``facts`` with the number of the first cut whose ``upto`` is not below their position; later facts are dropped.

    ``upto`` does not fall from one cut to the next; cuts where it is NULL come first and keep nothing.  ``least`` is
    its smallest value.
    """
    known = cuts.where(F.col(upto).isNotNull()).select(F.col(upto).cast("bigint").alias("upto"), CUT)
    zone = F.shiftright("upto", bits)
    per_zone = known.groupBy(zone.alias("_at")).agg(
        F.sort_array(F.collect_list("upto")).alias("_cuts"), F.min(CUT).alias("_base"))
    order = Window.orderBy("_at")
    reached = per_zone.withColumn("_from", F.coalesce(F.lag("_at").over(order) + 1, "_at")).withColumn(
        "_last", F.max(F.col("_base") + F.size("_cuts")).over(Window.partitionBy()))
    zones = reached.select("*", F.explode(F.sequence("_from", "_at")).alias(_ZONE)).select(
        _ZONE, F.when(F.col(_ZONE) == F.col("_at"), F.col("_cuts")).otherwise(F.array().cast("array<bigint>")).alias("_cuts"),
        "_base", "_last")
    # All positions before the first cut count for it, whatever their zone.
    place = F.greatest(F.col(position).cast("bigint"), F.lit(least).cast("bigint"))
    placed = facts.withColumn(_ZONE, F.shiftright(place, bits))
    marked = placed.join(zones, _ZONE).withColumn(
        CUT, F.col("_base") + below(F.col("_cuts"), F.col(position).cast("bigint")))
    return marked.where(F.col(CUT) < F.col("_last")).select(*facts.columns, CUT)


def until_next(rows: DataFrame, keys: list[str], n_cuts: int) -> DataFrame:
    """``rows`` (one per key and cut) with ``_until``: the last cut before the key's next row."""
    following = F.lead(CUT).over(Window.partitionBy(*keys).orderBy(CUT))
    return rows.withColumn("_until", F.coalesce(following, F.lit(n_cuts)) - 1)


def at_every_cut(rows: DataFrame) -> DataFrame:
    """A row for each of the cuts from ``_cut`` to ``_until``."""
    others = [c for c in rows.columns if c not in (CUT, "_until")]
    return rows.select(*others, F.explode(F.sequence(CUT, "_until")).alias(CUT))
