"""Running totals and latest-value lookups that no single task has to carry.

A window over one key puts all rows of that key in one task, which fails as
soon as one address or one contract holds a large part of the data; a window
without a key puts everything in one task.  The helpers here cut the position
axis into zones of ``2**ZONE_BITS`` positions and work in two levels:

1. rows are first combined to one row per key and position (partial
   aggregation, before any shuffle), so a window over one key and one zone
   sees at most ``2**ZONE_BITS`` rows whatever the data looks like;
2. one total per key and zone is folded over the zones of the key, at most
   ``2**ZONE_BITS`` rows for positions below ``2**(2 * ZONE_BITS)``, which is
   every 32-bit block id.

Both folds are exact: a sum, and the value at the greatest order key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotlake.functions.asof import as_limit
from ballotlake.model import AMOUNT

ZONE_BITS = 16

_ZONE = "_zone"
_ASKED = "_asked"


@dataclass(frozen=True)
class Fold:
    """``total``: sum of ``value``.  ``latest``: ``value`` at the greatest ``order``."""

    name: str
    kind: str
    value: str
    order: str | None = None

    @property
    def rank(self) -> str:
        return f"_{self.name}_rank"

    def columns(self) -> list[str]:
        return [self.name] if self.kind == "total" else [self.name, self.rank]

    def first(self) -> list[Column]:
        """Aggregates over raw rows."""
        if self.kind == "total":
            return [F.sum(self.value).cast(AMOUNT).alias(self.name)]
        return [
            F.max_by(self.value, self.order).alias(self.name),
            F.max(self.order).alias(self.rank),
        ]

    def again(self) -> list[Column]:
        """Aggregates over rows that are already combined."""
        if self.kind == "total":
            return [F.sum(self.name).cast(AMOUNT).alias(self.name)]
        return [
            F.max_by(self.name, self.rank).alias(self.name),
            F.max(self.rank).alias(self.rank),
        ]

    def over(self, window, suffix: str) -> list[Column]:
        if self.kind == "total":
            return [F.sum(self.name).over(window).cast(AMOUNT).alias(self.name + suffix)]
        return [
            F.max_by(self.name, self.rank).over(window).alias(self.name + suffix),
            F.max(self.rank).over(window).alias(self.rank + suffix),
        ]

    def merge(self, inside: str, before: str) -> Column:
        here, earlier = F.col(self.name + inside), F.col(self.name + before)
        if self.kind == "total":
            both = F.coalesce(here + earlier, here, earlier)
            return both.cast(AMOUNT).alias(self.name)
        rank_here, rank_earlier = F.col(self.rank + inside), F.col(self.rank + before)
        take_here = rank_earlier.isNull() | (rank_here >= rank_earlier)
        return F.when(take_here, here).otherwise(earlier).alias(self.name)


def total(name: str, value: str) -> Fold:
    return Fold(name, "total", value)


def latest(name: str, value: str, order: str) -> Fold:
    return Fold(name, "latest", value, order)


def _flat(folds: Sequence[Fold], method: str, *args) -> list[Column]:
    return [column for fold in folds for column in getattr(fold, method)(*args)]


def _zone_of(pos: str, bits: int) -> Column:
    return F.shiftright(F.col(pos).cast("bigint"), bits).alias(_ZONE)


def _before(keys: Sequence[str]):
    """All earlier zones of the key, not the zone itself."""
    return (
        Window.partitionBy(*keys).orderBy(_ZONE).rangeBetween(Window.unboundedPreceding, -1)
    )


def running(
    rows: DataFrame, keys: Sequence[str], pos: str, folds: Sequence[Fold], bits: int = ZONE_BITS
) -> DataFrame:
    """Every row with its folds over the rows of its key up to its position.

    ``(keys, pos)`` must be unique in ``rows``; all columns are kept.
    """
    zoned = rows.withColumn(_ZONE, _zone_of(pos, bits))
    place = [*keys, _ZONE]
    window = Window.partitionBy(*place).orderBy(pos)
    start = zoned
    for fold in folds:
        if fold.kind == "total":
            start = start.withColumn(fold.name, F.col(fold.value).cast(AMOUNT))
        else:
            start = start.withColumn(fold.name, F.col(fold.value))
            start = start.withColumn(fold.rank, F.col(fold.order))
    inside = start.select(*rows.columns, _ZONE, *_flat(folds, "over", window, "_in"))
    zones = zoned.groupBy(*place).agg(*_flat(folds, "first"))
    offsets = zones.select(*place, *_flat(folds, "over", _before(keys), "_pre"))
    merged = [fold.merge("_in", "_pre") for fold in folds]
    return inside.join(offsets, place).select(*rows.columns, *merged)


def fold_upto(
    asked: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    pos: str,
    folds: Sequence[Fold],
    bits: int = ZONE_BITS,
) -> DataFrame:
    """For every asked ``(keys, pos)``, once: the folds over the history up to it.

    The history may hold any number of rows per key and position.  Only zones
    that are asked for are looked at in detail; all others take part as one
    total each, so few questions to a long history move little data.
    """
    place = [*keys, _ZONE]
    zone = _zone_of(pos, bits)
    asked = asked.select(*keys, pos, zone)
    zoned = history.withColumn(_ZONE, zone)

    def with_marks(rows: DataFrame, marks: DataFrame, group: list[str]) -> DataFrame:
        """One row per group, with its folds and whether it is asked for."""
        marked = rows.withColumn(_ASKED, F.lit(False)).unionByName(
            marks.withColumn(_ASKED, F.lit(True)), allowMissingColumns=True
        )
        return marked.groupBy(*group).agg(
            *_flat(folds, "first"), F.bool_or(_ASKED).alias(_ASKED)
        )

    detail = zoned.join(asked.select(*place).distinct(), place, "left_semi")
    window = Window.partitionBy(*place).orderBy(pos)
    inside = (
        with_marks(detail, asked, [*place, pos])
        .select(*place, pos, _ASKED, *_flat(folds, "over", window, "_in")).where(_ASKED)
    )
    offsets = (
        with_marks(zoned.drop(pos), asked.drop(pos), place)
        .select(*place, _ASKED, *_flat(folds, "over", _before(keys), "_pre")).where(_ASKED)
        .drop(_ASKED)
    )
    merged = [fold.merge("_in", "_pre") for fold in folds]
    return inside.join(offsets, place).select(*keys, pos, *merged)


PER_ROW = object()
"""Cut given by the rows themselves, in the column ``cut_id``."""


def known_at(
    asked: DataFrame, history: DataFrame, key: str, folds: Sequence[Fold], cut, all_asked: bool = False
) -> DataFrame:
    """The folds of each key over history with ``block_id`` up to the cut, where there is any.

    ``history`` carries ``key`` and ``block_id``.  A cut shared by all keys (a
    number, Column or one-row DataFrame) or none (``None``) gives one row per
    asked key: the history is thinned to the asked keys, cut, and aggregated
    once; ``all_asked`` leaves the thinning out where nearly all keys are
    asked for.  ``PER_ROW`` gives one row per asked key and ``cut_id``.
    """
    names = [fold.name for fold in folds]
    if cut is PER_ROW:
        past = history.withColumnRenamed("block_id", "cut_id")
        values = fold_upto(asked, past, [key], "cut_id", folds)
        return values.where(reduce(or_, [F.col(name).isNotNull() for name in names]))
    past = history if cut is None else history.where(F.col("block_id") <= as_limit(cut))
    if not all_asked:
        past = past.join(asked.select(key).distinct(), key, "left_semi")
    return past.groupBy(key).agg(*_flat(folds, "first")).select(key, *names)


def found_at(
    rows: DataFrame, history: DataFrame, key: str, folds: Sequence[Fold], cut, all_asked: bool = False
) -> DataFrame:
    """``rows`` joined with what is known of their ``key`` at the cut; others are dropped."""
    place = [key, "cut_id"] if cut is PER_ROW else [key]
    return rows.join(known_at(rows, history, key, folds, cut, all_asked), place)
