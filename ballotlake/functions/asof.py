"""The one argument that says at which point in the chain to look."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlake.functions.times import utc


class _Every:
    """Marks 'all of them' where ``None`` would mean an SQL NULL."""

    def __repr__(self) -> str:
        return "EVERY"


EVERY = _Every()


@dataclass(frozen=True)
class AsOf:
    """A block number, a unix second, or now.

    The value may be a number or a Column (for instance a scalar subquery).
    A NULL value keeps nothing, as a NULL argument gives no rows.  Set-form
    operators also take a DataFrame, whose first column holds many of them.
    """

    kind: str
    value: Any = None

    @property
    def is_now(self) -> bool:
        return self.kind == "now"

    @property
    def many(self) -> bool:
        return isinstance(self.value, DataFrame)

    def keeps(self, number: str = "block_number", ts: str = "block_ts") -> Column:
        if self.kind == "block":
            limit = self.value if isinstance(self.value, Column) else F.lit(self.value).cast("bigint")
            return F.col(number) <= limit
        if self.kind == "unix":
            return F.col(ts) <= utc(self.value)
        return F.lit(True)


NOW = AsOf("now")


def block(number: int | Column | DataFrame | None) -> AsOf:
    return AsOf("block", number)


def unix(seconds: int | Column | DataFrame | None) -> AsOf:
    return AsOf("unix", seconds)


def as_limit(cut: int | Column | DataFrame | None) -> Column:
    """A block-id limit as a Column: number, column or one-row DataFrame."""
    if isinstance(cut, DataFrame):
        return cut.scalar()
    if isinstance(cut, Column):
        return cut
    return F.lit(cut).cast("bigint")


def many(wanted) -> bool:
    """Whether an argument asks for several values, so that results must name theirs."""
    return wanted is EVERY or isinstance(wanted, (list, tuple, set, DataFrame))


def one_column(spark: SparkSession, values, column: str, kind: T.DataType) -> DataFrame:
    """Python values of one type as a DataFrame, cast like any column; the same for every number of them."""
    values = sorted({value for value in values if value is not None})
    if not values:
        return spark.range(0).select(F.lit(None).cast(kind).alias(column))
    return spark.createDataFrame(pa.table({column: pa.array(values)})).select(F.col(column).cast(kind))


def only(df: DataFrame, column: str, wanted) -> DataFrame:
    """Rows whose ``column`` is the wanted value, among the wanted values, or all.

    A list or a one-column DataFrame becomes a semi-join, so it may be long.
    """
    if wanted is EVERY:
        return df
    if isinstance(wanted, DataFrame):
        keys = wanted.toDF(column).distinct()
        return df.join(keys, column, "left_semi")
    if isinstance(wanted, (list, tuple, set)):
        keys = one_column(df.sparkSession, wanted, column, df.schema[column].dataType)
        return df.join(keys, column, "left_semi")
    return df.where(F.col(column) == F.lit(wanted))
