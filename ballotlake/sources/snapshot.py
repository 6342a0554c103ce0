"""Saving the tables and getting them back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlake.model import SCHEMAS, GovTables

_LISTED = "_listed"
_CLUSTERED = {"block": "id", "block2": "id", "tx": "id", "tx2": "id"}


#: A file holds at most so many rows, so very large tables become more files, not larger ones.
ROWS_PER_FILE = 20_000_000


def save_snapshot(t: GovTables, path: str, tables: list[str] | None = None) -> None:
    """Every table as parquet, its rows in ranges of blocks.

    The tables go to a folder of their own and are listed last, so a reader sees the snapshot before or this one,
    never a mixture.  Ranges of blocks give each file narrow block-id bounds, so a cut by block skips the files after it.
    """
    names = tables or t.names()
    version = f"{time.time_ns()}-{uuid.uuid4().hex}"
    for name in names:
        df = getattr(t, name)
        order = "block_id" if "block_id" in df.columns and name not in _CLUSTERED else _CLUSTERED.get(name)
        if order:
            df = df.repartitionByRange(order).sortWithinPartitions(order)
        df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/{version}/{name}")
    listed = getattr(t, names[0]).sparkSession.createDataFrame([(version, name) for name in names], "version string, table string")
    listed.coalesce(1).write.mode("append").parquet(f"{path}/{_LISTED}")


def load_snapshot(spark: SparkSession, path: str, tables: list[str] | None = None) -> GovTables:
    """The tables of the newest whole snapshot, those it has; a table is opened when it is first used."""
    listed = spark.read.parquet(f"{path}/{_LISTED}")
    newest = listed.agg(F.max("version")).first()[0]
    names = {row[0] for row in listed.where(F.col("version") == newest).select("table").collect()}
    if missing := set(tables or ()) - names:
        raise ValueError(f"the snapshot has no {sorted(missing)}; it has {sorted(names)}")

    def reader(name: str):
        return lambda: spark.read.parquet(f"{path}/{newest}/{name}")

    return GovTables(**{name: reader(name) for name in tables or sorted(names)})


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the model's columns and types; amounts too large for the type are an error.

    Addresses lose the blanks a fixed-width column pads them with: padded and
    plain addresses would never join.
    """
    columns = []
    for field in SCHEMAS[table].fields:
        if field.name not in df.columns:
            if not field.nullable:
                raise ValueError(f"{table}: required column {field.name} is missing")
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(field.name)
        if field.name == "address":
            value = F.rtrim(value)
        if isinstance(field.dataType, T.DecimalType):
            value = _checked(value, field.dataType, f"{table}.{field.name}")
        elif isinstance(field.dataType, T.TimestampNTZType):
            value = _utc_wall_time(df, field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _checked(value, wanted: T.DecimalType, where: str):
    """The value in the wanted type, or an error that says which column does not fit."""
    fitted = value.try_cast(wanted)
    message = F.concat(F.lit(f"{where}: does not fit {wanted.simpleString()}: "), value.cast("string"))
    return F.when(value.isNull() | fitted.isNotNull(), fitted).otherwise(
        F.raise_error(message).cast(wanted)
    )


def _utc_wall_time(df: DataFrame, name: str):
    """A timestamp of any kind as UTC wall time."""
    value = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return value
    if isinstance(kind, T.StringType):
        value = value.cast("timestamp")
    micros = F.unix_micros(value)
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
