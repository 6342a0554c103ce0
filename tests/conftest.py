from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from ballotlake.model import SCHEMAS, GovTables  # noqa: E402

EPOCH = dt.datetime(1970, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(field: T.StructField, value):
    if value is None:
        return None
    if isinstance(field.dataType, T.DecimalType):
        return Decimal(str(value))
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(value, (int, float)):
        return EPOCH + dt.timedelta(seconds=value)
    return value


_DEFAULT = {T.LongType(): 0, T.IntegerType(): 0, T.StringType(): "-"}


@pytest.fixture()
def tables(spark):
    """Tables from short rows: missing columns are filled, ids count up, a transaction per block.

    ``block=[(id, number, seconds)]`` also gives the transactions, with hash ``t<block id>``.
    """

    def build(**rows) -> GovTables:
        given = dict(rows)
        for block, tx in (("block", "tx"), ("block2", "tx2")):
            places = given.pop(block, [])
            given[block] = [
                {"id": i, "number": n, "hash": f"b{i}", "block_ts": s} for i, n, s in places
            ]
            given.setdefault(tx, [{"id": i, "hash": f"t{i}", "block_id": i} for i, _, _ in places])
        out = {}
        for name, schema in SCHEMAS.items():
            data = []
            for position, row in enumerate(given.get(name, []), start=1):
                row = {"id": position, **row}
                if "tx_id" in schema.names:
                    row.setdefault("tx_id", row["block_id"])
                full = []
                for field in schema.fields:
                    if field.name in row:
                        full.append(_value(field, row[field.name]))
                    elif field.nullable:
                        full.append(None)
                    else:
                        full.append(_DEFAULT[field.dataType])
                data.append(tuple(full))
            out[name] = spark.createDataFrame(data, schema)
        return GovTables(**out)

    return build


def rows(df, *columns) -> list[tuple]:
    """The rows, sorted, decimals as plain numbers, times as unix seconds."""
    def plain(value):
        if isinstance(value, Decimal):
            return float(value)
        if isinstance(value, dt.datetime):
            return (value - EPOCH).total_seconds()
        return value

    picked = df.select(*columns) if columns else df
    out = [tuple(plain(v) for v in row) for row in picked.collect()]
    return sorted(out, key=lambda row: tuple((v is None, str(type(v)), v) for v in row))
