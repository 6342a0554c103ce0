"""Which block is the last one at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import unix
from ballotlake.functions.folds import fold_upto, latest
from ballotlake.functions.times import first_second_at
from ballotlake.model import GovTables

SECOND_BITS = 12
"""Zones of 4096 seconds: 2**19 of them span all 32-bit times, and few hold a request."""


def _last_block(t: GovTables, seconds) -> DataFrame:
    """The block with the greatest time not after ``seconds``; equal times go to the higher id."""
    return (
        t.block.where(unix(seconds).keeps("number", "block_ts"))
        .agg(F.max(F.struct("block_ts", "id", "number")).alias("last"))
        .where(F.col("last").isNotNull()).select("last.id", "last.number")
    )


def block_at(t: GovTables, seconds: int | None) -> DataFrame:
    """Number of the last block at a unix second: one row, or none before the first block."""
    return _last_block(t, seconds).select("number")


def block_id_at(t: GovTables, seconds: int | None) -> DataFrame:
    """Id of the last block at a unix second: one row, or none before the first block."""
    return _last_block(t, seconds).select("id")


def block_id_of(t: GovTables, number: int | None) -> DataFrame:
    """Id of the block with a number: one row, or none; the highest id if the number repeats."""
    return (
        t.block.where(F.col("number") == F.lit(number)).agg(F.max("id").alias("id"))
        .where(F.col("id").isNotNull())
    )


def blocks_at(t: GovTables, requests: DataFrame) -> DataFrame:
    """``requests`` with a column ``unix`` get ``cut_id`` and ``number`` of the last block then.

    All distinct seconds are answered in one pass over the blocks; requests
    before the first block are dropped.
    """
    history = t.block.select(
        first_second_at(F.col("block_ts")).alias("unix"),
        F.struct("id", "number").alias("found"), F.struct("block_ts", "id").alias("order"),
    )
    asked = requests.select(F.col("unix").cast("bigint").alias("unix")).where("unix is not null")
    last = [latest("last", "found", "order")]
    answers = fold_upto(asked, history, [], "unix", last, SECOND_BITS).where(F.col("last").isNotNull())
    found = answers.select("unix", F.col("last.id").alias("cut_id"), F.col("last.number").alias("number"))
    return requests.join(found, "unix")
