"""Poll listings and emergency-shutdown joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, only
from ballotlake.functions.patterns import like_pattern
from ballotlake.model import RESULT, GovTables
from ballotlake.sources.located import at_block, with_hash


def active_polls(t: GovTables, poll_id=EVERY, hash_like=EVERY) -> DataFrame:
    """Polls their creator has not withdrawn, by end date; by id or by a LIKE on the hash."""
    polls = only(t.poll, "poll_id", poll_id)
    if hash_like is not EVERY:
        pattern = F.lit(like_pattern(hash_like)).cast("string")
        polls = polls.where(F.like("multi_hash", pattern))
    withdrawn = t.poll_withdrawal.where(F.col("block_withdrawn").isNotNull())
    return polls.join(withdrawn, ["poll_id", "creator"], "left_anti").select(
        "creator", "poll_id", "block_created", "start_date", "end_date", "multi_hash", "url"
    ).orderBy("end_date")


def shutdown_joins(t: GovTables, version: int = 1) -> DataFrame:
    """Emergency-shutdown joins with transaction hash and block time, NULL where unknown."""
    joins = t.shutdown_v1 if version == 1 else t.shutdown_v2
    placed = at_block(with_hash(joins, t.tx, "left"), t.block, "left")
    return placed.select(
        F.col("from_address").alias("tx_from"), "tx_hash",
        F.col("join_amount").cast(RESULT).alias("join_amount"), F.col("block_ts").alias("block_timestamp"),
    )
