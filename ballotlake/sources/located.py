"""Facts that carry the number and time of their block and the hash of their transaction.

Block and transaction tables grow as fast as the facts, so joining them in
every query is the largest shuffle of most queries.  ``locate`` does the join
once, at load; ``at_block`` and ``with_hash`` then read the columns, and fall
back to the join for facts that do not have them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.model import FIRST_CHAIN_FACTS, SECOND_CHAIN_FACTS, GovTables


def at_block(facts: DataFrame, block: DataFrame, how: str = "inner") -> DataFrame:
    """Facts with ``block_number`` and ``block_ts``; an inner join drops facts without a block."""
    if "block_ts" in facts.columns:
        return facts.where(F.col("block_ts").isNotNull()) if how == "inner" else facts
    place = block.select(
        F.col("id").alias("block_id"), F.col("number").alias("block_number"), "block_ts"
    )
    return facts.join(place, "block_id", how)


def with_hash(facts: DataFrame, tx: DataFrame, how: str = "inner") -> DataFrame:
    """Facts with ``tx_hash``; an inner join drops facts without a transaction."""
    if "tx_hash" in facts.columns:
        return facts.where(F.col("tx_hash").isNotNull()) if how == "inner" else facts
    return facts.join(tx.select(F.col("id").alias("tx_id"), F.col("hash").alias("tx_hash")), "tx_id", how)


def locate(facts: DataFrame, block: DataFrame, tx: DataFrame) -> DataFrame:
    """Every fact, with the three columns, NULL where the block or transaction is unknown."""
    placed = at_block(facts, block, "left") if "block_id" in facts.columns else facts
    return with_hash(placed, tx, "left") if "tx_id" in placed.columns else placed


def locate_all(tables: GovTables) -> GovTables:
    """The tables with every fact located; stored balances are only ever cut by block id."""
    def chain(names, block, tx):
        return {
            name: (lambda name=name: locate(
                getattr(tables, name), getattr(tables, block), getattr(tables, tx)))
            for name in names
            if name in tables and not name.endswith("_balance")
        }

    first = chain(FIRST_CHAIN_FACTS, "block", "tx")
    second = chain(SECOND_CHAIN_FACTS, "block2", "tx2") if "block2" in tables else {}
    return tables.replace(**first, **second)
