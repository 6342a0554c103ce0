"""Wallet and locked balances, as of a block, a time or now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import NOW, AsOf
from ballotlake.functions.folds import running, total
from ballotlake.model import AMOUNT, RESULT, GovTables
from ballotlake.sources.located import at_block


def transfer_sides() -> Column:
    """Address, signed change and whether it was received, for both sides of a transfer."""
    return F.inline(F.array(
        F.struct(
            F.col("receiver").alias("address"), F.col("amount").alias("change"),
            F.lit(True).alias("received"),
        ),
        F.struct(
            F.col("sender").alias("address"), (-F.col("amount")).alias("change"),
            F.lit(False).alias("received"),
        ),
    ))


def _wallet_moves(t: GovTables, as_of: AsOf) -> DataFrame:
    """Both sides of every transfer, from one scan.

    The cut compares block ids with the greatest id of the blocks in range,
    not each block's own number or time.
    """
    transfers = t.transfer
    if not as_of.is_now:
        last = t.block.where(as_of.keeps("number", "block_ts")).agg(F.max("id"))
        transfers = transfers.where(F.col("block_id") <= last.scalar())
    return transfers.select(transfer_sides())


def _lock_moves(t: GovTables, as_of: AsOf) -> DataFrame:
    """Signed locks by caller; each lock is cut by its own block."""
    return at_block(t.lock, t.block).where(as_of.keeps()).select(
        F.col("immediate_caller").alias("address"), F.col("lock_amt").alias("change")
    )


def token_holders(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Received minus sent, for every address that ever received."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.token_holders(t, as_of)
    return (
        _wallet_moves(t, as_of).groupBy("address")
        .agg(F.sum("change").alias("balance"), F.bool_or("received").alias("received"))
        .where("received").select("address", F.col("balance").cast(RESULT).alias("balance"))
    )


def locked_balances(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Sum of signed locks per caller."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.locked_balances(t, as_of)
    return _lock_moves(t, as_of).groupBy("address").agg(
        F.sum("change").cast(RESULT).alias("balance")
    )


def ledger(t: GovTables, as_of: AsOf = NOW, among: DataFrame | None = None) -> DataFrame:
    """Per address: what moved and what is locked, and whether it is a holder.

    One aggregation over the union of transfer sides and locks, so an address
    is shuffled once where two aggregates and a full outer join take three.
    Addresses are never NULL; saying so gives every use of the ledger the same
    plan, so that Spark computes it once.
    ``moved`` counts as a wallet balance only for holders, see ``wallet_of``;
    ``locked`` is NULL unless the address locked.  ``among`` (one column,
    ``address``) thins the moves to some addresses before they are added up.
    """
    wallet = _wallet_moves(t, as_of).withColumn("locked", F.lit(None).cast("decimal(28,18)"))
    locked = _lock_moves(t, as_of).select(
        "address", F.lit(None).cast("decimal(28,18)").alias("change"),
        F.lit(False).alias("received"), F.col("change").alias("locked"),
    )
    known = wallet.unionByName(locked).where(F.col("address").isNotNull())
    if among is not None:
        known = known.join(among, "address", "left_semi")
    return known.groupBy("address").agg(
        F.sum("change").cast(AMOUNT).alias("moved"),
        F.sum("locked").cast(AMOUNT).alias("locked"),
        F.bool_or("received").alias("holder"),
    )


def or_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0).cast(AMOUNT))


def wallet_of() -> Column:
    """The wallet balance of a ledger row: NULL unless the address received."""
    return F.when(F.col("holder"), F.col("moved"))


def own_balances(accounts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wallet plus locked per row of a ledger, with the address the balance is listed under; ``by`` is kept.

    An address that only locked is listed under NULL: the listing takes its
    address from the holders' side.
    """
    return accounts.where(F.col("holder") | F.col("locked").isNotNull()).select(
        F.when(F.col("holder"), F.col("address")).alias("address"),
        (or_zero(wallet_of()) + or_zero(F.col("locked"))).cast(RESULT).alias("balance"),
        F.col("address").alias("account"), *by,
    )


def combined_balances(t: GovTables, as_of: AsOf = NOW) -> DataFrame:
    """Wallet plus locked balance; locked-only addresses appear under NULL."""
    if as_of.many:
        from ballotlake.operators import many_cuts
        return many_cuts.combined_balances(t, as_of)
    return own_balances(ledger(t, as_of)).select("address", "balance")


def running_balances(changes: DataFrame) -> DataFrame:
    """The balance of each address after each of its changes.

    ``changes``: address, change, position (unique within an address), tx_id
    and block_id.  Gives the stored-balance table, keyed by position.
    """
    after = running(changes, ["address"], "position", [total("amount", "change")])
    return after.select(
        F.col("position").alias("id"), "address", F.col("amount").cast(AMOUNT).alias("amount"),
        "tx_id", "block_id",
    )


def transfer_changes(transfers: DataFrame) -> DataFrame:
    """Balance changes of token transfers: the sender's side comes first."""
    sides = F.array(
        F.struct(F.col("sender").alias("address"), (-F.col("amount")).alias("change"),
                 (F.col("id") * 2).alias("position")),
        F.struct(F.col("receiver").alias("address"), F.col("amount").alias("change"),
                 (F.col("id") * 2 + 1).alias("position")),
    )
    return transfers.select("tx_id", "block_id", F.inline(sides))


def lock_changes(locks: DataFrame) -> DataFrame:
    """Balance changes of locks, by caller."""
    return locks.select(
        F.col("immediate_caller").alias("address"), F.col("lock_amt").alias("change"),
        F.col("id").alias("position"), "tx_id", "block_id",
    )
