"""Delegation contracts and the history of locks with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, only
from ballotlake.functions.folds import fold_upto, total
from ballotlake.functions.settle import settle
from ballotlake.functions.times import utc
from ballotlake.model import RESULT, GovTables
from ballotlake.sources.located import at_block, with_hash


def delegates(t: GovTables, with_time: bool = False) -> DataFrame:
    """Delegates and their contracts, optionally with the time they were created."""
    if not with_time:
        return t.delegate.select("delegate", "vote_delegate")
    return at_block(t.delegate, t.block, "left").select(
        "delegate", "vote_delegate", F.col("block_ts").alias("block_timestamp")
    )


def _placed(t: GovTables, locks: DataFrame, v2: bool) -> DataFrame:
    """Distinct locks with block number, time and hash.

    Two equal locks of one transaction are one row, and count once in totals.
    """
    who = ["from_address", "immediate_caller"] + (["contract_address"] if v2 else [])
    placed = with_hash(at_block(locks, t.block), t.tx)
    return placed.select(
        *who, F.col("lock_amt").alias("lock_amount"), "block_number", "block_ts", "tx_hash"
    ).distinct()


def _named(rows: DataFrame, v2: bool, *extra: str) -> DataFrame:
    contract = [F.col("contract_address").alias("delegate_contract_address")] if v2 else []
    return rows.select(
        "from_address", "immediate_caller", *contract,
        F.col("lock_amount").cast(RESULT).alias("lock_amount"), "block_number",
        F.col("block_ts").alias("block_timestamp"), *extra[:1], F.col("tx_hash").alias("hash"), *extra[1:],
    )


def delegated_by(t: GovTables, address=EVERY, v2: bool = False) -> DataFrame:
    """Distinct locks an address sent to delegation contracts.

    In the first generation the sender is ``from_address`` and the contract the
    caller; in the second the caller is the sender and the contract its own column.
    """
    locks = t.delegate_lock if v2 else t.lock
    sender, contract = ("immediate_caller", "contract_address") if v2 else ("from_address", "immediate_caller")
    contracts = t.delegate.select(F.col("vote_delegate").alias(contract)).distinct()
    sent = only(locks, sender, address).join(contracts, contract, "left_semi")
    return _named(_placed(t, sent, v2), v2)


def lock_history(
    t: GovTables,
    contracts,
    start: int | None,
    end: int | None,
    caller_totals: bool = False,
    v2: bool = False,
) -> DataFrame:
    """Locks of some contracts in a time window, with their running total since the first lock.

    The total runs over all chosen contracts together, in block order, and all
    locks of one block share it; ``caller_totals`` adds one per contract.  The
    totals are folded from one sum per block, so neither a busy contract nor
    the total over everything gathers in one task, and blocks outside the
    window only take part as sums.  The distinct locks are written once and read
    by each fold.
    """
    contract = "contract_address" if v2 else "immediate_caller"
    locks = only(t.delegate_lock if v2 else t.lock, contract, contracts)
    rows = settle(_placed(t, locks, v2), "locks")
    shown = rows.where((F.col("block_ts") >= utc(start)) & (F.col("block_ts") <= utc(end)))
    totals = fold_upto(shown, rows, [], "block_number", [total("lock_total", "lock_amount")])
    out = shown.join(totals, "block_number")
    extra = ["lock_total"]
    if caller_totals:
        per_caller = fold_upto(
            shown, rows, [contract], "block_number", [total("caller_lock_total", "lock_amount")]
        )
        out = out.join(per_caller, [contract, "block_number"])
        extra.append("caller_lock_total")
    out = out.withColumns({name: F.col(name).cast(RESULT) for name in extra})
    return _named(out, v2, *extra)


def all_locks_running(t: GovTables, start: int | None, end: int | None) -> DataFrame:
    """All locks in a time window with the running total of everything locked."""
    return lock_history(t, EVERY, start, end)
