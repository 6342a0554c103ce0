"""Weighted votes and tallies, for one poll or for all polls in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, NOW, AsOf, as_limit, many
from ballotlake.functions.folds import PER_ROW
from ballotlake.functions.settle import settle
from ballotlake.model import RESULT, GovTables
from ballotlake.operators.blocks import block_id_at, block_id_of, blocks_at
from ballotlake.operators.votes import canonical_votes, latest_votes
from ballotlake.operators.weights import canonical_weight, voting_weights

_VOTE = ["voter", "option_id", "option_id_raw", "amount"]
_ORIGIN = ["chain_id", "block_timestamp", "hash"]


def cut_id(t: GovTables, as_of: AsOf) -> DataFrame:
    """The first-chain block id an as-of stands for, as one row or none."""
    if as_of.kind == "unix":
        return block_id_at(t, as_of.value)
    if as_of.kind == "block":
        return block_id_of(t, as_of.value)
    return t.block.agg(F.max(F.struct("block_ts", "id")).alias("last")).select("last.id")


def _value(t: GovTables, limit: Column) -> Column:
    """A limit worked out now: one number instead of the same subquery in every branch, and scans know it when planned."""
    found = t.block.sparkSession.range(1).select(limit.cast("bigint").alias("limit")).first()
    return F.lit(found[0]).cast("bigint")


def weighted_votes(t: GovTables, poll_id, as_of: AsOf | None = None, cut=None, legacy: bool = False) -> DataFrame:
    """The canonical votes of a poll with their weight, as of a block, a time or a block id.

    The last vote of the whole poll is chosen first and the cut applied to it,
    so a voter who voted again later is absent.  The cut is a first-chain block
    id and is compared with the block ids of both chains.  No block at the
    asked time means no rows.

    ``legacy`` is the rule of old polls: first chain only, wallet links looked
    up without a cut, and the legacy weight; it has no origin columns.
    """
    limit = _value(t, as_limit(cut_id(t, as_of) if cut is None else cut))
    if legacy:
        votes = canonical_votes(t, poll_id, None, chains=(1,))
    else:
        votes = canonical_votes(t, poll_id, limit)
    votes = votes.where(F.col("block_id") <= limit).withColumnRenamed("voter", "address")
    votes = settle(votes, "canonical_votes")
    voted = canonical_weight(t, votes, limit, legacy).withColumnRenamed("address", "voter")
    columns = _VOTE if legacy else _VOTE + _ORIGIN
    return voted.select(*(["poll_id", *columns] if many(poll_id) else columns))


def votes_at_block(t: GovTables, poll_id, number: int | None) -> DataFrame:
    """The weighted votes by block number, without origin columns."""
    return weighted_votes(t, poll_id, AsOf("block", number)).drop(*_ORIGIN)


def poll_end_requests(t: GovTables, now: int | None = None) -> DataFrame:
    """One request per poll and end: its end, or ``now`` if that is earlier."""
    end = F.col("end_date").cast("bigint")
    end = end if now is None else F.least(end, F.lit(now).cast("bigint"))
    return t.poll.select("poll_id", end.alias("unix")).distinct()


def weighted_votes_all(t: GovTables, requests: DataFrame) -> DataFrame:
    """The weighted votes of every request (``poll_id``, ``unix``) in one job.

    Each request has its own cut: block, wallet links and balances are looked
    up per request by running folds, not by one job per poll.
    """
    wanted = requests.select("poll_id", F.col("unix").cast("bigint").alias("unix")).distinct()
    asked = settle(blocks_at(t, wanted), "requests")
    votes = canonical_votes(t, asked, PER_ROW).where(F.col("block_id") <= F.col("cut_id"))
    votes = settle(votes.withColumnRenamed("voter", "address"), "canonical_votes")
    voted = canonical_weight(t, votes, PER_ROW).withColumnRenamed("address", "voter")
    return voted.select("poll_id", "unix", *_VOTE, *_ORIGIN)


def ranked_ballots(t: GovTables, poll_id, as_of: AsOf, legacy: bool = False) -> DataFrame:
    """Raw ballot and weight per voter, not summed."""
    return weighted_votes(t, poll_id, as_of, legacy=legacy).select(
        *(["poll_id"] if many(poll_id) else []), "option_id_raw", F.col("amount").alias("support")
    )


def _per_option(voted: DataFrame, keys: list[str]) -> DataFrame:
    return voted.groupBy(*keys, "option_id").agg(F.sum("amount").cast(RESULT).alias("support"))


def tally(t: GovTables, poll_id, as_of: AsOf) -> DataFrame:
    """Total weight per option, as of a time or block."""
    voted = weighted_votes(t, poll_id, as_of)
    return _per_option(voted, ["poll_id"] if many(poll_id) else [])


def tally_all(t: GovTables, requests: DataFrame) -> DataFrame:
    """Total weight per option for every request (``poll_id``, ``unix``)."""
    return _per_option(weighted_votes_all(t, requests), ["poll_id", "unix"])


def tally_by_block(t: GovTables, poll_id=EVERY, as_of: AsOf = NOW) -> DataFrame:
    """Set-form tally: last votes by wallet link, weights of all addresses.

    As of a block number the result has the time of that block, NULL if it is
    unknown and several rows if the number repeats.  An option whose voters all
    have no weight sums to NULL.
    """
    votes = latest_votes(t, poll_id, as_of)
    weights = voting_weights(t, as_of).withColumnRenamed("address", "voter")
    keys = ["poll_id", "option_id"] if many(poll_id) else ["option_id"]
    sums = [F.sum("weight").cast(RESULT).alias("support")]
    if as_of.kind != "block":
        return votes.join(weights, "voter", "left").groupBy(*keys).agg(*sums)
    asked = F.lit(as_of.value).cast("bigint")
    counted = votes.join(weights, "voter", "left").groupBy(*keys).agg(
        *sums, F.max(asked).alias("number")
    )
    times = t.block.where(F.col("number") == asked).select("number", F.col("block_ts").alias("block_timestamp"))
    return counted.join(times, "number", "left").select(*keys, "support", "block_timestamp")
