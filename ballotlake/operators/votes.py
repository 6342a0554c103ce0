"""Votes inside the poll window, and the last one of every voter."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballotlake.functions.asof import EVERY, NOW, AsOf, many, one_column, only, unix
from ballotlake.functions.folds import PER_ROW
from ballotlake.functions.settle import settle
from ballotlake.functions.times import utc
from ballotlake.model import GovTables
from ballotlake.operators.blocks import blocks_at
from ballotlake.operators.proxies import canonical_voter, links_for, parties, wallet_pairs
from ballotlake.sources.located import at_block, with_hash

# Fixed value: the time argument that stands for "now", 2038-01-19 03:14:07 UTC.
LAST_SECOND = 2147483647

_BALLOT = ["option_id", "option_id_raw"]


def _with_poll(columns: list[str], poll_id) -> list[str]:
    return ["poll_id", *columns] if many(poll_id) else columns


def _windows(t: GovTables) -> DataFrame:
    return t.poll.select(
        "poll_id", utc(F.col("start_date")).alias("opens"), utc(F.col("end_date")).alias("closes")
    )


def window_votes(t: GovTables, poll_id=EVERY, as_of: AsOf = NOW, chain: int = 1) -> DataFrame:
    """Votes of one chain whose block lies in the poll's window, both ends included."""
    votes, block = (t.vote, t.block) if chain == 1 else (t.vote2, t.block2)
    placed = at_block(only(votes, "poll_id", poll_id), block).where(as_of.keeps())
    return placed.join(_windows(t), "poll_id").where(
        (F.col("block_ts") >= F.col("opens")) & (F.col("block_ts") <= F.col("closes"))
    )


def valid_votes(t: GovTables, poll_id=EVERY, as_of: AsOf = NOW, raw: bool = False) -> DataFrame:
    """Votes in the window up to a block or time; ``raw`` gives the ranked ballot."""
    option = "option_id_raw" if raw else "option_id"
    return window_votes(t, poll_id, as_of).select(*_with_poll(["voter", option, "block_id"], poll_id))


def votes_with_proxy(t: GovTables, poll_id=EVERY, as_of: AsOf = NOW, raw: bool = False) -> DataFrame:
    """Valid votes with the proxy the voter is a wallet of, one row per such proxy.

    The voter may be the hot or the cold wallet: the link is listed under each
    of its wallets, so the join has one hashable key.
    """
    option = "option_id_raw" if raw else "option_id"
    links = links_for(t, as_of).select(
        F.explode(parties()).alias("voter"), "proxy", "hot", "cold"
    )
    columns = ["voter", option, "block_id", "proxy_otherwise_voter", "hot", "cold"]
    return (
        valid_votes(t, poll_id, as_of, raw).join(links, "voter", "left")
        .withColumn("proxy_otherwise_voter", F.coalesce("proxy", "voter"))
        .select(*_with_poll(columns, poll_id))
    )


def latest_votes(t: GovTables, poll_id=EVERY, as_of: AsOf = NOW, raw: bool = False) -> DataFrame:
    """The votes of each voter's last block; all of them if that block holds several.

    ``rank() = 1`` lets every map task drop all but its own last rows of a
    voter before the shuffle, so a very busy voter stays small.
    """
    votes = votes_with_proxy(t, poll_id, as_of, raw)
    voter = _with_poll(["proxy_otherwise_voter"], poll_id)
    newest = Window.partitionBy(*voter).orderBy(F.col("block_id").desc())
    return votes.withColumn("_rank", F.rank().over(newest)).where("_rank = 1").drop("_rank")


def unique_voters(t: GovTables, poll_id=EVERY) -> DataFrame:
    """How many voters' last vote is not the ballot '0'; NULL ballots do not count.

    A poll without votes counts 0, a NULL poll gives no row.  Grouping by voter replaces the distinct
    count, and packing (block, counts) into one number keeps the aggregation
    hashed: the greatest one tells if any vote of the last block counts.
    """
    votes = window_votes(t, poll_id, unix(LAST_SECOND))
    counts = F.coalesce(F.col("option_id_raw") != "0", F.lit(False)).cast("bigint")
    last = votes.groupBy("poll_id", "voter").agg(F.max(F.col("block_id") * 2 + counts).alias("last"))
    counted = F.count_if(F.col("last") % 2 == 1)
    if not many(poll_id):
        one = last.agg(counted.alias("unique_voters"))
        return one.where(F.lit(poll_id is not None))
    per_poll = last.groupBy("poll_id").agg(counted.alias("n"))
    return only(t.poll.select("poll_id").distinct(), "poll_id", poll_id).join(per_poll, "poll_id", "left").select(
        "poll_id", F.coalesce("n", F.lit(0)).alias("unique_voters")
    )


#: Sketches have 2^14 registers: a standard error of about 0.8 percent, and exact counts while voters are few.
SKETCH_BITS = 14


def voter_sketches(t: GovTables, poll_id=EVERY) -> DataFrame:
    """``poll_id, day, sketch``: who voted in a poll's window, per day, as a sketch of fixed size.

    Sketches of any days, chains or tables add up to that of their union, so new days are counted without
    a look at the old ones.
    """
    votes = window_votes(t, poll_id)
    return votes.groupBy("poll_id", F.to_date("block_ts").alias("day")).agg(
        F.hll_sketch_agg("voter", F.lit(SKETCH_BITS)).alias("sketch"))


def estimated_voters(sketches: DataFrame) -> DataFrame:
    """``poll_id, voters``: about how many different wallets voted, from sketches."""
    merged = sketches.groupBy("poll_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("poll_id", F.hll_sketch_estimate("sketch").alias("voters"))


def _merged(t: GovTables) -> list[DataFrame]:
    """The votes of both chains under one schema, with their block time."""
    columns = ["poll_id", "voter", *_BALLOT, "block_id", "chain_id", "block_ts", "log_index", "tx_id"]
    sides = []
    for chain, votes, block in ((1, t.vote, t.block), (2, t.vote2, t.block2)):
        placed = at_block(votes, block)
        kept = [*columns, "tx_hash"] if "tx_hash" in placed.columns else columns
        sides.append(placed.select(F.lit(chain).alias("side"), *kept))
    return sides


def merge_chains(*chains: tuple[DataFrame, int | None]) -> DataFrame:
    """The same event of several chains under one schema.

    Each chain comes with the chain id to fill in where its rows have none.
    """
    merged = None
    for events, chain_id in chains:
        own = F.col("chain_id") if "chain_id" in events.columns else F.lit(None).cast("int")
        events = events.withColumn("chain_id", F.coalesce(own, F.lit(chain_id).cast("int")))
        merged = events if merged is None else merged.unionByName(events, allowMissingColumns=True)
    return merged


def _hashed(t: GovTables, sides: DataFrame) -> DataFrame:
    """Adds ``tx_hash`` by the transaction table of each row's own chain."""
    if "tx_hash" in sides.columns:
        return sides.where(F.col("tx_hash").isNotNull())
    first = with_hash(sides.where("side = 1"), t.tx)
    return first.unionByName(with_hash(sides.where("side = 2"), t.tx2))


def merged_votes(t: GovTables, cut) -> DataFrame:
    """Votes of both chains under the canonical voter at a block id, without duplicates."""
    first, second = _merged(t)
    votes = _hashed(t, first.unionByName(second)).withColumnRenamed("voter", "address")
    votes = canonical_voter(t, votes, cut)
    return votes.select(
        "poll_id", F.col("canonical").alias("address"), *_BALLOT, "block_id", "chain_id",
        F.col("block_ts").alias("block_timestamp"), F.col("tx_hash").alias("hash"),
    ).distinct()


def _last(votes: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The row with the greatest order per key, as an aggregate that combines before the shuffle."""
    columns = list(dict.fromkeys([*order, *payload]))
    best = votes.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{name}").alias(name) for name in columns])


def canonical_votes(t: GovTables, poll_id=EVERY, cut=None, chains: tuple = (1, 2)) -> DataFrame:
    """The last vote of every canonical voter of a poll.

    Over the first chain alone 'last' goes by block, over both by block time;
    remaining ties by chain, block and log index.  ``cut`` is the block id the
    wallet links are looked up at (``None``: all links).  With ``PER_ROW``,
    ``poll_id`` is a DataFrame of ``poll_id, unix, cut_id`` requests, and every
    request is answered.

    The last vote of each wallet is taken first and canonical voters are
    looked up for those only: the greatest of the greatest is the greatest.
    """
    both = len(chains) > 1
    order = ["block_ts", "chain_id", "block_id", "log_index"] if both else ["block_id", "log_index"]
    sides = _merged(t)
    votes = sides[0].unionByName(sides[1]) if both else sides[0]
    per_row = cut is PER_ROW
    keys = ["poll_id", "unix", "cut_id"] if per_row else ["poll_id"]
    if per_row:
        requests = poll_id.select(*keys).distinct()
        votes = votes.join(requests.select("poll_id").distinct(), "poll_id", "left_semi")
    else:
        votes = only(votes, "poll_id", poll_id)
    hashes = ["tx_hash"] if both and "tx_hash" in votes.columns else []
    payload = ["block_id", "chain_id", "block_ts", *_BALLOT, *(["side", "tx_id"] if both else []), *hashes]

    votes = votes.join(_windows(t), "poll_id").where(
        (F.col("block_ts") >= F.col("opens")) & (F.col("block_ts") <= F.col("closes"))
    )
    # A wallet's last vote in its poll is the same for every request, so it is found before the requests are joined.
    votes = _last(votes, ["poll_id", "voter"], order, payload).withColumnRenamed("voter", "address")
    if per_row:
        votes = settle(votes.join(requests, "poll_id"), "votes")
    votes = canonical_voter(t, votes, cut).drop("address").withColumnRenamed("canonical", "voter")
    votes = _last(votes, [*keys, "voter"], order, payload)
    columns = ["voter", *_BALLOT, "block_id"]
    if both:
        votes = _hashed(t, votes).withColumns({"block_timestamp": F.col("block_ts"), "hash": F.col("tx_hash")})
        columns += ["chain_id", "block_timestamp", "hash"]
    return votes.select(*(keys + columns if per_row else _with_poll(columns, poll_id)))


def _asked(t: GovTables, addresses) -> DataFrame | None:
    """One or several addresses as a column; ``None`` for all."""
    if addresses is EVERY:
        return None
    if isinstance(addresses, DataFrame):
        return addresses.toDF("address").distinct()
    listed = addresses if isinstance(addresses, (list, tuple, set)) else [addresses]
    return one_column(t.vote.sparkSession, listed, "address", T.StringType())


def _heard(t: GovTables, votes: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The votes of the asked addresses and of the wallets linked to them: all others go before anything is added up."""
    if asked is None:
        return votes
    linked = wallet_pairs(t).join(asked, "address", "left_semi").select("voter")
    voters = asked.select(F.col("address").alias("voter")).union(linked).distinct()
    return votes.join(voters, "voter", "left_semi")


def _linked(t: GovTables, votes: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Votes listed under the voter (``address``) and under the wallet linked to it."""
    own = votes.withColumn("address", F.col("voter"))
    linked = votes.join(wallet_pairs(t), "voter")
    both = own.unionByName(linked)
    return both if asked is None else both.join(asked, "address", "left_semi")


def current_vote(t: GovTables, address=EVERY, poll_id=EVERY, raw: bool = False) -> DataFrame:
    """The last vote of an address or of the wallet linked to it, on the first chain."""
    option = "option_id_raw" if raw else "option_id"
    asked = _asked(t, address)
    votes = _heard(t, window_votes(t, poll_id, unix(LAST_SECOND) if raw else NOW), asked)
    order = ["block_id", "log_index"]
    votes = _last(votes, ["poll_id", "voter"], order, [option])
    votes = _last(_linked(t, votes, asked), ["poll_id", "address"], order, [option])
    columns = _with_poll([option, "block_id"], poll_id)
    return votes.select(*(["address"] if many(address) else []), *columns)


def latest_vote_per_poll(t: GovTables, addresses=EVERY) -> DataFrame:
    """Per address and poll: the last vote over both chains, of it or its linked wallet.

    Each chain's own last vote goes by block, the choice between the chains
    by block time.
    """
    order = ["block_id", "log_index"]
    payload = [*_BALLOT, "block_ts", "chain_id", "closes", "tx_id"]
    per_chain, asked = [], _asked(t, addresses)
    for chain in (1, 2):
        votes = _heard(t, window_votes(t, EVERY, NOW, chain), asked)
        kept = payload + (["tx_hash"] if "tx_hash" in votes.columns else [])
        votes = _last(votes, ["poll_id", "voter"], order, kept)
        votes = _last(_linked(t, votes, asked), ["poll_id", "address"], order, kept)
        per_chain.append(votes.withColumn("side", F.lit(chain)))
    both = per_chain[0].unionByName(per_chain[1])
    last = _last(
        both, ["poll_id", "address"], ["block_ts", "chain_id", "block_id", "log_index"],
        [*kept, "side"],
    )
    return _hashed(t, last)


def current_votes(t: GovTables, addresses=EVERY, now: int | None = None) -> DataFrame:
    """Latest vote per poll of an address, a list, or everyone, with its weight.

    The weight is taken at the poll's end, or at ``now`` (unix seconds,
    default: the clock) if that is earlier; it is NULL if no block is that old.
    """
    from ballotlake.operators.weights import canonical_weight

    now = int(time.time()) if now is None else now
    ends = t.poll.select(
        utc(F.col("end_date")).alias("closes"),
        F.least(F.col("end_date").cast("bigint"), F.lit(now).cast("bigint")).alias("unix"),
    ).distinct()
    cuts = blocks_at(t, ends).select("closes", "cut_id")
    # The cut goes onto the vote once; weights then come back by address and cut, however many polls share a cut.
    votes = settle(latest_vote_per_poll(t, addresses).join(cuts, "closes", "left"), "current_votes")
    asked = votes.where(F.col("cut_id").isNotNull()).select("address", "cut_id").distinct()
    voters = (
        canonical_voter(t, asked, PER_ROW)
        .select(F.col("address").alias("asker"), "cut_id", F.col("canonical").alias("address"))
    )
    weights = canonical_weight(t, settle(voters, "voters"), PER_ROW).select(
        F.col("asker").alias("address"), "cut_id", F.col("amount").alias("support"))
    columns = [
        "poll_id", *_BALLOT, F.col("block_ts").alias("block_timestamp"), "chain_id", "support",
        F.col("tx_hash").alias("hash"),
    ]
    return votes.join(weights, ["address", "cut_id"], "left").select(
        *(["address"] if many(addresses) else []), *columns
    )


def current_votes_by_voter(t: GovTables, addresses=EVERY) -> DataFrame:
    """Last first-chain vote per poll and voter, for a list of wallets and those linked to them."""
    votes = _heard(t, window_votes(t), _asked(t, addresses))
    votes = _last(votes, ["voter", "poll_id"], ["block_id", "log_index"], [*_BALLOT, "block_ts"])
    return votes.select(
        "voter", "poll_id", "option_id_raw", "option_id", F.col("block_ts").alias("block_timestamp")
    )

