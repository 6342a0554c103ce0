"""Every registered query: a name and a function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, NOW, block, unix
from ballotlake.functions.folds import PER_ROW, known_at, latest
from ballotlake.functions.settle import fresh_folder
from ballotlake.model import RESULT, SCHEMAS, GovTables
from ballotlake.operators import balances, blocks, locks, polls, proxies, quality, tally, votes, weights
from ballotlake.plans.probes import (
    AFTER, CALLERS, DURING, HASH_LIKE, LAST_POLL, LAST_VOTER, LOCKS_FROM, POLL, VOTER, VOTERS,
)
from ballotlake.sources.copysource import register
from ballotlake.sources.copytext import load_copy_text, write_copy_text
from ballotlake.sources.dump import load_dump, write_dump
from ballotlake.sources.events import event_tables
from ballotlake.sources.located import locate
from ballotlake.sources.logs import route_logs
from ballotlake.sources.snapshot import load_snapshot, save_snapshot
from ballotlake.sqlfunctions import register_functions
from ballotlake.streaming.balances import running_balance_stream, stored_balances
from ballotlake.streaming.events import dedupe_into, stream_table

Query = Callable[[SparkSession, str], DataFrame]


def _during_block(t: GovTables):
    return block(blocks.block_at(t, DURING).scalar())


def _cut(t: GovTables):
    return blocks.block_id_at(t, DURING).scalar()


WHEN = {"block": _during_block, "time": lambda t: unix(DURING), "now": lambda t: NOW}


def _wallets(t: GovTables) -> DataFrame:
    """Everyone who voted on the first chain or is a wallet of a proxy."""
    linked = t.proxy.select(F.explode(proxies.parties()).alias("address"))
    return t.vote.select(F.col("voter").alias("address")).union(linked).distinct()


def _accounts(t: GovTables) -> DataFrame:
    """Everyone with a stored balance, and all proxy contracts."""
    return (
        t.wallet_balance.select("address").union(t.locked_balance.select("address"))
        .union(t.proxy.select("vote_proxy")).distinct()
    )


def _amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.col("amount").cast(RESULT))


def _at_poll_ends(t: GovTables) -> DataFrame:
    """Who stood behind every voter of a poll when the poll ended."""
    cuts = blocks.blocks_at(t, tally.poll_end_requests(t)).select("poll_id", "cut_id")
    voted = t.vote.select("poll_id", F.col("voter").alias("address")).distinct()
    asked = voted.join(cuts, "poll_id").select("address", "cut_id").distinct()
    return proxies.canonical_voter(t, asked, PER_ROW)


def _voters_by_sketch(t: GovTables) -> DataFrame:
    """Different voters of every poll, and whether the merged sketches of its days come within three percent."""
    exact = votes.window_votes(t).groupBy("poll_id").agg(F.count_distinct("voter").alias("voters"))
    about = votes.estimated_voters(votes.voter_sketches(t)).withColumnRenamed("voters", "estimate")
    close = F.abs(F.col("estimate") - F.col("voters")) <= 0.03 * F.col("voters") + 1
    return exact.join(about, "poll_id").select("poll_id", "voters", close.cast("int").alias("within"))


def _poll_ends(t: GovTables):
    return unix(t.poll.select(F.col("end_date").cast("bigint")))


def _blocks_of_poll_ends(t: GovTables):
    return block(blocks.blocks_at(t, tally.poll_end_requests(t)).select("number"))


def _balances_at_votes(t: GovTables) -> DataFrame:
    """The wallet balance of each voter at the block of each of its votes."""
    history = t.wallet_balance.select("address", "block_id", "amount", "id")
    asked = t.vote.select(F.col("voter").alias("address"), F.col("block_id").alias("cut_id"))
    held = known_at(asked, history, "address", [latest("amount", "amount", "id")], PER_ROW)
    held = held.select(F.col("address").alias("voter"), F.col("cut_id").alias("block_id"), "amount")
    return _amount(t.vote.select("id", "voter", "block_id").join(held, ["voter", "block_id"], "left"))


def _replayed_transfers(t: GovTables) -> DataFrame:
    """The transfers delivered twice, then each once."""
    columns = ["id", "sender", "receiver", "amount", "block_id", "tx_id", "log_index"]
    twice = t.transfer.select(*columns).union(t.transfer.select(*columns))
    return _amount(quality.dedupe_events(twice))


def _retracted(t: GovTables) -> DataFrame:
    gone = t.block.where(~unix(DURING).keeps("number", "block_ts")).select("id")
    kept = quality.retract_blocks(t, gone)
    counts = [
        getattr(kept, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name in kept.names()
    ]
    return reduce(DataFrame.unionByName, counts)


def _routed(t: GovTables) -> DataFrame:
    first = {kind: f"0xc{kind}" for kind in ("click", "purchase", "signup", "view")}
    columns = ["id", "address", "topics", "data", "log_index", "tx_id", "block_id"]
    return route_logs(t.log.select(*columns), first, 1).unionByName(
        route_logs(t.log2.select(*columns), {"view": "0xcview"}, 2)
    )


def _merged_chains(t: GovTables) -> DataFrame:
    columns = ["id", "voter", "poll_id", "option_id", "option_id_raw", "block_id", "chain_id"]
    return votes.merge_chains((t.vote.select(*columns), 1), (t.vote2.select(*columns), 42161))


def _located_votes(t: GovTables) -> DataFrame:
    plain = t.vote.select("id", "voter", "poll_id", "option_id", "block_id", "tx_id")
    return locate(plain, t.block, t.tx).select(
        "id", "voter", "poll_id", "option_id", "block_number", "block_ts", "tx_hash"
    )


def _stored(t: GovTables, changes: DataFrame) -> DataFrame:
    return _amount(balances.running_balances(changes).select("id", "address", "amount", "block_id"))


def _copy_text_round_trip(t: GovTables) -> DataFrame:
    spark = t.lock.sparkSession
    path = fresh_folder(spark, "copy")
    columns = ["id", "from_address", "immediate_caller", "lock_amt", "contract_address", "log_index", "tx_id", "block_id"]
    write_copy_text(t.lock.select(*columns), path)
    return load_copy_text(spark, path, "lock", columns).select(*columns[:3], F.col("lock_amt").cast(RESULT).alias("lock_amt"), *columns[4:])


def _copy_source(t: GovTables, stream: bool) -> DataFrame:
    """Locks written and read in the format of the data source; as a stream, through a second folder."""
    spark = t.lock.sparkSession
    register(spark)
    path = fresh_folder(spark, "copytext")
    columns = ["id", "from_address", "immediate_caller", "lock_amt", "contract_address", "log_index", "tx_id", "block_id"]
    t.lock.select(*columns).write.format("copytext").mode("append").save(path)
    if stream:
        read = spark.readStream.format("copytext").option("table", "lock").option("path", path).load()
        path = fresh_folder(spark, "copytext-stream")
        out = read.writeStream.format("copytext").option("path", path).option("checkpointLocation", fresh_folder(spark, "mark"))
        out.trigger(availableNow=True).start().awaitTermination()
    again = spark.read.format("copytext").option("table", "lock").load(path)
    return again.select(*columns[:3], F.col("lock_amt").cast(RESULT).alias("lock_amt"), *columns[4:])


def _dump_round_trip(t: GovTables) -> DataFrame:
    """Locks and transfers as sections of dump files; the locks as they are read from there."""
    spark = t.lock.sparkSession
    path = fresh_folder(spark, "dump")
    columns = ["id", "from_address", "immediate_caller", "lock_amt", "contract_address", "log_index", "tx_id", "block_id"]
    write_dump(t.replace(lock=t.lock.select(*columns)), path, ["transfer", "lock"], files=2)
    again = load_dump(spark, path).lock
    return again.select(*columns[:3], F.col("lock_amt").cast(RESULT).alias("lock_amt"), *columns[4:])


def _snapshot_round_trip(t: GovTables) -> DataFrame:
    spark = t.vote.sparkSession
    path = fresh_folder(spark, "snapshot")
    save_snapshot(t, path, ["vote", "poll"])
    return load_snapshot(spark, path).vote.select("id", "voter", "poll_id", "option_id", "option_id_raw", "block_id", "chain_id")


def _streamed(t: GovTables, rows: DataFrame, table: str, start) -> str:
    """Runs a stream over rows of a table once, into a new folder."""
    spark = t.block.sparkSession
    source, out = fresh_folder(spark, "stream-in"), fresh_folder(spark, "stream-out")
    rows.write.parquet(source)
    query = start(stream_table(spark, source, table), out, fresh_folder(spark, "stream-mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def _balance_stream(t: GovTables) -> DataFrame:
    columns = SCHEMAS["transfer"].names
    out = _streamed(t, t.transfer.select(*columns), "transfer", lambda events, out, mark: running_balance_stream(
        balances.transfer_changes(events), out, mark))
    return _amount(stored_balances(t.block.sparkSession, out).select("id", "address", "amount", "block_id"))


def _deduped_stream(t: GovTables) -> DataFrame:
    columns = SCHEMAS["transfer"].names
    out = _streamed(t, t.transfer.select(*columns).union(t.transfer.select(*columns)), "transfer", dedupe_into)
    kept = t.block.sparkSession.read.parquet(out)
    return _amount(kept.select("id", "sender", "receiver", "amount", "block_id", "tx_id", "log_index"))


def _over_tables() -> dict[str, Callable[[GovTables], DataFrame]]:
    q: dict[str, Callable[[GovTables], DataFrame]] = {}

    # Polls and blocks.
    q["active_polls"] = polls.active_polls
    q["active_polls_by_id"] = lambda t: polls.active_polls(t, poll_id=POLL)
    q["active_polls_by_hash"] = lambda t: polls.active_polls(t, hash_like=HASH_LIKE)
    q["block_at"] = lambda t: blocks.block_at(t, DURING)
    q["blocks_at_poll_ends"] = lambda t: blocks.blocks_at(t, tally.poll_end_requests(t))

    # Votes in the window, with their proxy, and the last ones.
    for name, when, raw in (
        ("now", "now", False), ("time", "time", False), ("time_raw", "time", True), ("block", "block", False),
    ):
        at = WHEN[when]
        q[f"valid_votes_{name}"] = lambda t, at=at, raw=raw: votes.valid_votes(t, POLL, at(t), raw)
        q[f"votes_with_proxy_{name}"] = lambda t, at=at, raw=raw: votes.votes_with_proxy(t, POLL, at(t), raw)
        q[f"latest_votes_{name}"] = lambda t, at=at, raw=raw: votes.latest_votes(t, POLL, at(t), raw)
    q["valid_votes_all"] = votes.valid_votes
    q["votes_with_proxy_all"] = lambda t: votes.votes_with_proxy(t, EVERY, unix(DURING))
    q["latest_votes_all"] = lambda t: votes.latest_votes(t, EVERY, unix(DURING))
    q["unique_voters"] = lambda t: votes.unique_voters(t, POLL)
    q["unique_voters_all"] = votes.unique_voters
    q["voters_by_sketch"] = _voters_by_sketch

    # Canonical votes.
    q["canonical_votes_first_chain"] = lambda t: votes.canonical_votes(t, POLL, None, (1,))
    q["canonical_votes_first_chain_cut"] = lambda t: votes.canonical_votes(t, POLL, _cut(t), (1,))
    q["merged_votes"] = lambda t: votes.merged_votes(t, _cut(t))
    q["canonical_votes"] = lambda t: votes.canonical_votes(t, POLL, _cut(t))
    q["canonical_votes_all"] = lambda t: votes.canonical_votes(t, EVERY, _cut(t))

    # Current votes.
    q["current_vote"] = lambda t: votes.current_vote(t, LAST_VOTER, LAST_POLL)
    q["current_vote_raw"] = lambda t: votes.current_vote(t, LAST_VOTER, LAST_POLL, raw=True)
    q["current_vote_all"] = votes.current_vote
    q["current_votes"] = lambda t: votes.current_votes(t, VOTER, DURING)
    q["current_votes_all"] = lambda t: votes.current_votes(t, EVERY, DURING)
    q["current_votes_by_voter"] = lambda t: votes.current_votes_by_voter(t, VOTERS)
    q["current_votes_by_voter_all"] = votes.current_votes_by_voter

    # Proxies.
    q["funded_proxies"] = lambda t: proxies.funded_proxies(t)
    q["canonical_voter"] = lambda t: proxies.canonical_voter(t, _wallets(t))
    q["canonical_voter_cut"] = lambda t: proxies.canonical_voter(t, _wallets(t), _cut(t))
    q["canonical_voter_at_poll_ends"] = _at_poll_ends

    # Balances and set-form weights.
    for when, at in WHEN.items():
        q[f"active_proxies_{when}"] = lambda t, at=at: proxies.active_proxies(t, at(t))
        q[f"token_holders_{when}"] = lambda t, at=at: balances.token_holders(t, at(t))
        q[f"locked_balances_{when}"] = lambda t, at=at: balances.locked_balances(t, at(t))
        q[f"combined_balances_{when}"] = lambda t, at=at: balances.combined_balances(t, at(t))
        q[f"proxy_weights_{when}"] = lambda t, at=at: weights.proxy_weights(t, at(t))
        q[f"party_weights_{when}"] = lambda t, at=at: weights.party_weights(t, at(t))
        q[f"voting_weights_{when}"] = lambda t, at=at: weights.voting_weights(t, at(t))
        q[f"voting_weight_of_{when}"] = lambda t, at=at: weights.voting_weights(t, at(t), VOTER)

    # The same at many times or blocks at once: every poll's end, and the last block by then.
    for name, operator in (
        ("token_holders", balances.token_holders), ("locked_balances", balances.locked_balances),
        ("combined_balances", balances.combined_balances), ("active_proxies", proxies.active_proxies),
        ("proxy_weights", weights.proxy_weights), ("party_weights", weights.party_weights),
        ("voting_weights", weights.voting_weights),
    ):
        for kind, asked in (("times", _poll_ends), ("blocks", _blocks_of_poll_ends)):
            q[f"{name}_many_{kind}"] = lambda t, operator=operator, asked=asked: operator(t, asked(t))

    # Row-form weights.
    q["canonical_weight"] = lambda t: _amount(weights.canonical_weight(t, _accounts(t), _cut(t)))
    q["canonical_weight_legacy"] = lambda t: _amount(weights.canonical_weight(t, _accounts(t), _cut(t), True))
    q["party_weight"] = lambda t: _amount(weights.party_weight(t, _accounts(t), _cut(t)))

    # Weighted votes and tallies.
    q["weighted_votes_cut"] = lambda t: tally.weighted_votes(t, POLL, cut=_cut(t))
    q["weighted_votes_time"] = lambda t: tally.weighted_votes(t, POLL, unix(DURING))
    q["weighted_votes_after_end"] = lambda t: tally.weighted_votes(t, POLL, unix(AFTER))
    q["votes_at_block"] = lambda t: tally.votes_at_block(t, POLL, blocks.block_at(t, DURING).scalar())
    q["legacy_votes_cut"] = lambda t: tally.weighted_votes(t, POLL, cut=_cut(t), legacy=True)
    q["legacy_votes_time"] = lambda t: tally.weighted_votes(t, POLL, unix(DURING), legacy=True)
    q["ranked_ballots"] = lambda t: tally.ranked_ballots(t, POLL, unix(DURING))
    q["ranked_ballots_legacy"] = lambda t: tally.ranked_ballots(t, POLL, unix(DURING), legacy=True)
    q["tally_time"] = lambda t: tally.tally(t, POLL, unix(DURING))
    q["weighted_votes_all"] = lambda t: tally.weighted_votes_all(t, tally.poll_end_requests(t))
    q["tally_all"] = lambda t: tally.tally_all(t, tally.poll_end_requests(t))
    q["tally_block"] = lambda t: tally.tally_by_block(t, POLL, _during_block(t))
    q["tally_now"] = lambda t: tally.tally_by_block(t, POLL, NOW)
    q["tally_block_all"] = lambda t: tally.tally_by_block(t, EVERY, _during_block(t))

    # Delegation and locks.
    q["delegates"] = locks.delegates
    q["delegates_with_time"] = lambda t: locks.delegates(t, with_time=True)
    q["delegated_by"] = lambda t: locks.delegated_by(t, VOTER)
    q["delegated_by_all"] = locks.delegated_by
    q["delegated_by_v2"] = lambda t: locks.delegated_by(t, VOTER, v2=True)
    q["delegated_by_v2_all"] = lambda t: locks.delegated_by(t, v2=True)
    q["lock_history"] = lambda t: locks.lock_history(t, CALLERS[0], LOCKS_FROM, DURING)
    q["lock_history_list"] = lambda t: locks.lock_history(t, CALLERS, LOCKS_FROM, DURING)
    q["lock_history_totals"] = lambda t: locks.lock_history(t, CALLERS, LOCKS_FROM, DURING, True)
    q["lock_history_totals_v2"] = lambda t: locks.lock_history(t, CALLERS, LOCKS_FROM, DURING, True, True)
    q["lock_history_totals_all"] = lambda t: locks.lock_history(t, EVERY, LOCKS_FROM, DURING, True)
    q["lock_history_totals_v2_all"] = lambda t: locks.lock_history(t, EVERY, LOCKS_FROM, DURING, True, True)
    q["all_locks_running"] = lambda t: locks.all_locks_running(t, LOCKS_FROM, DURING)

    # Emergency-shutdown joins.
    q["shutdown_joins_v1"] = lambda t: polls.shutdown_joins(t, 1)
    q["shutdown_joins_v2"] = lambda t: polls.shutdown_joins(t, 2)

    # Data jobs.
    q["running_balances_wallet"] = lambda t: _stored(t, balances.transfer_changes(t.transfer))
    q["running_balances_locked"] = lambda t: _stored(t, balances.lock_changes(t.lock))
    q["balances_at_votes"] = _balances_at_votes
    q["dedupe_events"] = _replayed_transfers
    q["running_balances_stream"] = _balance_stream
    q["dedupe_events_stream"] = _deduped_stream
    q["copy_text_round_trip"] = _copy_text_round_trip
    q["dump_round_trip"] = _dump_round_trip
    q["copy_source_round_trip"] = lambda t: _copy_source(t, False)
    q["copy_source_stream"] = lambda t: _copy_source(t, True)
    q["snapshot_round_trip"] = _snapshot_round_trip
    q["retract_blocks"] = _retracted
    q["merge_chains"] = _merged_chains
    q["route_logs"] = _routed
    q["integrity_report"] = quality.integrity_report
    return q


def _called(name: str, *arguments: str) -> Callable[[GovTables], DataFrame]:
    """A function called in SQL; ``block`` stands for the number of the last block at the time asked."""
    def ask(t: GovTables) -> DataFrame:
        spark = t.block.sparkSession
        register_functions(spark, t)
        given = [str(blocks.block_at(t, DURING).first()[0]) if a == "block" else a for a in arguments]
        return spark.sql(f"SELECT * FROM {name}({', '.join(given)})")

    return ask


#: Functions as they are called in SQL.
SQL_CALLS = {
    "holders_on_block": ["block"],
    "holders_at_time": [str(DURING)],
    "holders_currently": [],
    "balance_on_block": ["block"],
    "balance_at_time": [str(DURING)],
    "combined_chief_and_mkr_balances_at_time": [str(DURING)],
    "all_active_vote_proxies": ["block"],
    "all_active_vote_proxies_at_time": [str(DURING)],
    "all_active_vote_proxies_currently": [],
    "total_mkr_weight_all_proxies_at_time": [str(DURING)],
    "hot_or_cold_weight": ["block"],
    "total_mkr_weight_proxy_and_no_proxy_at_time": [str(DURING)],
    "total_mkr_weight_proxy_and_no_proxy_by_address_at_time": [f"'{VOTER}'", str(DURING)],
    "valid_votes_at_time": [str(POLL), str(DURING)],
    "valid_votes_at_time_ranked_choice": [str(POLL), str(DURING)],
    "unique_voters": [str(POLL)],
    "unique_votes_1": [str(POLL)],
    "active_poll_by_id": [str(POLL)],
    "current_vote": [f"'{LAST_VOTER}'", str(LAST_POLL)],
    "time_to_block_number": [str(DURING)],
    "mkr_delegated_to": [f"'{VOTER}'"],
    "all_esm_joins": [],
}


def registry() -> dict[str, Query]:
    def over(question) -> Query:
        return lambda spark, sf_dir: question(event_tables(spark, sf_dir))

    out = {name: over(question) for name, question in _over_tables().items()}
    out |= {f"sql_{name}": over(_called(name, *arguments)) for name, arguments in SQL_CALLS.items()}
    # The load-time join itself, from facts that do not have the columns yet.
    out["locate_facts"] = lambda spark, sf_dir: _located_votes(event_tables(spark, sf_dir, located=False))
    return out
