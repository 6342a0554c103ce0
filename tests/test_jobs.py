"""Sources, sinks, repair jobs and streams."""

from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ballotlake.functions.asof import block, unix
from ballotlake.model import SCHEMAS
from ballotlake.operators import balances, quality, tally, votes
from ballotlake.sources.copytext import load_copy_text, write_copy_text
from ballotlake.sources.events import event_tables
from ballotlake.sources.located import locate_all
from ballotlake.sources.logs import route_logs, write_routed
from ballotlake.sources.snapshot import conform, load_snapshot, save_snapshot
from ballotlake.streaming.balances import rewind, running_balance_stream, stored_balances
from ballotlake.streaming.events import dedupe_batch, dedupe_into, dedupe_stream, stream_table

SF = "/root/testdata/sf0.001"
CHAIN = [(i, 100 + i, 1000 * i) for i in range(1, 9)]


def transfer(sender, receiver, amount, block_id, **more):
    return {"sender": sender, "receiver": receiver, "amount": amount, "block_id": block_id, **more}


def test_located_facts_give_the_same_answers(spark):
    located, plain = event_tables(spark, SF), event_tables(spark, SF, located=False)
    again = locate_all(plain)
    for question in (
        lambda t: votes.canonical_votes(t, 10, 500),
        lambda t: votes.valid_votes(t, as_of=block(7809600)),
        lambda t: tally.tally_by_block(t, 10, unix(1705449600)),
        lambda t: balances.locked_balances(t, unix(1705449600)),
    ):
        expected = rows(question(plain))
        assert rows(question(located)) == expected
        assert rows(question(again)) == expected


def test_snapshot_round_trip_and_reload_after_retraction(tables, tmp_path, spark):
    t = tables(block=CHAIN, transfer=[transfer("a", "b", i, i) for i in range(1, 9)],
               block2=CHAIN, vote2=[{"voter": "x", "poll_id": 1, "chain_id": 2, "block_id": 7}],
               proxy=[{"hot": "h", "cold": "c", "vote_proxy": "p", "block_id": 7, "tx_id": 2}])
    save_snapshot(t, f"{tmp_path}/one")
    loaded = load_snapshot(spark, f"{tmp_path}/one")
    for name in t.names():
        assert rows(getattr(loaded, name)) == rows(getattr(t, name)), name

    gone = spark.createDataFrame([(7,), (8,)], "id long")
    kept = quality.retract_blocks(loaded, gone)
    assert rows(kept.transfer, "block_id") == [(i,) for i in range(1, 7)]
    assert rows(kept.proxy) == [] and rows(kept.tx, "id")[-1] == (6,)
    assert len(rows(kept.block)) == 6 and len(rows(kept.vote2)) == 1 and len(rows(kept.block2)) == 8
    removed = loaded.transfer.join(kept.transfer, "id", "left_anti").select(*kept.transfer.columns)
    assert rows(kept.transfer.union(removed)) == rows(t.transfer)

    other = quality.retract_blocks(loaded, gone, chain=2)
    assert rows(other.vote2) == [] and len(rows(other.transfer)) == 8


def test_retracting_a_block_takes_facts_of_its_transactions(tables, spark):
    t = tables(block=CHAIN, transfer=[transfer("a", "b", 1, 3, tx_id=8)])
    assert rows(quality.retract_blocks(t, spark.createDataFrame([(8,)], "id long")).transfer) == []


def test_copy_text_round_trip(spark, tmp_path):
    data = [(1, "proc\tess", 5, "stopped", None), (2, "a\\b\nc", 6, "processing", "\\N"), (3, "", 7, "not-ready", "\\t")]
    df = spark.createDataFrame(data, SCHEMAS["job"])
    write_copy_text(df, f"{tmp_path}/job")
    assert rows(load_copy_text(spark, f"{tmp_path}/job", "job")) == data


def test_copy_text_types_and_errors(spark, tmp_path):
    (tmp_path / "block.tsv").write_text(
        "1\t7\t0xa\t2022-10-21 15:21:48+00\n2\t8\t0xb\t2022-10-21 17:21:48.5+02\n\\.\n")
    assert rows(load_copy_text(spark, f"{tmp_path}/block.tsv", "block")) == [
        (1, 7, "0xa", 1666365708.0), (2, 8, "0xb", 1666365708.5)]
    (tmp_path / "bal.tsv").write_text("4\t0xabc   \t12.5\t9\t3\n")
    columns = ["id", "address", "amount", "tx_id", "block_id"]
    loaded = load_copy_text(spark, f"{tmp_path}/bal.tsv", "wallet_balance", columns)
    assert rows(loaded) == [(4, "0xabc", 12.5, 9, 3)]
    (tmp_path / "bad.tsv").write_text("4\t0xabc\t12.5\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        load_copy_text(spark, f"{tmp_path}/bad.tsv", "wallet_balance", columns).collect()
    (tmp_path / "big.tsv").write_text("4\t0xabc\t" + "9" * 30 + "\t9\t3\n")
    with pytest.raises(Exception, match="does not fit"):
        load_copy_text(spark, f"{tmp_path}/big.tsv", "wallet_balance", columns).collect()


def test_conform_reads_zoned_times_as_utc(spark):
    df = spark.sql("select 1L id, 2L number, 'h' hash, timestamp_seconds(1666365708) block_ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert rows(conform(df, "block")) == [(1, 2, "h", 1666365708.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_integrity_report_finds_each_fault(spark, tables):
    t = tables(
        block=[*CHAIN, (1, 5, 5)], transfer=[transfer("a", "b", 1, 1), transfer("a", "b", 1, 1), transfer("a", "b", 1, 99)],
        job=[{"name": "j", "status": "processing"}, {"name": "j", "status": "odd"}])
    t = t.replace(transfer=t.transfer.withColumn("sender", F.when(F.col("id") > 1, F.col("sender"))))
    found = {(r[0], r[1], r[2]): r[3] for r in rows(quality.integrity_report(t)) if r[3]}
    assert found == {
        ("transfer", "null", "sender"): 1, ("transfer", "duplicate", "log_index, tx_id"): 1,
        ("transfer", "orphan", "block_id"): 1, ("transfer", "orphan", "tx_id"): 1,
        ("block", "duplicate", "id"): 1, ("block", "duplicate", "hash"): 1,
        ("tx", "duplicate", "id"): 1, ("tx", "duplicate", "hash"): 1,
        ("job", "duplicate", "name"): 1, ("job", "state", "status"): 1}


def test_logs_are_routed_by_contract(spark, tables, tmp_path):
    t = tables(block=CHAIN, log=[{"address": a, "block_id": 1, "log_index": i} for i, a in enumerate("xyxz")])
    routed = route_logs(t.log, {"first": "x", "second": "z"}, 1)
    assert rows(routed, "route", "log_index") == [("first", 0), ("first", 2), ("second", 3)]
    write_routed(routed, f"{tmp_path}/routed")
    assert spark.read.parquet(f"{tmp_path}/routed/chain=1/route=first").count() == 2


def test_merge_chains_fills_missing_chain_ids(spark):
    first = spark.createDataFrame([("a", None), ("b", 5)], "v string, chain_id int")
    second = spark.createDataFrame([("c",)], "v string")
    assert rows(votes.merge_chains((first, 1), (second, 2)), "v", "chain_id") == [("a", 1), ("b", 5), ("c", 2)]


def test_tables_do_not_depend_on_row_order(spark):
    t = event_tables(spark, SF)
    mixed = t.replace(**{
        name: getattr(t, name).orderBy(F.rand(3)) for name in ("vote", "vote2", "proxy", "wallet_balance")})
    for question in (
        lambda t: tally.tally(t, 10, unix(1705449600)), lambda t: votes.latest_votes(t, as_of=unix(1705449600)),
        lambda t: tally.weighted_votes_all(t, tally.poll_end_requests(t)),
    ):
        assert rows(question(mixed)) == rows(question(t))


def test_properties_over_the_event_tables(spark):
    t = event_tables(spark, SF)
    last = t.block.agg(F.max("number")).first()[0]
    assert rows(balances.token_holders(t)) == rows(balances.token_holders(t, block(last)))
    received = t.transfer.select(F.sum("amount")).first()[0]
    minted = t.transfer.where(~F.col("sender").isin([r[0] for r in balances.token_holders(t).select("address").collect()]))
    outside = minted.select(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    held = balances.token_holders(t).select(F.sum("balance")).first()[0]
    assert held == outside and received > 0
    requests = tally.poll_end_requests(t)
    voted = tally.weighted_votes_all(t, requests)
    assert voted.count() == voted.select("poll_id", "voter").distinct().count()
    assert rows(voted.groupBy("poll_id", "unix", "option_id").agg(F.sum("amount").cast("decimal(38,18)"))) == \
        rows(tally.tally_all(t, requests))
    ends = {r.poll_id: r.unix for r in requests.collect()}
    for poll in (0, 10, 24):
        one = tally.weighted_votes(t, poll, unix(ends[poll]))
        assert rows(one) == rows(voted.where(f"poll_id = {poll}").select(*one.columns))


# --- streams --------------------------------------------------------------------------------


def _write(df, path, condition):
    df.where(condition).coalesce(1).write.mode("append").parquet(path)


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_balance_stream_equals_batch_over_restarts(spark, tables, tmp_path):
    t = tables(block=CHAIN, transfer=[
        transfer("hot" if i % 3 else "m", "hot" if i % 2 else f"r{i % 5}", i, 1 + i // 8) for i in range(1, 60)])
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def start():
        events = stream_table(spark, source, "transfer", files_per_batch=1)
        _run(running_balance_stream(balances.transfer_changes(events), out, mark))

    _write(t.transfer, source, "id <= 20")
    _write(t.transfer, source, "id > 20 and id <= 31")
    start()
    _write(t.transfer, source, "id > 31")
    start()
    expected = rows(balances.running_balances(balances.transfer_changes(t.transfer)))
    assert rows(stored_balances(spark, out)) == expected

    rewind(spark, out, 4, f"{tmp_path}/out2")
    assert rows(stored_balances(spark, f"{tmp_path}/out2")) == [r for r in expected if r[4] <= 4]
    late = f"{tmp_path}/in2"
    _write(t.transfer, late, "block_id > 4")
    events = stream_table(spark, late, "transfer")
    _run(running_balance_stream(balances.transfer_changes(events), f"{tmp_path}/out2", f"{tmp_path}/mark2", 1))
    assert rows(stored_balances(spark, f"{tmp_path}/out2")) == expected


def test_a_repeated_micro_batch_changes_nothing(spark, tables, tmp_path):
    from ballotlake.streaming.balances import fold_batch

    t = tables(block=CHAIN, transfer=[transfer("a", "b", i, i) for i in range(1, 9)])
    changes = balances.transfer_changes(t.transfer)
    fold_batch(changes.where("block_id <= 4"), 0, f"{tmp_path}/o")
    fold_batch(changes.where("block_id > 4"), 1, f"{tmp_path}/o")
    once = rows(stored_balances(spark, f"{tmp_path}/o"))
    fold_batch(changes.where("block_id > 4"), 1, f"{tmp_path}/o")
    assert rows(stored_balances(spark, f"{tmp_path}/o")) == once
    with pytest.raises(Exception, match="comes after"):
        fold_batch(changes.where("block_id = 2"), 2, f"{tmp_path}/o")


@pytest.mark.parametrize("into", [False, True])
def test_dedupe_stream_drops_copies_across_restarts(spark, tables, tmp_path, into):
    t = locate_all(tables(block=CHAIN, transfer=[transfer("a", "b", i, i) for i in range(1, 9)]))
    columns = [*SCHEMAS["transfer"].names, "block_number", "block_ts", "tx_hash"]
    events = t.transfer.select(*columns)
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"

    def start():
        stream = stream_table(spark, source, "transfer", located=True, files_per_batch=1)
        if into:
            _run(dedupe_into(stream, out, mark))
        else:
            _run(dedupe_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark))

    _write(events.union(events), source, "id <= 5")
    start()
    _write(events, source, "id > 2")
    start()
    assert rows(spark.read.parquet(out), "id") == [(i,) for i in range(1, 9)]


def test_a_late_first_delivery_is_kept(spark, tables, tmp_path):
    events = tables(block=CHAIN, transfer=[transfer("a", "b", i, i) for i in range(1, 9)]).transfer
    out = f"{tmp_path}/out"
    for batch, condition in enumerate(("id > 4", "id IN (2, 6)", "id < 4 OR id = 8", "id = 1")):
        dedupe_batch(events.where(condition), batch, out)
    dedupe_batch(events.where("id < 4 OR id = 8"), 2, out)
    assert rows(spark.read.parquet(out), "id") == [(i,) for i in (1, 2, 3, 5, 6, 7, 8)]


def test_stream_state_is_put_together_and_old_state_goes(spark, tables, tmp_path, monkeypatch):
    from ballotlake.streaming import balances as stream

    monkeypatch.setattr(stream, "COMPACT", 2)
    t = tables(block=CHAIN, transfer=[transfer(f"a{i % 3}", f"b{i % 4}", i, i) for i in range(1, 10)])
    changes = balances.transfer_changes(t.transfer)
    for batch in range(9):
        stream.fold_batch(changes.where(f"block_id = {batch + 1}"), batch, f"{tmp_path}/o")
    assert rows(stored_balances(spark, f"{tmp_path}/o")) == rows(balances.running_balances(changes))
    left = sorted(os.listdir(f"{tmp_path}/o/last"))
    assert left == [f"batch={k}" for k in (6, 7, 8)] and sorted(os.listdir(f"{tmp_path}/o/whole")) == ["batch=5", "batch=7"]
    touched = spark.read.parquet(f"{tmp_path}/o/last/batch=8").count()
    assert touched == 2


def test_snapshot_tells_what_it_has_and_is_published_whole(spark, tables, tmp_path):
    t = tables(block=CHAIN, vote=[{"voter": "a", "poll_id": 1, "block_id": 1}])
    save_snapshot(t, f"{tmp_path}/s", ["block", "tx", "vote"])
    loaded = load_snapshot(spark, f"{tmp_path}/s")
    assert loaded.names() == ["block", "tx", "vote"] and "poll" not in loaded
    assert quality.integrity_report(loaded).count() > 0
    t.block.limit(1).write.parquet(f"{tmp_path}/s/99999999999999999999-broken/block")  # a snapshot that was not finished
    assert load_snapshot(spark, f"{tmp_path}/s").block.count() == len(CHAIN)
    with pytest.raises(ValueError, match="no \\['poll'\\]"):
        load_snapshot(spark, f"{tmp_path}/s", ["poll"])


def test_numbered_bytes_in_copy_text(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\t2\ta\\x41b\\101c\\\\x41\\xc3\\xa9\t1970-01-01 00:00:01\n")
    assert rows(load_copy_text(spark, f"{tmp_path}/c.tsv", "block"), "hash") == [("aAbAc\\x41é",)]


@pytest.mark.parametrize("values", [["7", "12"], [7, 12], [7.0, 12.0]])
def test_lists_of_any_length_are_read_alike(spark, values):
    from pyspark.sql import types as T

    from ballotlake.functions.asof import one_column
    kind = type(values[0])
    long_ = values + [kind(i) for i in range(1000, 2500)]
    for listed in (values, long_):
        out = one_column(spark, listed, "poll_id", T.IntegerType())
        assert out.schema["poll_id"].dataType == T.IntegerType() and out.count() == len(listed)
        assert out.where("poll_id in (7, 12)").count() == 2
    assert one_column(spark, [], "poll_id", T.IntegerType()).count() == 0
