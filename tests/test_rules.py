"""One small case per semantic rule, on hand-written rows."""

from __future__ import annotations

import pytest
from conftest import rows

from ballotlake.functions.asof import EVERY, NOW, block, unix
from ballotlake.operators import balances, blocks, locks, polls, proxies, tally, votes, weights

CHAIN = [(i, 100 + i, 1000 * i) for i in range(1, 11)]  # block i: number 100+i, at second 1000*i
POLL = {"creator": "c", "poll_id": 1, "start_date": 1000, "end_date": 10000, "block_id": 1}


def vote(voter, block_id, option=1, **more):
    return {"voter": voter, "poll_id": 1, "option_id": option, "option_id_raw": str(option),
            "block_id": block_id, "chain_id": 1, **more}


def test_no_block_before_the_time_gives_nothing(tables):
    t = tables(block=CHAIN, poll=[POLL], vote=[vote("a", 2)])
    assert rows(blocks.block_at(t, 500)) == []
    assert rows(blocks.block_at(t, None)) == []
    assert rows(tally.tally(t, 1, unix(500))) == []
    assert rows(tally.weighted_votes(t, 1, unix(None))) == []
    assert rows(tally.votes_at_block(t, 1, 999)) == []
    assert rows(votes.valid_votes(t, None)) == []
    assert rows(balances.token_holders(t, block(None))) == []


def test_window_and_cutoff_are_inclusive(tables):
    poll = {**POLL, "start_date": 2000, "end_date": 4000}
    t = tables(block=[*CHAIN, (11, 111, 4001)], poll=[poll],
               vote=[vote("early", 1), vote("start", 2), vote("end", 4), vote("late", 11)])
    assert rows(votes.valid_votes(t, 1), "voter") == [("end",), ("start",)]
    assert rows(votes.valid_votes(t, 1, unix(4000)), "voter") == [("end",), ("start",)]
    assert rows(votes.valid_votes(t, 1, unix(3999)), "voter") == [("start",)]
    assert rows(votes.valid_votes(t, 1, block(104)), "voter") == [("end",), ("start",)]


def test_block_at_takes_the_greatest_time_then_the_highest_id(tables):
    t = tables(block=[(1, 101, 1000), (2, 102, 3000), (3, 103, 2000), (4, 104, 3000)])
    assert rows(blocks.block_at(t, 3000)) == [(104,)]
    assert rows(blocks.block_at(t, 2999)) == [(103,)]


def test_blocks_at_answers_fractions_of_a_second(spark, tables):
    t = tables(block=[(1, 101, 1000), (2, 102, 1000.5), (3, 103, 1001), (4, 104, 5000)])
    asked = spark.createDataFrame([(999,), (1000,), (1001,), (4999,), (9000,)], "unix int")
    assert rows(blocks.blocks_at(t, asked)) == [
        (1000, 1, 101), (1001, 3, 103), (4999, 3, 103), (9000, 4, 104)]


def test_latest_balance_is_the_highest_id_not_the_latest_block(spark, tables):
    t = tables(block=CHAIN, wallet_balance=[
        {"id": 1, "address": "a", "amount": 10, "block_id": 9},
        {"id": 2, "address": "a", "amount": 20, "block_id": 5},
        {"id": 3, "address": "a", "amount": 30, "block_id": 10}])
    who = spark.createDataFrame([("a",)], "address string")
    assert rows(weights.canonical_weight(t, who, 9)) == [("a", 20.0)]
    assert rows(weights.canonical_weight(t, who, 4)) == [("a", 0.0)]


def lock(caller, amount, block_id, **more):
    return {"from_address": "f", "immediate_caller": caller, "lock_amt": amount,
            "contract_address": "vault", "block_id": block_id, **more}


def test_running_total_is_shared_in_a_block_and_equal_locks_count_once(tables):
    t = tables(block=CHAIN, lock=[
        lock("d", 5, 2), lock("d", 5, 2, log_index=1), lock("d", 7, 2), lock("e", 1, 3), lock("d", -2, 4)])
    history = locks.lock_history(t, EVERY, 0, 9999, caller_totals=True)
    assert rows(history, "immediate_caller", "lock_amount", "lock_total", "caller_lock_total") == [
        ("d", -2.0, 11.0, 10.0), ("d", 5.0, 12.0, 12.0), ("d", 7.0, 12.0, 12.0), ("e", 1.0, 13.0, 1.0)]


def test_running_total_starts_at_the_first_lock_not_at_the_window(tables):
    t = tables(block=CHAIN, lock=[lock("d", 5, 2), lock("d", 3, 6), lock("x", 100, 1)])
    assert rows(locks.lock_history(t, "d", 6000, 6000), "lock_amount", "lock_total") == [(3.0, 8.0)]
    assert rows(locks.lock_history(t, ["d", "x"], 6000, 6000), "lock_total") == [(108.0,)]
    assert rows(locks.all_locks_running(t, 0, 2000), "lock_total") == [(100.0,), (105.0,)]
    assert rows(locks.lock_history(t, "d", None, 6000)) == []


def test_delegated_by_needs_a_delegation_contract(tables):
    t = tables(block=CHAIN, delegate=[{"delegate": "g", "vote_delegate": "d", "block_id": 1}] * 2,
               lock=[lock("d", 5, 2), lock("d", 5, 2, log_index=1), lock("other", 1, 3)],
               delegate_lock=[{**lock("f", 4, 2), "contract_address": "d"},
                              {**lock("f", 4, 2), "contract_address": "no"}])
    assert rows(locks.delegated_by(t, "f"), "immediate_caller", "lock_amount") == [("d", 5.0)]
    assert rows(locks.delegated_by(t, "f", v2=True), "delegate_contract_address", "lock_amount") == [("d", 4.0)]
    assert rows(locks.delegates(t, with_time=True)) == [("g", "d", 1000.0), ("g", "d", 1000.0)]


# --- peculiar behaviour that has to be kept -------------------------------------------------


def test_voter_who_votes_again_after_the_cut_is_absent(tables):
    t = tables(block=CHAIN, poll=[POLL], vote=[vote("a", 5, 1), vote("a", 9, 2), vote("b", 6, 1)])
    assert rows(tally.weighted_votes(t, 1, cut=7), "voter") == [("b",)]
    assert rows(tally.weighted_votes(t, 1, cut=9), "voter", "option_id") == [("a", 2), ("b", 1)]


def test_cut_compares_second_chain_ids_with_a_first_chain_id(tables):
    t = tables(block=CHAIN, block2=[(900, 1, 2000)], poll=[POLL],
               vote=[vote("a", 5)], vote2=[{**vote("b", 900), "chain_id": 2}])
    assert rows(tally.weighted_votes(t, 1, unix(7000)), "voter") == [("a",)]
    assert rows(tally.weighted_votes(t, 1, cut=900), "voter") == [("a",), ("b",)]


def transfer(sender, receiver, amount, block_id):
    return {"sender": sender, "receiver": receiver, "amount": amount, "block_id": block_id}


def test_locked_only_address_is_listed_under_null(tables):
    t = tables(block=CHAIN, transfer=[transfer("mint", "a", 10, 1)], lock=[lock("a", 2, 2), lock("b", 3, 2)])
    assert rows(balances.combined_balances(t)) == [("a", 12.0), (None, 3.0)]
    assert rows(weights.voting_weights(t)) == [("a", 12.0), (None, 3.0)]
    assert rows(weights.voting_weights(t, NOW, "b")) == []


def proxy(hot, cold, contract, block_id, **more):
    return {"hot": hot, "cold": cold, "vote_proxy": contract, "block_id": block_id, **more}


def test_hot_equals_cold_counts_twice_in_the_set_form_only(spark, tables):
    t = tables(block=CHAIN, transfer=[transfer("mint", "h", 10, 1)],
               lock=[lock("h", 5, 1), lock("p", 1, 1)], proxy=[proxy("h", "h", "p", 2)],
               wallet_balance=[{"address": "h", "amount": 10, "block_id": 1}],
               locked_balance=[{"address": "h", "amount": 5, "block_id": 1},
                               {"address": "p", "amount": 1, "block_id": 1}])
    assert rows(weights.proxy_weights(t, block(105)), "total_weight") == [(31.0,)]
    assert rows(weights.party_weights(t, block(105))) == [("h", 31.0)]
    contract = spark.createDataFrame([("p",)], "address string")
    assert rows(weights.canonical_weight(t, contract, 5)) == [("p", 16.0)]
    assert rows(weights.canonical_weight(t, contract, 5, legacy=True)) == [("p", 21.0)]


def test_holders_are_receivers_and_zero_balances_stay(tables):
    t = tables(block=CHAIN, transfer=[transfer("mint", "a", 10, 1), transfer("a", "b", 10, 2)])
    assert rows(balances.token_holders(t)) == [("a", 0.0), ("b", 10.0)]
    assert rows(balances.token_holders(t, unix(1000))) == [("a", 10.0)]


def test_now_uses_funded_links_and_fans_out(tables):
    t = tables(block=CHAIN, poll=[POLL], vote=[vote("h", 5)], lock=[lock("p1", 1, 1), lock("p2", 2, 1), lock("p3", 0, 1)],
               proxy=[proxy("h", "c1", "p1", 2), proxy("h", "c2", "p2", 3), proxy("h", "c3", "p3", 4)])
    assert rows(proxies.funded_proxies(t)) == [("h", "c1", "p1", 1.0), ("h", "c2", "p2", 2.0)]
    assert rows(votes.votes_with_proxy(t, 1), "proxy_otherwise_voter", "cold") == [("p1", "c1"), ("p2", "c2")]
    assert rows(votes.votes_with_proxy(t, 1, block(110)), "proxy_otherwise_voter", "cold") == [("p3", "c3")]


def test_votes_of_one_block_all_stay_but_count_as_one_voter(tables):
    t = tables(block=CHAIN, poll=[POLL],
               vote=[vote("a", 4, 3), vote("a", 5, 1), vote("a", 5, 2, log_index=1), vote("b", 5, 2)])
    assert rows(votes.latest_votes(t, 1), "voter", "option_id") == [("a", 1), ("a", 2), ("b", 2)]
    assert rows(votes.unique_voters(t, 1)) == [(2,)]


def test_zero_and_null_ballots_do_not_count(tables):
    t = tables(block=CHAIN, poll=[POLL, {**POLL, "poll_id": 2}], vote=[
        vote("a", 5, 0), vote("b", 5, option_id_raw=None), vote("c", 5, 3), vote("d", 4, 3), vote("d", 6, 0)])
    assert rows(votes.unique_voters(t, 1)) == [(1,)]
    assert rows(votes.unique_voters(t, 7)) == [(0,)]
    assert rows(votes.unique_voters(t, None)) == []
    assert rows(votes.unique_voters(t)) == [(1, 1), (2, 0)]


def test_holders_cut_by_id_and_locks_by_their_own_block(tables):
    t = tables(block=[(1, 8, 1000), (2, 10, 2000), (3, 9, 3000)],
               transfer=[transfer("m", f"r{i}", i, i) for i in (1, 2, 3)],
               lock=[lock(f"l{i}", i, i) for i in (1, 2, 3)])
    assert rows(balances.token_holders(t, block(9)), "address") == [("r1",), ("r2",), ("r3",)]
    assert rows(balances.locked_balances(t, block(9)), "address") == [("l1",), ("l3",)]


def test_repeated_poll_rows_multiply_votes_but_not_voters(tables):
    t = tables(block=CHAIN, poll=[POLL, {**POLL, "log_index": 1}], vote=[vote("a", 5)])
    assert len(rows(votes.valid_votes(t, 1))) == 2
    assert len(rows(votes.canonical_votes(t, 1, 9))) == 1
    assert len(rows(votes.canonical_votes(t, 1, None, (1,)))) == 1


def test_legacy_votes_credit_links_made_after_the_cut(tables):
    t = tables(block=CHAIN, poll=[POLL], vote=[vote("h", 3)], proxy=[proxy("h", "c", "p", 8)],
               wallet_balance=[{"address": "h", "amount": 7, "block_id": 1}])
    assert rows(tally.weighted_votes(t, 1, cut=5, legacy=True), "voter", "amount") == [("p", 0.0)]
    assert rows(tally.weighted_votes(t, 1, cut=5), "voter", "amount") == [("h", 7.0)]


def test_legacy_weight_ignores_locked_balances_of_the_wallets(spark, tables):
    t = tables(block=CHAIN, proxy=[proxy("h", "c", "p", 2)],
               wallet_balance=[{"id": i, "address": a, "amount": i, "block_id": 1} for i, a in ((1, "h"), (2, "c"))],
               locked_balance=[{"id": i, "address": a, "amount": 10 * i, "block_id": 1}
                               for i, a in ((1, "h"), (2, "c"), (3, "p"))])
    contract = spark.createDataFrame([("p",)], "address string")
    assert rows(weights.canonical_weight(t, contract, 5)) == [("p", 63.0)]
    assert rows(weights.canonical_weight(t, contract, 5, legacy=True)) == [("p", 33.0)]


def test_weight_seen_from_the_wallet(spark, tables):
    t = tables(block=CHAIN, proxy=[proxy("h", "c", "p", 2), proxy("s", "s", "q", 2)],
               wallet_balance=[{"id": i, "address": a, "amount": i, "block_id": 1} for i, a in ((1, "h"), (2, "c"), (4, "s"))],
               locked_balance=[{"id": i, "address": a, "amount": 10 * i, "block_id": 1}
                               for i, a in ((1, "h"), (2, "c"), (3, "p"))])
    who = spark.createDataFrame([("h",), ("c",), ("s",), ("p",)], "address string")
    assert rows(weights.party_weight(t, who, 5)) == [("c", 53.0), ("h", 43.0), ("p", 30.0), ("s", 8.0)]
    assert rows(weights.party_weight(t, who, 1)) == [("c", 22.0), ("h", 11.0), ("p", 30.0), ("s", 4.0)]


def test_support_is_null_if_the_poll_ended_before_the_first_block(tables):
    early = {**POLL, "end_date": 5000}
    t = tables(block=[(1, 101, 9000)], block2=[(900, 1, 3000)], poll=[early],
               vote2=[{**vote("a", 900), "chain_id": 2}])
    assert rows(votes.current_votes(t, "a", now=20000)) == [(1, 1, "1", 3000.0, 2, None, "t900")]


def test_support_is_taken_now_or_at_the_end_of_the_poll(tables):
    t = tables(block=CHAIN, poll=[POLL], vote=[vote("a", 2)], wallet_balance=[
        {"id": i, "address": "a", "amount": i, "block_id": i} for i in range(1, 11)])
    assert rows(votes.current_votes(t, "a", now=6500), "support") == [(6.0,)]
    assert rows(votes.current_votes(t, "a", now=99999), "support") == [(10.0,)]
    assert rows(votes.current_votes(t, EVERY, now=6500), "address", "support") == [("a", 6.0)]


def test_last_vote_goes_by_time_across_chains(tables):
    t = tables(block=CHAIN, block2=[(3, 1, 5005)], poll=[POLL],
               vote=[vote("a", 5, 1)], vote2=[{**vote("a", 3, 2), "chain_id": 2}])
    assert rows(votes.canonical_votes(t, 1, 9), "voter", "option_id", "chain_id") == [("a", 2, 2)]
    assert rows(votes.current_votes(t, "a", 99999), "option_id", "hash") == [(2, "t3")]
    assert rows(votes.current_vote(t, "a", 1)) == [(1, 5)]


def test_tally_by_block_has_the_time_of_the_block_and_null_sums(tables):
    t = tables(block=[*CHAIN, (11, 105, 5500)], poll=[POLL], transfer=[transfer("m", "a", 10, 1)],
               vote=[vote("a", 2, 1), vote("z", 2, 2), vote("y", 3, None)])
    assert rows(tally.tally_by_block(t, 1, block(105))) == [
        (1, 10.0, 5000.0), (1, 10.0, 5500.0), (2, None, 5000.0), (2, None, 5500.0),
        (None, None, 5000.0), (None, None, 5500.0)]
    assert rows(tally.tally_by_block(t, 1, block(990)), "option_id", "block_timestamp") == [
        (1, None), (2, None), (None, None)]
    assert rows(tally.tally_by_block(t, 1)) == [(1, 10.0), (2, None), (None, None)]


@pytest.mark.parametrize("per_row", [False, True])
@pytest.mark.parametrize("links, asked, cut, expected", [
    ([("h", "c", "A", 5), ("h2", "c", "B", 8)], "h", 8, "h"),
    ([("h", "c", "A", 5), ("h2", "c", "B", 8)], "c", 8, "B"),
    ([("h", "c", "A", 5), ("h2", "c", "B", 8)], "h", 7, "A"),
    ([("h", "c", "A", 5), ("h2", "c", "B", 8)], "h", 4, "h"),
    ([("h", "c", "A", 8), ("h2", "c", "B", 8)], "h", 8, "A"),
    ([("h", "c", "A", 8), ("h2", "c", "B", 8)], "c", 8, "B"),
    ([("x", "x", "A", 3)], "x", 5, "A"),
    ([], "q", 5, "q"),
])
def test_canonical_voter(spark, tables, links, asked, cut, expected, per_row):
    from ballotlake.functions.folds import PER_ROW

    t = tables(block=CHAIN, proxy=[proxy(*link) for link in links])
    who = spark.createDataFrame([(asked, cut)], "address string, cut_id long")
    found = proxies.canonical_voter(t, who, PER_ROW if per_row else cut)
    assert rows(found, "canonical") == [(expected,)]


def test_canonical_voter_without_a_cut_takes_the_newest_link(spark, tables):
    t = tables(block=CHAIN, proxy=[proxy("h", "c", "A", 5), proxy("h2", "c", "B", 8)])
    who = spark.createDataFrame([("h",), ("c",), ("n",)], "address string")
    assert rows(proxies.canonical_voter(t, who), "address", "canonical") == [("c", "B"), ("h", "A"), ("n", "n")]


def test_active_links_are_the_latest_of_both_wallets(tables):
    t = tables(block=CHAIN, proxy=[proxy("h", "c", "A", 5), proxy("h2", "c", "B", 8), proxy("k", "k", "K", 1)])
    assert rows(proxies.active_proxies(t, block(105))) == [("h", "c", "A"), ("k", "k", "K")]
    assert rows(proxies.active_proxies(t, unix(8000))) == [("h2", "c", "B"), ("k", "k", "K")]


def test_linked_wallets_share_their_current_vote(tables):
    t = tables(block=CHAIN, poll=[POLL], proxy=[proxy("h", "c", "A", 2)], vote=[vote("h", 5, 2), vote("c", 3, 1)])
    assert rows(votes.current_vote(t, "c", 1)) == [(2, 5)]
    assert rows(votes.current_vote(t, "c", 1, raw=True)) == [("2", 5)]
    assert rows(votes.current_votes_by_voter(t, ["c"]), "voter", "option_id") == [("c", 1), ("h", 2)]
    assert rows(votes.current_vote(t, ["c", "h"], 1)) == [("c", 2, 5), ("h", 2, 5)]


def test_polls_withdrawn_by_another_creator_stay_active(tables):
    other = {**POLL, "creator": "x", "poll_id": 2, "multi_hash": r"Q\m_1", "end_date": 5}
    t = tables(poll=[POLL, other, {**POLL, "poll_id": 3}], poll_withdrawal=[
        {"creator": "y", "poll_id": 2, "block_id": 1, "block_withdrawn": 1},
        {"creator": "c", "poll_id": 3, "block_id": 1, "block_withdrawn": 1}])
    assert [row.poll_id for row in polls.active_polls(t).collect()] == [2, 1]
    assert rows(polls.active_polls(t, poll_id=3)) == []
    assert rows(polls.active_polls(t, poll_id=None)) == []
    assert rows(polls.active_polls(t, hash_like=r"Q\\m\_%"), "poll_id") == [(2,)]
    assert rows(polls.active_polls(t, hash_like=r"Q\\\m\_1"), "poll_id") == [(2,)]
    assert rows(polls.active_polls(t, hash_like=None)) == []


def test_shutdown_joins_keep_unknown_transactions(tables):
    join = {"from_address": "a", "join_amount": 3, "block_id": 2}
    t = tables(block=CHAIN, shutdown_v1=[join, {**join, "tx_id": 77, "log_index": 1}], shutdown_v2=[join])
    assert rows(polls.shutdown_joins(t)) == [("a", "t2", 3.0, 2000.0), ("a", None, 3.0, 2000.0)]
    assert rows(polls.shutdown_joins(t, 2)) == [("a", "t2", 3.0, 2000.0)]


def test_several_polls_at_once(spark, tables):
    second = {**POLL, "poll_id": 2}
    t = tables(block=CHAIN, poll=[POLL, second, {**POLL, "poll_id": 3}],
               vote=[vote("a", 5), {**vote("b", 6), "poll_id": 2}, {**vote("c", 6), "poll_id": 3}])
    wanted = spark.createDataFrame([(1,), (2,)], "p int")
    for polls_wanted in ([1, 2], wanted):
        assert rows(votes.valid_votes(t, polls_wanted), "poll_id", "voter") == [(1, "a"), (2, "b")]
        assert rows(votes.unique_voters(t, polls_wanted)) == [(1, 1), (2, 1)]
        assert rows(tally.weighted_votes(t, polls_wanted, cut=9), "poll_id", "voter") == [(1, "a"), (2, "b")]
        assert rows(tally.tally_by_block(t, polls_wanted), "poll_id", "option_id") == [(1, 1), (2, 1)]
    assert rows(votes.valid_votes(t, []), "poll_id") == []


def test_merged_votes_are_distinct(tables):
    t = tables(block=CHAIN, block2=[(3, 1, 5005)], proxy=[proxy("h", "c", "A", 2)],
               vote=[vote("h", 5), vote("h", 5, log_index=1)], vote2=[{**vote("c", 3), "chain_id": 2}])
    assert rows(votes.merged_votes(t, 9), "address", "block_id", "chain_id", "hash") == [
        ("A", 3, 2, "t3"), ("A", 5, 1, "t5")]


def test_equal_voters_each_get_the_weight(spark, tables):
    t = tables(block=CHAIN, wallet_balance=[{"address": "a", "amount": 10, "block_id": 1}, {"address": "b", "amount": 3, "block_id": 1}])
    who = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("none", 1)], "address string, ballot int")
    for weigh in (weights.canonical_weight, weights.party_weight):
        assert rows(weigh(t, who, 9)) == [("a", 1, 10.0), ("a", 1, 10.0), ("a", 2, 10.0), ("b", 1, 3.0), ("none", 1, 0.0)]
