"""Functions called in SQL on small tables, beside their operators."""

from __future__ import annotations

from conftest import rows

from ballotlake.functions.asof import block, unix
from ballotlake.operators import balances, proxies, votes, weights
from ballotlake.sqlfunctions import register_functions


def test_functions_equal_their_operators(spark, tables):
    t = tables(
        block=[(1, 10, 100), (2, 11, 200), (3, 9, 300)],
        proxy=[{"cold": "c", "hot": "h", "vote_proxy": "p", "block_id": 1}, {"cold": "c", "hot": "x", "vote_proxy": "q", "block_id": 2}],
        transfer=[{"sender": "m", "receiver": "h", "amount": 5, "block_id": 1}, {"sender": "h", "receiver": "c", "amount": 2, "block_id": 3}],
        lock=[{"immediate_caller": "p", "lock_amt": 7, "block_id": 1}, {"immediate_caller": "z", "lock_amt": 1, "block_id": 3}],
        poll=[{"creator": "u", "poll_id": 4, "start_date": 0, "end_date": 250, "multi_hash": "a_b", "block_id": 1}],
        vote=[{"voter": "h", "poll_id": 4, "option_id": 1, "option_id_raw": "1", "block_id": 2}])
    names = register_functions(spark, t)
    assert len(names) == len(set(names)) > 35

    def called(text):
        return rows(spark.sql(f"SELECT * FROM {text}"))

    for at in (50, 100, 250, 400):
        assert called(f"holders_at_time({at})") == rows(balances.token_holders(t, unix(at)))
        assert called(f"combined_chief_and_mkr_balances_at_time({at})") == rows(balances.combined_balances(t, unix(at)))
        assert called(f"all_active_vote_proxies_at_time({at})") == rows(proxies.active_proxies(t, unix(at)))
        assert called(f"total_mkr_weight_proxy_and_no_proxy_at_time({at})") == rows(weights.voting_weights(t, unix(at)))
    for number in (8, 9, 10, 11):
        assert called(f"holders_on_block({number})") == rows(balances.token_holders(t, block(number)))
        assert called(f"balance_on_block({number})") == rows(balances.locked_balances(t, block(number)))
        assert called(f"hot_or_cold_weight({number})") == rows(weights.party_weights(t, block(number)))
        assert called(f"valid_votes_before_block(4, {number})") == rows(votes.valid_votes(t, 4, block(number)))
    assert called("unique_voters(4)") == [(1,)] and called("unique_voters(5)") == [(0,)] and called("unique_voters(NULL)") == []
    assert called("holders_at_time(NULL)") == [] and called("time_to_block_number(50)") == [] and called("time_to_block_number(250)") == [(11,)]
    assert len(called("active_poll_by_multihash('a\\\\_b')")) == 1 and called("active_poll_by_multihash('x%')") == []
    found = spark.sql("SELECT a, unique_voter_address_1(a) AS b FROM VALUES ('c'), ('h'), ('nobody') AS v(a)")
    assert rows(found) == [("c", "q"), ("h", "p"), ("nobody", "nobody")]
