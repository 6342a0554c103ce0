"""The operators as functions of SQL: ``SELECT * FROM holders_at_time(1704067200)``.

``register_functions(spark, t)`` makes views ``gov_…`` of the tables, and temporary functions over them.  A function is one statement
whose argument stands in filters of its steps, so Spark folds it into the scans like a constant; steps that several functions share are
kept once here.  Functions without a point in time read a view of the operator itself, and filters on a poll or an address reach into it.
Where a name stands for functions of one and of two arguments, the number is part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.functions.asof import EVERY, NOW
from ballotlake.model import GovTables
from ballotlake.operators import balances, locks, polls, proxies, tally, votes, weights
from ballotlake.operators.balances import transfer_sides
from ballotlake.sources.located import at_block

_WEIGHT = "DECIMAL(38,18)"
_TIME = "timestampadd(SECOND, unix, TIMESTAMP_NTZ'1970-01-01 00:00:00')"
#: What is in range: by the argument ``unix`` or ``number``.
_RANGE = {"unix": f"block_ts <= {_TIME}", "number": "block_number <= number"}


def _steps(by: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Each step's text, and the steps it reads."""
    seen = _RANGE[by]
    return {
        "reach": (f"SELECT max(id) AS id FROM gov_block WHERE {seen}", ()),
        "holders": ("SELECT address, sum(change) AS balance FROM gov_sides WHERE block_id <= (SELECT id FROM reach) "
                    "GROUP BY address HAVING bool_or(received)", ("reach",)),
        "locked": (f"SELECT immediate_caller AS address, sum(lock_amt) AS balance FROM gov_lock WHERE {seen} GROUP BY immediate_caller", ()),
        "combined": ("SELECT h.address, coalesce(h.balance, 0) + coalesce(l.balance, 0) AS balance "
                     "FROM holders h FULL JOIN locked l ON h.address = l.address", ("holders", "locked")),
        "seen": (f"SELECT id, hot, cold, vote_proxy, block_id FROM gov_proxy WHERE {seen}", ()),
        "newest": ("SELECT party, max(block_id) AS block_id FROM (SELECT explode(array_distinct(array(hot, cold))) AS party, block_id "
                   "FROM seen) GROUP BY party", ("seen",)),
        "links": ("SELECT s.id, s.hot, s.cold, s.vote_proxy AS proxy FROM seen s JOIN newest h ON h.party = s.hot AND h.block_id = s.block_id "
                  "JOIN newest c ON c.party = s.cold AND c.block_id = s.block_id", ("seen", "newest")),
        "members": ("SELECT id, hot, cold, proxy, inline(array(named_struct('address', hot, 'own', true), "
                    "named_struct('address', cold, 'own', true), named_struct('address', proxy, 'own', false))) FROM links", ("links",)),
        "weighed": (f"SELECT m.hot, m.cold, m.proxy, CAST(sum(coalesce(if(m.own, CAST(h.balance AS DECIMAL(36,18)), 0), 0) "
                    f"+ coalesce(CAST(l.balance AS DECIMAL(36,18)), 0)) AS {_WEIGHT}) AS total_weight FROM members m "
                    "LEFT JOIN holders h ON h.address = m.address LEFT JOIN locked l ON l.address = m.address "
                    "GROUP BY m.id, m.hot, m.cold, m.proxy", ("members", "holders", "locked")),
        "by_party": ("SELECT DISTINCT explode(array(hot, cold)) AS address, total_weight FROM weighed", ("weighed",)),
        "weights": (f"SELECT address, total_weight AS weight FROM by_party UNION ALL SELECT c.address, CAST(c.balance AS {_WEIGHT}) "
                    "FROM combined c LEFT ANTI JOIN by_party p ON p.address = c.address", ("by_party", "combined")),
    }


def _statement(by: str, step: str, select: str) -> str:
    steps, order = _steps(by), []

    def need(name: str) -> None:
        for other in steps[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    need(step)
    return "WITH " + ", ".join(f"{name} AS ({steps[name][0]})" for name in order) + f" SELECT {select} FROM {step}"


# Names of functions, by what stands behind them: (by number, by second, now), the step, and the columns.
_FORMS = [
    (("holders_on_block", "holders_at_time", "holders_currently"), "holders", {"address": "STRING", "balance": _WEIGHT}),
    (("balance_on_block", "balance_at_time", "balance_currently"), "locked", {"address": "STRING", "balance": _WEIGHT}),
    (("combined_chief_and_mkr_balances", "combined_chief_and_mkr_balances_at_time", "combined_chief_and_mkr_balances_currently"),
     "combined", {"address": "STRING", "balance": _WEIGHT}),
    (("all_active_vote_proxies", "all_active_vote_proxies_at_time", None), "links", {"hot": "STRING", "cold": "STRING", "proxy": "STRING"}),
    (("total_mkr_weight_all_proxies", "total_mkr_weight_all_proxies_at_time", "total_mkr_weight_all_proxies_currently"),
     "weighed", {"hot": "STRING", "cold": "STRING", "proxy": "STRING", "total_weight": _WEIGHT}),
    (("hot_or_cold_weight", "hot_or_cold_weight_at_time", "hot_or_cold_weight_currently"), "by_party", {"address": "STRING", "total_weight": _WEIGHT}),
    (("total_mkr_weight_proxy_and_no_proxy", "total_mkr_weight_proxy_and_no_proxy_at_time", "total_mkr_weight_proxy_and_no_proxy_currently"),
     "weights", {"address": "STRING", "weight": _WEIGHT}),
]
_OPERATORS = {
    "holders": balances.token_holders, "locked": balances.locked_balances, "combined": balances.combined_balances,
    "weighed": weights.proxy_weights, "by_party": weights.party_weights, "weights": weights.voting_weights,
}


def _views(t: GovTables) -> dict[str, DataFrame]:
    number = F.col("number").alias("block_number")
    out = {
        "gov_block": t.block.select("id", number, "block_ts"),
        "gov_sides": t.transfer.select("block_id", transfer_sides()),
        "gov_lock": at_block(t.lock, t.block),
        "gov_proxy": at_block(t.proxy, t.block),
        "gov_parties": t.proxy.select(F.explode(proxies.parties()).alias("party"), "vote_proxy", "id"),
        "gov_votes_in_window": votes.window_votes(t),
        "gov_unique_voters": votes.unique_voters(t, EVERY),
        "gov_active_polls": polls.active_polls(t),
        "gov_current_vote": votes.current_vote(t),
        "gov_current_ballot": votes.current_vote(t, raw=True),
        "gov_unique_votes": votes.canonical_votes(t, EVERY, None, (1,)),
        "gov_funded_proxies": proxies.funded_proxies(t),
        "gov_tally_now": tally.tally_by_block(t, EVERY, NOW),
        "gov_delegates": locks.delegates(t),
        "gov_delegates_in_time": locks.delegates(t, with_time=True),
        "gov_delegated_by": locks.delegated_by(t),
        "gov_delegated_by_v2": locks.delegated_by(t, v2=True),
        "gov_shutdown_v1": polls.shutdown_joins(t, 1),
        "gov_shutdown_v2": polls.shutdown_joins(t, 2),
    }
    return out | {f"gov_now_{step}": operator(t) for step, operator in _OPERATORS.items()}


def _declared(df: DataFrame, without: tuple[str, ...] = ()) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in without}


def _functions(views: dict[str, DataFrame]) -> list[tuple[str, str, dict[str, str] | str, str]]:
    """(name, arguments, columns of the result or its type, body)"""
    out = []
    for (by_number, by_second, now), step, columns in _FORMS:
        shown = ", ".join(f"CAST({c} AS {_WEIGHT}) AS {c}" if kind == _WEIGHT else c for c, kind in columns.items())
        out.append((by_number, "number BIGINT", columns, _statement("number", step, shown)))
        out.append((by_second, "unix BIGINT", columns, _statement("unix", step, shown)))
        if now:
            out.append((now, "", columns, f"SELECT {', '.join(columns)} FROM gov_now_{step}"))
    weight = {"weight": _WEIGHT}
    name = "total_mkr_weight_proxy_and_no_proxy_by_address"
    for by, suffix in (("number", ""), ("unix", "_at_time")):
        out.append((name + suffix, f"wanted STRING, {by} BIGINT", {"address": "STRING", **weight},
                    _statement(by, "weights", "address, weight") + " WHERE address = wanted"))
    out.append((f"{name}_currently", "wanted STRING", {"address": "STRING", **weight}, "SELECT address, weight FROM gov_now_weights WHERE address = wanted"))

    in_window = {"voter": "STRING", "option_id": "INT", "block_id": "BIGINT"}
    ballots = {"voter": "STRING", "option_id_raw": "STRING", "block_id": "BIGINT"}
    window = "FROM gov_votes_in_window WHERE poll_id = poll"
    for name in ("valid_votes", "valid_votes_currently"):
        out.append((name, "poll INT", in_window, f"SELECT voter, option_id, block_id {window}"))
    out.append(("valid_votes_at_time", "poll INT, unix BIGINT", in_window, f"SELECT voter, option_id, block_id {window} AND {_RANGE['unix']}"))
    out.append(("valid_votes_at_time_ranked_choice", "poll INT, unix BIGINT", ballots, f"SELECT voter, option_id_raw, block_id {window} AND {_RANGE['unix']}"))
    out.append(("valid_votes_before_block", "poll INT, number BIGINT", in_window, f"SELECT voter, option_id, block_id {window} AND {_RANGE['number']}"))
    out.append(("time_to_block_number", "unix BIGINT", {"number": "BIGINT"},
                f"SELECT last.block_number FROM (SELECT max(struct(block_ts, id, block_number)) AS last FROM gov_block WHERE {_RANGE['unix']}) WHERE last IS NOT NULL"))
    out.append(("unique_voters", "poll INT", {"unique_voters": "BIGINT"},
                "SELECT coalesce(max(unique_voters), 0) FROM gov_unique_voters WHERE poll_id = poll HAVING poll IS NOT NULL"))
    polls_ = _declared(views["gov_active_polls"])
    out.append(("active_polls", "", polls_, f"SELECT {', '.join(polls_)} FROM gov_active_polls"))
    out.append(("active_poll_by_id", "poll INT", polls_, f"SELECT {', '.join(polls_)} FROM gov_active_polls WHERE poll_id = poll"))
    out.append(("active_poll_by_multihash", "pattern STRING", polls_, f"SELECT {', '.join(polls_)} FROM gov_active_polls WHERE multi_hash LIKE pattern"))
    for name, view in (("current_vote", "gov_current_vote"), ("current_vote_ranked_choice", "gov_current_ballot")):
        columns = _declared(views[view], ("address", "poll_id"))
        out.append((name, "wanted STRING, poll INT", columns, f"SELECT {', '.join(columns)} FROM {view} WHERE address = wanted AND poll_id = poll"))
    for name, view, argument, column in (
        ("unique_votes_1", "gov_unique_votes", "poll INT", "poll_id"),
        ("vote_option_mkr_weights_currently", "gov_tally_now", "poll INT", "poll_id"),
        ("mkr_delegated_to", "gov_delegated_by", "wanted STRING", None), ("mkr_delegated_to_v2", "gov_delegated_by_v2", "wanted STRING", None),
        ("all_active_vote_proxies_currently", "gov_funded_proxies", "", None), ("all_delegates_0", "gov_delegates", "", None),
        ("all_delegates", "gov_delegates_in_time", "", None), ("all_esm_joins", "gov_shutdown_v1", "", None), ("all_esm_v2_joins", "gov_shutdown_v2", "", None),
    ):
        if argument == "wanted STRING":
            column = "from_address" if view == "gov_delegated_by" else "immediate_caller"
        columns = _declared(views[view], ("poll_id",) if column == "poll_id" else ())
        wanted = f" WHERE {column} = {argument.split()[0]}" if argument else ""
        out.append((name, argument, columns, f"SELECT {', '.join(columns)} FROM {view}{wanted}"))
    out.append(("unique_voter_address_1", "wanted STRING", "STRING",
                "coalesce((SELECT max_by(vote_proxy, id) FROM gov_parties WHERE party = wanted), wanted)"))
    return out


def register_functions(spark: SparkSession, t: GovTables) -> list[str]:
    """Views of the tables and the temporary functions over them; gives the functions' names."""
    views = _views(t)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    names = []
    for name, arguments, result, body in _functions(views):
        returns = result if isinstance(result, str) else "TABLE (" + ", ".join(f"{c} {kind}" for c, kind in result.items()) + ")"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
        names.append(name)
    return names
