"""Plain SQL for every registered query, over the ``events`` and ``nation`` tables.

Written the slow, direct way: two-sided joins, one lookup per row, windows
over whole tables.  It shares no plan with the operators it checks.
"""

from __future__ import annotations

from ballotlake.plans.probes import (
    AFTER, CALLERS, DURING, HASH_LIKE, LAST_POLL, LAST_VOTER, LOCKS_FROM, POLL, VOTER, VOTERS,
)

_CENTS = "CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(28,18))"


def _user(expression: str) -> str:
    return f"concat('u',CAST({expression} AS VARCHAR(20)))"


def _contract(parity: str) -> str:
    """The voting contract of a user whose number divides by 5; two of them take turns."""
    return f"concat('p',CAST(user_id-user_id%5 AS VARCHAR(20)),'_',CAST({parity}//4%2 AS VARCHAR(20)))"


def _votes(event_type: str, shift: int, chain_id: int) -> str:
    return f"""
  SELECT event_id+1 AS id, {_user('user_id')} AS voter, CAST(event_id % 25 AS INT) AS poll_id,
         CAST(floor(value) AS INT) % 4 AS option_id,
         CAST(CAST(floor(value) AS INT) % 4 AS VARCHAR(20)) AS option_id_raw,
         event_id+{shift} AS block_id, event_id+{shift} AS tx_id, 0 AS log_index, {chain_id} AS chain_id
  FROM events WHERE event_type='{event_type}'"""


def _locks(event_type: str, negative: int, caller: str, contract: str) -> str:
    return f"""
  SELECT event_id+1 AS id, {_user('user_id')} AS from_address, {caller} AS immediate_caller,
         CASE WHEN event_id % {negative} = 0 THEN -{_CENTS} ELSE {_CENTS} END AS lock_amt,
         {contract} AS contract_address, event_id+1 AS block_id, event_id+1 AS tx_id, 0 AS log_index
  FROM events WHERE event_type='{event_type}'"""


def _joins(parity: int) -> str:
    return f"""
  SELECT event_id+1 AS id, {_user('user_id')} AS from_address, {_CENTS} AS join_amount,
         event_id+1 AS block_id, event_id+1 AS tx_id, 0 AS log_index
  FROM events WHERE event_type='purchase' AND event_id % 2 = {parity}"""


def _logs(shift: int) -> str:
    return f"""
  SELECT event_id+1 AS id, concat('0xc', event_type) AS address, props AS data,
         {_user('user_id')} AS topics, 0 AS log_index, event_id+{shift} AS tx_id, event_id+{shift} AS block_id
  FROM events"""


TABLES: dict[str, str] = {
    "block": """
  SELECT event_id+1 AS id, event_id+7809000 AS number, concat('0xb',CAST(event_id AS VARCHAR(20))) AS hash,
         ts AS block_ts FROM events""",
    "block2": """
  SELECT event_id+501 AS id, event_id+789400 AS number, concat('0xa',CAST(event_id AS VARCHAR(20))) AS hash,
         ts AS block_ts FROM events""",
    "tx": """
  SELECT event_id+1 AS id, concat('0xt',CAST(event_id AS VARCHAR(20))) AS hash, event_id+1 AS block_id FROM events""",
    "tx2": """
  SELECT event_id+501 AS id, concat('0xu',CAST(event_id AS VARCHAR(20))) AS hash, event_id+501 AS block_id FROM events""",
    "poll": """
  SELECT n_nationkey+1 AS id, concat('u',CAST(n_regionkey AS VARCHAR(20))) AS creator,
         CAST(n_nationkey AS INT) AS poll_id, CAST(7809000+n_nationkey AS BIGINT) AS block_created,
         CAST(1704067200+n_nationkey*86400 AS INT) AS start_date,
         CAST(1704067200+(n_nationkey+7)*86400 AS INT) AS end_date,
         make_timestamp(CAST(1704067200+n_nationkey*86400 AS BIGINT)*1000000) AS opens,
         make_timestamp(CAST(1704067200+(n_nationkey+7)*86400 AS BIGINT)*1000000) AS closes,
         n_name AS multi_hash, concat('url/',n_name) AS url FROM nation""",
    "poll_withdrawal": """
  SELECT n_nationkey+1 AS id, concat('u',CAST(n_regionkey AS VARCHAR(20))) AS creator,
         CAST(n_nationkey AS INT) AS poll_id, 7809001 AS block_withdrawn FROM nation WHERE n_nationkey % 5 = 3""",
    "vote": _votes("click", 1, 1),
    "vote2": _votes("view", 501, 42161),
    "proxy": f"""
  SELECT event_id+1 AS id, {_user('user_id')} AS cold,
         CASE WHEN user_id % 20 = 0 THEN {_user('user_id')} ELSE {_user('(user_id+10)%150')} END AS hot,
         {_contract('event_id')} AS vote_proxy, event_id+1 AS block_id, event_id+1 AS tx_id, 0 AS log_index
  FROM events WHERE event_type='signup' AND user_id % 5 = 0 AND event_id % 3 = 0""",
    "delegate": f"""
  SELECT event_id+1 AS id, {_user('(user_id+1)%150')} AS delegate, {_user('user_id')} AS vote_delegate,
         event_id+1 AS block_id, event_id+1 AS tx_id, 0 AS log_index
  FROM events WHERE event_type='signup' AND user_id % 4 = 1""",
    "transfer": f"""
  SELECT event_id+1 AS id, CASE WHEN event_id % 17 = 5 THEN {_contract('event_id')} ELSE {_user('user_id')} END AS sender,
         CASE WHEN event_id % 11 = 2 THEN {_contract('event_id')} ELSE {_user('(user_id*7+3)%150')} END AS receiver,
         {_CENTS} AS amount, event_id+1 AS block_id, event_id+1 AS tx_id, 0 AS log_index
  FROM events WHERE event_type<>'error'""",
    "locks": _locks("error", 3, f"CASE WHEN event_id % 4 = 1 THEN {_contract('event_id')} ELSE {_user('user_id % 30')} END", "'vault'"),
    "delegate_lock": _locks("purchase", 4, _user("user_id"), _user("user_id % 12")),
    "shutdown_v1": _joins(0),
    "shutdown_v2": _joins(1),
    "wallet_balance": """
  SELECT k AS id, addr AS address, block_id, block_id AS tx_id,
         SUM(d) OVER (PARTITION BY addr ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS amount
  FROM (SELECT receiver AS addr, amount AS d, id*2+1 AS k, block_id FROM transfer
        UNION ALL SELECT sender, -amount, id*2, block_id FROM transfer) x""",
    "locked_balance": """
  SELECT id, immediate_caller AS address, block_id, tx_id,
         SUM(lock_amt) OVER (PARTITION BY immediate_caller ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS amount
  FROM locks""",
    "log": _logs(1),
    "log2": _logs(501),
}


def _sql(ctes: dict[str, str], select: str) -> str:
    """The tables, then the steps of the query, then its answer."""
    body = ",\n".join(f"{name} AS ({text})" for name, text in {**TABLES, **ctes}.items())
    return f"WITH {body}\n{select}"


def _at(seconds) -> str:
    return f"make_timestamp(CAST({seconds} AS BIGINT)*1000000)"


def _last_block(column: str, seconds) -> str:
    return f"(SELECT {column} FROM block WHERE block_ts <= {_at(seconds)} ORDER BY block_ts DESC, id DESC LIMIT 1)"


def _dec(expression: str, name: str) -> str:
    return f"CAST({expression} AS DECIMAL(38,18)) AS {name}"


_BLOCK_DURING = _last_block("number", DURING)
_CUT_DURING = _last_block("id", DURING)

# A point in time as (condition on a block b, condition for holders' transfers).
_WHEN = {
    "block": f"b.number <= {_BLOCK_DURING}",
    "time": f"b.block_ts <= {_at(DURING)}",
    "now": "TRUE",
}


# --- votes ----------------------------------------------------------------------------------


def _valid(when: str, columns: str, poll: int | None = POLL) -> str:
    one = f"AND v.poll_id = {poll}" if poll is not None else ""
    return f"""
  SELECT {columns} FROM vote v, poll c, block b
  WHERE c.poll_id = v.poll_id AND b.id = v.block_id {one}
    AND b.block_ts >= c.opens AND b.block_ts <= c.closes AND {_WHEN[when]}"""


def _seen(when: str) -> str:
    """The links made by then."""
    return f"SELECT p.*, p.vote_proxy AS proxy FROM proxy p WHERE EXISTS (SELECT 1 FROM block b WHERE b.id = p.block_id AND {_WHEN[when]})"


def _active(when: str) -> str:
    """Links without a later one, of either of their wallets."""
    return f"""
  SELECT s.id, s.hot, s.cold, s.proxy FROM seen_{when} s
  WHERE NOT EXISTS (SELECT 1 FROM seen_{when} later WHERE later.block_id > s.block_id
                    AND list_has_any([later.hot, later.cold], [s.hot, s.cold]))"""


_FUNDED = """
  SELECT p.id, p.hot, p.cold, p.vote_proxy AS proxy, h.balance AS proxy_weight
  FROM proxy p, locked_now h WHERE h.address = p.vote_proxy AND h.balance > 0"""


def _links(when: str) -> dict[str, str]:
    """Steps that give ``links``: active links, or for now the funded ones."""
    if when == "now":
        return {**_locked("now"), "links": _FUNDED}
    return {f"seen_{when}": _seen(when), "links": _active(when)}


def _with_proxy(when: str, option: str, poll: int | None = POLL) -> dict[str, str]:
    return {
        **_links(when),
        "valid": _valid(when, f"v.poll_id, v.voter, v.{option}, v.block_id", poll),
        "proxied": f"""
  SELECT v.poll_id, v.voter, v.{option}, v.block_id, coalesce(l.proxy, v.voter) AS proxy_otherwise_voter, l.hot, l.cold
  FROM valid v LEFT JOIN links l ON v.voter = l.hot OR v.voter = l.cold""",
        "newest_votes": """
  SELECT * FROM proxied p WHERE block_id = (
    SELECT max(block_id) FROM proxied q
    WHERE q.poll_id = p.poll_id AND q.proxy_otherwise_voter = p.proxy_otherwise_voter)""",
    }


# --- balances and set-form weights ----------------------------------------------------------


def _moves(when: str) -> str:
    """Every change of a wallet by then, signed, and whether it came in."""
    last = "TRUE" if when == "now" else f"t.block_id <= (SELECT max(b.id) FROM block b WHERE {_WHEN[when]})"
    return f"""
  SELECT unnest([t.receiver, t.sender]) AS who, unnest([t.amount, -t.amount]) AS change, unnest(['in', 'out']) AS way
  FROM transfer t WHERE {last}"""


def _holders(when: str) -> dict[str, str]:
    return {f"moves_{when}": _moves(when), f"holders_{when}": f"""
  SELECT who AS address, sum(change) AS balance FROM moves_{when} GROUP BY who HAVING bool_or(way = 'in')"""}


def _locked(when: str) -> dict[str, str]:
    return {f"locked_{when}": f"""
  SELECT l.immediate_caller AS address, sum(l.lock_amt) AS balance FROM locks l, block b
  WHERE b.id = l.block_id AND {_WHEN[when]} GROUP BY l.immediate_caller"""}


def _combined(when: str) -> dict[str, str]:
    """Wallet and locked changes in one sum; who never received anything is not named, and what they sent not counted."""
    return {**_holders(when), **_locked(when), "combined": f"""
  SELECT CASE WHEN bool_or(way = 'in') THEN who END AS address,
         sum(CASE WHEN way = 'lock' THEN change ELSE 0 END)
           + CASE WHEN bool_or(way = 'in') THEN sum(CASE WHEN way = 'lock' THEN 0 ELSE change END) ELSE 0 END AS balance
  FROM (SELECT who, change, way FROM moves_{when} UNION ALL SELECT address, balance, 'lock' FROM locked_{when}) m
  GROUP BY who HAVING bool_or(way <> 'out')"""}


def _proxy_weights(when: str) -> dict[str, str]:
    def held(table: str, wallet: str) -> str:
        return f"coalesce((SELECT balance FROM {table}_{when} x WHERE x.address = l.{wallet}), 0)"

    terms = [("holders", "hot"), ("holders", "cold"), ("locked", "cold"), ("locked", "hot"), ("locked", "proxy")]
    return {**_links(when), **_combined(when), "weighed": f"""
  SELECT l.hot, l.cold, l.proxy, {' + '.join(held(*term) for term in terms)} AS total_weight FROM links l""",
            "by_party": "SELECT DISTINCT unnest([hot, cold]) AS address, total_weight FROM weighed"}


def _weights(when: str) -> dict[str, str]:
    return {**_proxy_weights(when), "weights": """
  SELECT address, total_weight AS weight FROM by_party
  UNION ALL
  SELECT address, balance FROM combined c WHERE NOT EXISTS (SELECT 1 FROM by_party p WHERE p.address = c.address)"""}


# --- set form at many times or blocks -------------------------------------------------------


def _many(kind: str) -> dict[str, str]:
    """Every step once more, for each of the asked values ``r.v`` and by nested lookups."""
    asked = "SELECT DISTINCT CAST(end_date AS BIGINT) AS v FROM poll"
    if kind == "blocks":
        asked = (f"SELECT DISTINCT (SELECT number FROM block WHERE block_ts <= {_at('e.v')} ORDER BY block_ts DESC, id DESC LIMIT 1) AS v "
                 f"FROM ({asked}) e")
    seen = "b.number <= r.v" if kind == "blocks" else f"b.block_ts <= {_at('r.v')}"
    held = "coalesce((SELECT x.balance FROM {} x WHERE x.v = l.v AND x.address = l.{}), 0)"
    terms = [("m_holders", "hot"), ("m_holders", "cold"), ("m_locked", "cold"), ("m_locked", "hot"), ("m_locked", "proxy")]
    return {
        "asked": f"SELECT v FROM ({asked}) a WHERE v IS NOT NULL",
        "reach": f"SELECT r.v, (SELECT max(b.id) FROM block b WHERE {seen}) AS last FROM asked r",
        "m_moves": """
  SELECT r.v, unnest([t.receiver, t.sender]) AS who, unnest([t.amount, -t.amount]) AS change, unnest(['in', 'out']) AS way
  FROM transfer t JOIN reach r ON t.block_id <= r.last""",
        "m_holders": "SELECT v, who AS address, sum(change) AS balance FROM m_moves GROUP BY v, who HAVING bool_or(way = 'in')",
        "m_locked": f"""
  SELECT r.v, l.immediate_caller AS address, sum(l.lock_amt) AS balance FROM asked r, locks l, block b
  WHERE b.id = l.block_id AND {seen} GROUP BY r.v, l.immediate_caller""",
        "m_combined": """
  SELECT v, CASE WHEN bool_or(way = 'in') THEN who END AS address,
         sum(CASE WHEN way = 'lock' THEN change ELSE 0 END)
           + CASE WHEN bool_or(way = 'in') THEN sum(CASE WHEN way = 'lock' THEN 0 ELSE change END) ELSE 0 END AS balance
  FROM (SELECT v, who, change, way FROM m_moves UNION ALL SELECT v, address, balance, 'lock' FROM m_locked) m
  GROUP BY v, who HAVING bool_or(way <> 'out')""",
        "m_seen": f"SELECT r.v, p.*, p.vote_proxy AS proxy FROM asked r, proxy p, block b WHERE b.id = p.block_id AND {seen}",
        "m_links": """
  SELECT s.v, s.id, s.hot, s.cold, s.proxy FROM m_seen s
  WHERE NOT EXISTS (SELECT 1 FROM m_seen n WHERE n.v = s.v AND n.block_id > s.block_id
                    AND (n.hot = s.hot OR n.cold = s.cold OR n.hot = s.cold OR n.cold = s.hot))""",
        "m_weighed": f"SELECT l.v, l.hot, l.cold, l.proxy, {' + '.join(held.format(*term) for term in terms)} AS total_weight FROM m_links l",
        "m_party": "SELECT DISTINCT v, unnest([hot, cold]) AS address, total_weight FROM m_weighed",
        "m_weights": """
  SELECT v, address, total_weight AS weight FROM m_party
  UNION ALL
  SELECT v, address, balance FROM m_combined c
  WHERE NOT EXISTS (SELECT 1 FROM m_party p WHERE p.v = c.v AND p.address = c.address)""",
    }


# --- row form: canonical voters and their weight --------------------------------------------


def _newest_link(wallet: str, cut: str | None) -> str:
    upto = "" if cut is None else f"AND p.block_id <= {cut}"
    return f"(SELECT max(p.id) FROM proxy p WHERE (p.hot = {wallet} OR p.cold = {wallet}) {upto})"


def _canonical(asked: str, cut: bool = True) -> dict[str, str]:
    """``asked`` (address, cut_id) to ``canonical`` (address, cut_id, canonical)."""
    if not cut:
        return {"canonical": f"""
  SELECT a.address, coalesce((SELECT q.vote_proxy FROM proxy q WHERE q.id = a.link_id), a.address) AS canonical
  FROM (SELECT address, {_newest_link('x.address', None)} AS link_id FROM {asked} x) a"""}
    return {
        "own_link": f"""
  SELECT a.address, a.cut_id, p.hot, p.cold, p.vote_proxy, p.block_id,
         CASE WHEN p.cold = a.address THEN p.hot ELSE p.cold END AS other
  FROM (SELECT address, cut_id, {_newest_link('x.address', 'x.cut_id')} AS link_id FROM {asked} x) a
  LEFT JOIN proxy p ON p.id = a.link_id""",
        "canonical": f"""
  SELECT a.address, a.cut_id,
         CASE WHEN q.block_id > a.block_id THEN a.address ELSE coalesce(a.vote_proxy, a.address) END AS canonical
  FROM (SELECT *, {_newest_link('o.other', 'o.cut_id')} AS other_id FROM own_link o) a
  LEFT JOIN proxy q ON q.id = a.other_id""",
    }


def _held(table: str, who: str, cut: str) -> str:
    return (f"coalesce((SELECT arg_max(h.amount, h.id) FROM {table} h "
            f"WHERE h.address = {who} AND h.block_id <= {cut}), 0)")


def _row_weight(voters: str, name: str, legacy: bool = False) -> dict[str, str]:
    """``voters`` (address, cut_id) to (address, cut_id, amount)."""
    own = f"{_held('wallet_balance', 'a.address', 'a.cut_id')} + {_held('locked_balance', 'a.address', 'a.cut_id')}"
    hot, cold = _held("wallet_balance", "a.hot", "a.cut_id"), _held("wallet_balance", "a.cold", "a.cut_id")
    if legacy:
        others = f"{hot} + {cold}"
    else:
        hot_locked = _held("locked_balance", "a.hot", "a.cut_id")
        cold_locked = _held("locked_balance", "a.cold", "a.cut_id")
        others = f"{hot} + {hot_locked} + CASE WHEN a.hot <> a.cold THEN {cold} + {cold_locked} ELSE 0 END"
    return {
        f"{name}_pair": f"""
  SELECT v.address, v.cut_id, p.hot, p.cold
  FROM (SELECT address, cut_id, (SELECT max(p.id) FROM proxy p
        WHERE p.vote_proxy = x.address AND p.block_id <= x.cut_id) AS link_id FROM {voters} x) v
  LEFT JOIN proxy p ON p.id = v.link_id""",
        name: f"""
  SELECT a.address, a.cut_id, {own} + CASE WHEN a.hot IS NULL THEN 0 ELSE {others} END AS amount
  FROM {name}_pair a""",
    }


_VOTE = "v.voter, v.poll_id, v.option_id, v.option_id_raw, v.block_id, v.log_index, v.chain_id"
_MERGED = f"""
  SELECT {_VOTE}, b.block_ts, t.hash FROM vote v, block b, tx t WHERE b.id = v.block_id AND t.id = v.tx_id
  UNION ALL
  SELECT {_VOTE}, b.block_ts, t.hash FROM vote2 v, block2 b, tx2 t WHERE b.id = v.block_id AND t.id = v.tx_id"""


def _canonical_votes(requests: str) -> dict[str, str]:
    """Last vote per request and canonical voter over both chains; requests: poll_id, unix, cut_id."""
    return {
        "requests": requests,
        "merged": _MERGED,
        "inside": """
  SELECT r.unix, r.cut_id, m.* FROM requests r, merged m, poll c
  WHERE m.poll_id = r.poll_id AND c.poll_id = r.poll_id AND m.block_ts BETWEEN c.opens AND c.closes""",
        "asked": "SELECT DISTINCT voter AS address, cut_id FROM inside WHERE cut_id IS NOT NULL",
        **_canonical("asked"),
        "ranked": """
  SELECT i.*, k.canonical, row_number() OVER (PARTITION BY i.poll_id, i.unix, k.canonical
         ORDER BY i.block_ts DESC, i.chain_id DESC, i.block_id DESC, i.log_index DESC) AS rn
  FROM inside i, canonical k WHERE k.address = i.voter AND k.cut_id = i.cut_id""",
        "last_votes": "SELECT * FROM ranked WHERE rn = 1",
    }


def _weighted(requests: str) -> dict[str, str]:
    return {
        **_canonical_votes(requests),
        "counted": "SELECT * FROM last_votes WHERE block_id <= cut_id",
        "voters": "SELECT DISTINCT canonical AS address, cut_id FROM counted",
        **_row_weight("voters", "power"),
        "weighted": """
  SELECT c.poll_id, c.unix, c.canonical AS voter, c.option_id, c.option_id_raw, p.amount, c.chain_id,
         c.block_ts AS block_timestamp, c.hash
  FROM counted c, power p WHERE p.address = c.canonical AND p.cut_id = c.cut_id""",
    }


def _one_request(poll: int | str, seconds, cut: str | None = None) -> str:
    cut = cut or _last_block("id", seconds)
    return f"SELECT {poll} AS poll_id, CAST({seconds} AS BIGINT) AS unix, {cut} AS cut_id"


_EACH_POLL_END = """
  SELECT DISTINCT c.poll_id, CAST(c.end_date AS BIGINT) AS unix,
         (SELECT arg_max(b.id, b.block_ts) FROM block b WHERE b.block_ts <= c.closes) AS cut_id FROM poll c"""


def _first_chain(cut: str | None, legacy_cut: str | None = None) -> dict[str, str]:
    """Last first-chain vote per canonical voter, links without a cut or up to one."""
    keyed = "k.address = v.voter"
    asked = "SELECT DISTINCT voter AS address FROM vote" if cut is None else (
        f"SELECT DISTINCT voter AS address, {cut} AS cut_id FROM vote")
    return {
        "asked": asked,
        **_canonical("asked", cut is not None),
        "ranked": f"""
  SELECT k.canonical AS voter, v.option_id, v.option_id_raw, v.block_id,
         row_number() OVER (PARTITION BY k.canonical ORDER BY v.block_id DESC, v.log_index DESC) AS rn
  FROM vote v, poll c, block b, canonical k
  WHERE {keyed} AND v.poll_id = {POLL} AND c.poll_id = v.poll_id AND b.id = v.block_id
    AND b.block_ts BETWEEN c.opens AND c.closes""",
        "last_votes": "SELECT voter, option_id, option_id_raw, block_id FROM ranked WHERE rn = 1",
    }


def _legacy(cut: str) -> dict[str, str]:
    return {
        **_first_chain(None),
        "counted": f"SELECT *, {cut} AS cut_id FROM last_votes WHERE block_id <= {cut}",
        "voters": "SELECT DISTINCT voter AS address, cut_id FROM counted",
        **_row_weight("voters", "power", legacy=True),
        "weighted": """
  SELECT c.voter, c.option_id, c.option_id_raw, p.amount FROM counted c, power p WHERE p.address = c.voter""",
    }


def _pairs() -> dict[str, str]:
    return {
        "seen_now": _seen("now"),
        "all_links": _active("now"),
        "pairs": """
  SELECT cold AS address, hot AS voter FROM all_links WHERE hot <> cold
  UNION SELECT hot, cold FROM all_links WHERE hot <> cold""",
    }


def _current(votes: str, block: str, tx: str) -> str:
    return f"""
  SELECT * FROM (
    SELECT a.address, v.poll_id, v.option_id, v.option_id_raw, v.block_id, v.chain_id, v.log_index, b.block_ts,
           c.end_date, t.hash,
           row_number() OVER (PARTITION BY a.address, v.poll_id ORDER BY v.block_id DESC, v.log_index DESC) AS rn
    FROM who a, {votes} v, poll c, {block} b, {tx} t
    WHERE v.voter = a.voter AND c.poll_id = v.poll_id AND b.id = v.block_id AND t.id = v.tx_id
      AND b.block_ts BETWEEN c.opens AND c.closes) x
  WHERE rn = 1"""


def _current_votes(who: str) -> dict[str, str]:
    return {
        **_pairs(),
        "wallets": "SELECT DISTINCT voter AS address FROM vote UNION SELECT DISTINCT voter FROM vote2"
                   " UNION SELECT address FROM pairs",
        "who": who,
        "chain1": _current("vote", "block", "tx"),
        "chain2": _current("vote2", "block2", "tx2"),
        "chosen": """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, poll_id
      ORDER BY block_ts DESC, chain_id DESC, block_id DESC, log_index DESC) AS pick
    FROM (SELECT * FROM chain1 UNION SELECT * FROM chain2) u) y WHERE pick = 1""",
        "timed": f"""
  SELECT c.*, (SELECT arg_max(b.id, b.block_ts) FROM block b
               WHERE b.block_ts <= {_at(f'least(c.end_date, {DURING})')}) AS cut_id FROM chosen c""",
        "asked": "SELECT DISTINCT address, cut_id FROM timed WHERE cut_id IS NOT NULL",
        **_canonical("asked"),
        "voters": "SELECT DISTINCT canonical AS address, cut_id FROM canonical",
        **_row_weight("voters", "power"),
        "supported": """
  SELECT t.address, t.poll_id, t.option_id, t.option_id_raw, t.block_ts AS block_timestamp, t.chain_id,
         p.amount AS support, t.hash
  FROM timed t LEFT JOIN canonical k ON k.address = t.address AND k.cut_id = t.cut_id
  LEFT JOIN power p ON p.address = k.canonical AND p.cut_id = t.cut_id""",
    }


_SUPPORTED = ("poll_id, option_id, option_id_raw, block_timestamp, chain_id, "
              + _dec("support", "support") + ", hash")


# --- locks ----------------------------------------------------------------------------------


def _lock_rows(table: str, condition: str) -> str:
    contract = "l.contract_address AS delegate_contract_address, " if table == "delegate_lock" else ""
    return f"""
  SELECT DISTINCT l.from_address, l.immediate_caller, {contract}l.lock_amt, b.number, b.block_ts, t.hash
  FROM {table} l, block b, tx t WHERE b.id = l.block_id AND t.id = l.tx_id AND {condition}"""


def _history(table: str, condition: str, caller_totals: bool = False) -> str:
    v2 = table == "delegate_lock"
    contract = "delegate_contract_address, " if v2 else ""
    by = "delegate_contract_address" if v2 else "immediate_caller"
    extra = f", sum(lock_amt) OVER (PARTITION BY {by} ORDER BY number) AS caller_total" if caller_totals else ""
    shown = ", " + _dec("caller_total", "caller_lock_total") if caller_totals else ""
    return _sql({
        "chosen": _lock_rows(table, condition),
        "summed": f"SELECT *, sum(lock_amt) OVER (ORDER BY number) AS running{extra} FROM chosen",
    }, f"""
SELECT from_address, immediate_caller, {contract}{_dec('lock_amt', 'lock_amount')}, number AS block_number,
       block_ts AS block_timestamp, {_dec('running', 'lock_total')}, hash{shown}
FROM summed WHERE block_ts >= {_at(LOCKS_FROM)} AND block_ts <= {_at(DURING)}""")


def _in(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


_POLL_COLUMNS = "c.creator, c.poll_id, c.block_created, c.start_date, c.end_date, c.multi_hash, c.url"
_ACTIVE = f"""
SELECT {_POLL_COLUMNS} FROM poll c LEFT JOIN poll_withdrawal w ON w.poll_id = c.poll_id AND w.creator = c.creator
WHERE w.id IS NULL"""


def _found(column: str, table: str, key: str) -> str:
    return f"(SELECT any_value(x.{column}) FROM {table} x WHERE x.id = {key})"


def _shutdown(table: str) -> str:
    return _sql({}, f"""
SELECT from_address AS tx_from, {_found('hash', 'tx', 'j.tx_id')} AS tx_hash, {_dec('join_amount', 'join_amount')},
       {_found('block_ts', 'block', 'j.block_id')} AS block_timestamp FROM {table} j""")


def _unique_voters(poll: int | None) -> dict[str, str]:
    return {
        "valid": _valid("now", "v.poll_id, v.voter, v.option_id_raw, v.block_id", poll),
        "ends": "SELECT poll_id, voter, max(block_id) AS block_id FROM valid GROUP BY poll_id, voter",
        "final": """
  SELECT v.* FROM valid v, ends e WHERE e.poll_id = v.poll_id AND e.voter = v.voter AND e.block_id = v.block_id
    AND v.option_id_raw <> '0'""",
    }


def oracle() -> dict[str, str]:
    out: dict[str, str] = {}

    # Polls and blocks.
    out["active_polls"] = _sql({}, _ACTIVE)
    out["active_polls_by_id"] = _sql({}, f"{_ACTIVE} AND c.poll_id = {POLL}")
    out["active_polls_by_hash"] = _sql({}, f"{_ACTIVE} AND c.multi_hash LIKE '{HASH_LIKE}' ESCAPE '\\'")
    out["block_at"] = _sql({}, f"SELECT number FROM ({_last_block('number', DURING)}) x")
    out["blocks_at_poll_ends"] = _sql({}, """
SELECT DISTINCT c.poll_id, CAST(c.end_date AS BIGINT) AS unix,
       (SELECT arg_max(b.id, b.block_ts) FROM block b WHERE b.block_ts <= c.closes) AS cut_id,
       (SELECT arg_max(b.number, b.block_ts) FROM block b WHERE b.block_ts <= c.closes) AS number FROM poll c""")

    # Votes in the window, with their proxy, and the last ones.
    for name, when, option in (
        ("now", "now", "option_id"), ("time", "time", "option_id"),
        ("time_raw", "time", "option_id_raw"), ("block", "block", "option_id"),
    ):
        columns = f"voter, {option}, block_id, proxy_otherwise_voter, hot, cold"
        out[f"valid_votes_{name}"] = _sql({}, _valid(when, f"v.voter, v.{option}, v.block_id"))
        steps = _with_proxy(when, option)
        out[f"votes_with_proxy_{name}"] = _sql(steps, f"SELECT {columns} FROM proxied")
        out[f"latest_votes_{name}"] = _sql(steps, f"SELECT {columns} FROM newest_votes")
    out["valid_votes_all"] = _sql({}, _valid("now", "v.poll_id, v.voter, v.option_id, v.block_id", None))
    every = _with_proxy("time", "option_id", None)
    columns = "poll_id, voter, option_id, block_id, proxy_otherwise_voter, hot, cold"
    out["votes_with_proxy_all"] = _sql(every, f"SELECT {columns} FROM proxied")
    out["latest_votes_all"] = _sql(every, f"SELECT {columns} FROM newest_votes")
    out["unique_voters"] = _sql(_unique_voters(POLL), "SELECT count(DISTINCT voter) AS unique_voters FROM final")
    out["voters_by_sketch"] = _sql({"valid": _valid("now", "v.poll_id, v.voter", None)}, """
SELECT poll_id, count(DISTINCT voter) AS voters, CAST(1 AS INT) AS within FROM valid GROUP BY poll_id""")
    out["unique_voters_all"] = _sql(_unique_voters(None), """
SELECT p.poll_id, count(DISTINCT f.voter) AS unique_voters FROM poll p LEFT JOIN final f ON f.poll_id = p.poll_id
GROUP BY p.poll_id""")

    # Canonical votes.
    out["canonical_votes_first_chain"] = _sql(_first_chain(None), "SELECT * FROM last_votes")
    out["canonical_votes_first_chain_cut"] = _sql(_first_chain(_CUT_DURING), "SELECT * FROM last_votes")
    out["merged_votes"] = _sql({
        "merged": _MERGED,
        "asked": f"SELECT DISTINCT voter AS address, {_CUT_DURING} AS cut_id FROM merged",
        **_canonical("asked"),
    }, """
SELECT DISTINCT m.poll_id, k.canonical AS address, m.option_id, m.option_id_raw, m.block_id, m.chain_id,
       m.block_ts AS block_timestamp, m.hash
FROM merged m, canonical k WHERE k.address = m.voter""")
    origin = "option_id, option_id_raw, block_id, chain_id, block_ts AS block_timestamp, hash"
    out["canonical_votes"] = _sql(
        _canonical_votes(_one_request(POLL, DURING)), f"SELECT canonical AS voter, {origin} FROM last_votes")
    out["canonical_votes_all"] = _sql(
        _canonical_votes(f"SELECT DISTINCT poll_id, 0 AS unix, {_CUT_DURING} AS cut_id FROM poll"),
        f"SELECT poll_id, canonical AS voter, {origin} FROM last_votes")

    # Current votes.
    who_one = (f"SELECT '{VOTER}' AS address, '{VOTER}' AS voter"
               f" UNION SELECT address, voter FROM pairs WHERE address = '{VOTER}'")
    who_all = "SELECT address, address AS voter FROM wallets UNION SELECT address, voter FROM pairs"
    for name, option in (("current_vote", "option_id"), ("current_vote_raw", "option_id_raw")):
        out[name] = _sql({
            **_pairs(), "who": who_one.replace(f"'{VOTER}'", f"'{LAST_VOTER}'"),
            "valid": _valid("now", f"v.poll_id, v.voter, v.{option}, v.block_id, v.log_index", LAST_POLL),
        }, f"""
SELECT {option}, block_id FROM valid WHERE voter IN (SELECT voter FROM who)
ORDER BY block_id DESC, log_index DESC LIMIT 1""")
    out["current_vote_all"] = _sql({
        **_pairs(),
        "valid": _valid("now", "v.poll_id, v.voter, v.option_id, v.block_id", None),
        "who": "SELECT DISTINCT voter AS address, voter FROM valid UNION SELECT address, voter FROM pairs",
        "ranked": """
  SELECT w.address, v.poll_id, v.option_id, v.block_id,
         row_number() OVER (PARTITION BY w.address, v.poll_id ORDER BY v.block_id DESC) AS rn
  FROM who w, valid v WHERE v.voter = w.voter""",
    }, "SELECT address, poll_id, option_id, block_id FROM ranked WHERE rn = 1")
    out["current_votes"] = _sql(_current_votes(who_one), f"SELECT {_SUPPORTED} FROM supported")
    out["current_votes_all"] = _sql(_current_votes(who_all), f"SELECT address, {_SUPPORTED} FROM supported")
    by_voter = """
  SELECT v.voter, v.poll_id, v.option_id_raw, v.option_id, b.block_ts AS block_timestamp,
         row_number() OVER (PARTITION BY v.voter, v.poll_id ORDER BY v.block_id DESC, v.log_index DESC) AS rn
  FROM vote v, poll c, block b WHERE c.poll_id = v.poll_id AND b.id = v.block_id
    AND b.block_ts BETWEEN c.opens AND c.closes"""
    columns = "voter, poll_id, option_id_raw, option_id, block_timestamp"
    out["current_votes_by_voter"] = _sql({**_pairs(), "ranked": by_voter}, f"""
SELECT {columns} FROM ranked WHERE rn = 1
  AND (voter IN {_in(VOTERS)} OR voter IN (SELECT voter FROM pairs WHERE address IN {_in(VOTERS)}))""")
    out["current_votes_by_voter_all"] = _sql({"ranked": by_voter}, f"SELECT {columns} FROM ranked WHERE rn = 1")

    # Proxies.
    for when in ("block", "time", "now"):
        out[f"active_proxies_{when}"] = _sql(
            {f"seen_{when}": _seen(when), "links": _active(when)}, "SELECT hot, cold, proxy FROM links")
    out["funded_proxies"] = _sql(
        _links("now"), f"SELECT hot, cold, proxy, {_dec('proxy_weight', 'proxy_weight')} FROM links")
    wallets = "SELECT hot AS address FROM proxy UNION SELECT cold FROM proxy UNION SELECT voter FROM vote"
    out["canonical_voter"] = _sql(
        {"asked": wallets, **_canonical("asked", False)}, "SELECT address, canonical FROM canonical")
    out["canonical_voter_cut"] = _sql(
        {"asked": f"SELECT address, {_CUT_DURING} AS cut_id FROM ({wallets}) w", **_canonical("asked")},
        "SELECT address, canonical FROM canonical")
    out["canonical_voter_at_poll_ends"] = _sql(
        {"ends": _EACH_POLL_END,
         "asked": "SELECT DISTINCT v.voter AS address, e.cut_id FROM vote v, ends e WHERE e.poll_id = v.poll_id",
         **_canonical("asked")},
        "SELECT address, cut_id, canonical FROM canonical")

    # Balances and set-form weights.
    for when in ("block", "time", "now"):
        out[f"token_holders_{when}"] = _sql(
            _holders(when), f"SELECT address, {_dec('balance', 'balance')} FROM holders_{when}")
        out[f"locked_balances_{when}"] = _sql(
            _locked(when), f"SELECT address, {_dec('balance', 'balance')} FROM locked_{when}")
        out[f"combined_balances_{when}"] = _sql(
            _combined(when), f"SELECT address, {_dec('balance', 'balance')} FROM combined")
        steps = _weights(when)
        out[f"proxy_weights_{when}"] = _sql(
            steps, f"SELECT hot, cold, proxy, {_dec('total_weight', 'total_weight')} FROM weighed")
        out[f"party_weights_{when}"] = _sql(
            steps, f"SELECT address, {_dec('total_weight', 'total_weight')} FROM by_party")
        out[f"voting_weights_{when}"] = _sql(steps, f"SELECT address, {_dec('weight', 'weight')} FROM weights")
        out[f"voting_weight_of_{when}"] = _sql(
            steps, f"SELECT address, {_dec('weight', 'weight')} FROM weights WHERE address = '{VOTER}'")

    # Row-form weights.
    holders = ("SELECT DISTINCT address FROM wallet_balance UNION SELECT address FROM locked_balance"
               " UNION SELECT vote_proxy FROM proxy")
    voters = {"voters": f"SELECT address, {_CUT_DURING} AS cut_id FROM ({holders}) h"}
    for name, legacy in (("canonical_weight", False), ("canonical_weight_legacy", True)):
        out[name] = _sql({**voters, **_row_weight("voters", "power", legacy)},
                         f"SELECT address, {_dec('amount', 'amount')} FROM power")
    wallet, locked = _held("wallet_balance", "a.address", "a.cut_id"), _held("locked_balance", "a.address", "a.cut_id")
    contract = _held("locked_balance", "a.vote_proxy", "a.cut_id")
    partner = _held("wallet_balance", "a.other", "a.cut_id")
    out["party_weight"] = _sql(
        {**voters, "own": f"""
  SELECT v.address, v.cut_id, p.vote_proxy, CASE WHEN p.cold = v.address THEN p.hot ELSE p.cold END AS other
  FROM (SELECT address, cut_id, {_newest_link('x.address', 'x.cut_id')} AS link_id FROM voters x) v
  LEFT JOIN proxy p ON p.id = v.link_id"""},
        f"SELECT a.address, {_dec(f'{wallet} + {locked} + {contract} + {partner}', 'amount')} FROM own a")

    # Weighted votes and tallies.
    votes = (f"voter, option_id, option_id_raw, {_dec('amount', 'amount')}, chain_id, block_timestamp, hash")
    during, after = _weighted(_one_request(POLL, DURING)), _weighted(_one_request(POLL, AFTER))
    legacy = _legacy(_CUT_DURING)
    out["weighted_votes_cut"] = _sql(during, f"SELECT {votes} FROM weighted")
    out["weighted_votes_time"] = _sql(during, f"SELECT {votes} FROM weighted")
    out["weighted_votes_after_end"] = _sql(after, f"SELECT {votes} FROM weighted")
    out["votes_at_block"] = _sql(
        during, f"SELECT voter, option_id, option_id_raw, {_dec('amount', 'amount')} FROM weighted")
    for name in ("legacy_votes_cut", "legacy_votes_time"):
        out[name] = _sql(legacy, f"SELECT voter, option_id, option_id_raw, {_dec('amount', 'amount')} FROM weighted")
    out["ranked_ballots"] = _sql(during, f"SELECT option_id_raw, {_dec('amount', 'support')} FROM weighted")
    out["ranked_ballots_legacy"] = _sql(legacy, f"SELECT option_id_raw, {_dec('amount', 'support')} FROM weighted")
    out["tally_time"] = _sql(
        during, f"SELECT option_id, {_dec('sum(amount)', 'support')} FROM weighted GROUP BY option_id")
    ends = _weighted(_EACH_POLL_END)
    out["weighted_votes_all"] = _sql(ends, f"SELECT poll_id, unix, {votes} FROM weighted")
    out["tally_all"] = _sql(ends, f"""
SELECT poll_id, unix, option_id, {_dec('sum(amount)', 'support')} FROM weighted GROUP BY poll_id, unix, option_id""")
    for name, when, poll in (("tally_block", "block", POLL), ("tally_now", "now", POLL), ("tally_block_all", "block", None)):
        key = "v.poll_id, " if poll is None else ""
        group = "poll_id, option_id" if poll is None else "option_id"
        timed = f", (SELECT block_ts FROM block b WHERE b.number = {_BLOCK_DURING}) AS block_timestamp"
        out[name] = _sql({**_with_proxy(when, "option_id", poll), **_weights(when)}, f"""
SELECT {key}v.option_id, {_dec('sum(w.weight)', 'support')}{timed if when == 'block' else ''}
FROM newest_votes v LEFT JOIN weights w ON w.address = v.voter GROUP BY {group}""")

    # Delegation and locks.
    out["delegates"] = _sql({}, "SELECT delegate, vote_delegate FROM delegate")
    out["delegates_with_time"] = _sql(
        {}, f"SELECT delegate, vote_delegate, {_found('block_ts', 'block', 'd.block_id')} AS block_timestamp FROM delegate d")
    contracts = "(SELECT vote_delegate FROM delegate)"
    for name, table, contract, sender in (
        ("delegated_by", "locks", "l.immediate_caller", "l.from_address"),
        ("delegated_by_v2", "delegate_lock", "l.contract_address", "l.immediate_caller"),
    ):
        shown = "delegate_contract_address, " if table == "delegate_lock" else ""
        for suffix, one in (("", f"{sender} = '{VOTER}' AND "), ("_all", "")):
            out[name + suffix] = _sql({"sent": _lock_rows(table, f"{one}{contract} IN {contracts}")}, f"""
SELECT from_address, immediate_caller, {shown}{_dec('lock_amt', 'lock_amount')}, number AS block_number,
       block_ts AS block_timestamp, hash FROM sent""")
    out["lock_history"] = _history("locks", f"l.immediate_caller = '{CALLERS[0]}'")
    out["lock_history_list"] = _history("locks", f"l.immediate_caller IN {_in(CALLERS)}")
    out["lock_history_totals"] = _history("locks", f"l.immediate_caller IN {_in(CALLERS)}", True)
    out["lock_history_totals_v2"] = _history("delegate_lock", f"l.contract_address IN {_in(CALLERS)}", True)
    out["lock_history_totals_all"] = _history("locks", "TRUE", True)
    out["lock_history_totals_v2_all"] = _history("delegate_lock", "TRUE", True)
    out["all_locks_running"] = _history("locks", "TRUE")

    # Emergency-shutdown joins.
    out["shutdown_joins_v1"] = _shutdown("shutdown_v1")
    out["shutdown_joins_v2"] = _shutdown("shutdown_v2")

    # Data jobs.
    for name in ("wallet", "locked"):
        out[f"running_balances_{name}"] = _sql({}, f"SELECT id, address, {_dec('amount', 'amount')}, block_id FROM {name}_balance")
    out["balances_at_votes"] = _sql({}, f"""
SELECT v.id, v.voter, v.block_id, {_dec(f"(SELECT arg_max(h.amount, h.id) FROM wallet_balance h WHERE h.address = v.voter AND h.block_id <= v.block_id)", 'amount')}
FROM vote v""")
    out["dedupe_events"] = _sql({}, f"SELECT id, sender, receiver, {_dec('amount', 'amount')}, block_id, tx_id, log_index FROM transfer")
    out["running_balances_stream"] = out["running_balances_wallet"]
    out["dedupe_events_stream"] = out["dedupe_events"]
    out["copy_text_round_trip"] = _sql({}, f"""
SELECT id, from_address, immediate_caller, {_dec('lock_amt', 'lock_amt')}, contract_address, log_index, tx_id, block_id FROM locks""")
    for name in ("dump_round_trip", "copy_source_round_trip", "copy_source_stream"):
        out[name] = out["copy_text_round_trip"]
    out["snapshot_round_trip"] = _sql({}, "SELECT id, voter, poll_id, option_id, option_id_raw, block_id, chain_id FROM vote")
    out["retract_blocks"] = _sql({}, _kept_rows())
    out["merge_chains"] = _sql({}, """
SELECT id, voter, poll_id, option_id, option_id_raw, block_id, chain_id FROM vote
UNION ALL SELECT id, voter, poll_id, option_id, option_id_raw, block_id, chain_id FROM vote2""")
    out["route_logs"] = _sql({}, """
SELECT 1 AS chain, substr(address, 4) AS route, id, address, topics, data, log_index, tx_id, block_id FROM log
WHERE address <> '0xcerror'
UNION ALL SELECT 2, substr(address, 4), id, address, topics, data, log_index, tx_id, block_id FROM log2
WHERE address = '0xcview'""")
    for kind, value in (("times", "unix"), ("blocks", "number")):
        for name, table, columns in (
            ("token_holders", "m_holders", "address, " + _dec("balance", "balance")),
            ("locked_balances", "m_locked", "address, " + _dec("balance", "balance")),
            ("combined_balances", "m_combined", "address, " + _dec("balance", "balance")),
            ("active_proxies", "m_links", "hot, cold, proxy"),
            ("proxy_weights", "m_weighed", "hot, cold, proxy, " + _dec("total_weight", "total_weight")),
            ("party_weights", "m_party", "address, " + _dec("total_weight", "total_weight")),
            ("voting_weights", "m_weights", "address, " + _dec("weight", "weight")),
        ):
            out[f"{name}_many_{kind}"] = _sql(_many(kind), f"SELECT v AS {value}, {columns} FROM {table}")
    out["locate_facts"] = _sql({}, """
SELECT v.id, v.voter, v.poll_id, v.option_id, b.number AS block_number, b.block_ts, t.hash AS tx_hash
FROM vote v LEFT JOIN block b ON b.id = v.block_id LEFT JOIN tx t ON t.id = v.tx_id""")
    out["integrity_report"] = _sql(
        {}, f"SELECT table_name, fault, columns, CAST(bad_rows AS BIGINT) AS bad_rows FROM (\n{_faults()}) f")
    for name, query in CALLED.items():
        out[f"sql_{name}"] = out[query]
    return out


# Functions called in SQL, and the query with the same answer.
CALLED = {
    "holders_on_block": "token_holders_block", "holders_at_time": "token_holders_time", "holders_currently": "token_holders_now",
    "balance_on_block": "locked_balances_block", "balance_at_time": "locked_balances_time",
    "combined_chief_and_mkr_balances_at_time": "combined_balances_time",
    "all_active_vote_proxies": "active_proxies_block", "all_active_vote_proxies_at_time": "active_proxies_time",
    "all_active_vote_proxies_currently": "funded_proxies", "total_mkr_weight_all_proxies_at_time": "proxy_weights_time",
    "hot_or_cold_weight": "party_weights_block", "total_mkr_weight_proxy_and_no_proxy_at_time": "voting_weights_time",
    "total_mkr_weight_proxy_and_no_proxy_by_address_at_time": "voting_weight_of_time",
    "valid_votes_at_time": "valid_votes_time", "valid_votes_at_time_ranked_choice": "valid_votes_time_raw",
    "unique_voters": "unique_voters", "unique_votes_1": "canonical_votes_first_chain", "active_poll_by_id": "active_polls_by_id",
    "current_vote": "current_vote", "time_to_block_number": "block_at", "mkr_delegated_to": "delegated_by",
    "all_esm_joins": "shutdown_joins_v1",
}


def _name(table: str) -> str:
    return "locks" if table == "lock" else table


# What is checked in each table: names beside ``id`` that must be filled, those of a further key, and the tables it hangs on.
_PLACE = ["log_index", "tx_id", "block_id"]
_CHECKED = {
    "block": (["number", "hash", "block_ts"], "hash", None),
    "block2": (["number", "hash", "block_ts"], "hash", None),
    "tx": (["hash", "block_id"], "hash", ("block", None)),
    "tx2": (["hash", "block_id"], "hash", ("block2", None)),
    "poll": (["creator", "poll_id", "block_created", "start_date", "end_date", "multi_hash", "url"], None, None),
    "poll_withdrawal": (["creator", "poll_id", "block_withdrawn"], None, None),
    "vote": (["voter", "poll_id", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "vote2": (["voter", "poll_id", "chain_id", *_PLACE], "log_index, tx_id", ("block2", "tx2")),
    "proxy": (["cold", "hot", "vote_proxy", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "delegate": (["delegate", "vote_delegate", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "transfer": (["sender", "receiver", "amount", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "lock": (["from_address", "immediate_caller", "lock_amt", "contract_address", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "delegate_lock": (["from_address", "immediate_caller", "lock_amt", "contract_address", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "shutdown_v1": (["from_address", "join_amount", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "shutdown_v2": (["from_address", "join_amount", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "wallet_balance": (["address", "amount", "tx_id", "block_id"], None, ("block", "tx")),
    "locked_balance": (["address", "amount", "tx_id", "block_id"], None, ("block", "tx")),
    "log": (["address", "data", "topics", *_PLACE], "log_index, tx_id", ("block", "tx")),
    "log2": (["address", "data", "topics", *_PLACE], "log_index, tx_id", ("block2", "tx2")),
}


def _faults() -> str:
    out = []
    for table, (filled, further, parents) in _CHECKED.items():
        for column in ["id", *filled]:
            out.append(f"SELECT '{table}' AS table_name, 'null' AS fault, '{column}' AS columns, "
                       f"count(*) FILTER (WHERE {column} IS NULL) AS bad_rows FROM {_name(table)}")
        for key in ["id", *([further] if further else [])]:
            out.append(f"SELECT '{table}', 'duplicate', '{key}', coalesce(sum(n - 1), 0) FROM "
                       f"(SELECT count(*) AS n FROM {_name(table)} GROUP BY {key}) g")
        for column, parent in zip(("block_id", "tx_id"), parents or ()):
            if parent:
                out.append(f"SELECT '{table}', 'orphan', '{column}', count(*) FROM {_name(table)} x "
                           f"WHERE NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.id = x.{column})")
    return "\nUNION ALL ".join(out)


def _kept_rows() -> str:
    """How many rows of each table are left when the later blocks of the first chain are taken back."""
    out = []
    for table, (filled, _, parents) in _CHECKED.items():
        on_first = table == "block" or "block_id" in filled and parents and parents[0] == "block"
        column = "id" if table == "block" else "block_id"
        kept = f" WHERE {column} IN (SELECT id FROM block WHERE block_ts <= {_at(DURING)})" if on_first else ""
        out.append(f"SELECT '{table}' AS table_name, count(*) AS n_rows FROM {_name(table)}{kept}")
    return "\nUNION ALL ".join(out)
