"""Random tables with everything the test tables lack, against the plain SQL.

Block ids out of time order, several events per block and per transaction,
links of one block, wallets that are both hot and cold, repeated polls, NULL
ballots, equal locks, stored balances out of block order.
"""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

import duckdb
import pytest
from conftest import EPOCH
from test_queries import _comparable

from ballotlake.model import SCHEMAS, GovTables
from ballotlake.plans import oracle as sql
from ballotlake.plans.registry import _over_tables

START, DAY = 1704067200, 86400
SEEDS = [int(seed) for seed in os.environ.get("FUZZ_SEEDS", "1").split(",")]
# Queries of the test-table adapter itself, or of columns only it has.
SKIP = {
    "route_logs", "integrity_report", "retract_blocks", "running_balances_wallet", "running_balances_locked",
    "running_balances_stream", "dedupe_events", "dedupe_events_stream",
}
NAMES = sorted(set(_over_tables()) - SKIP)


def make(seed: int) -> dict[str, list[dict]]:
    rnd = random.Random(seed)
    users = [f"u{i}" for i in range(12)]
    contracts = [f"p{i}" for i in range(6)]
    seconds = rnd.sample(range(START, START + 30 * DAY), 100)
    out: dict[str, list[dict]] = {}
    numbers = rnd.sample(range(7809000, 7809200), 60)
    out["block"] = [{"id": i + 1, "number": numbers[i], "hash": f"b{i}", "block_ts": seconds[i] + rnd.random()}
                    for i in range(60)]
    out["block2"] = [{"id": 31 + i, "number": i, "hash": f"a{i}", "block_ts": seconds[60 + i]} for i in range(40)]
    out["tx"] = [{"id": i + 1, "hash": f"t{i}", "block_id": rnd.randint(1, 60)} for i in range(90)]
    out["tx2"] = [{"id": i + 1, "hash": f"s{i}", "block_id": rnd.randint(31, 70)} for i in range(60)]
    logs = iter(range(10**6))

    def events(n: int, columns, chain: int = 1) -> list[dict]:
        rows = []
        for i in range(n):
            tx = rnd.choice(out["tx" if chain == 1 else "tx2"])
            rows.append({"id": i + 1, **columns(), "tx_id": tx["id"], "block_id": tx["block_id"], "log_index": next(logs)})
        ids = [row["id"] for row in rows]
        rnd.shuffle(ids)
        return [{**row, "id": i} for row, i in zip(rows, ids)]

    def ballot(chain_id):
        option = rnd.choice([0, 1, 2, None])
        return {"voter": rnd.choice(["u5", *users]), "poll_id": rnd.choice([10, 10, 11, 12, 99]), "option_id": option,
                "option_id_raw": None if option is None and rnd.random() < 0.7 else str(option or 0), "chain_id": chain_id}

    def lock():
        who = rnd.choice(users)
        return {"from_address": rnd.choice(users), "immediate_caller": rnd.choice([who, *contracts]),
                "lock_amt": rnd.randint(-3, 9), "contract_address": rnd.choice(users)}

    out["vote"] = events(120, lambda: ballot(1))
    out["vote2"] = events(90, lambda: ballot(42161), 2)
    out["proxy"] = events(9, lambda: {"cold": rnd.choice(users), "hot": rnd.choice(users), "vote_proxy": rnd.choice(contracts)})
    out["delegate"] = events(5, lambda: {"delegate": rnd.choice(users), "vote_delegate": rnd.choice(users)})
    out["transfer"] = events(60, lambda: {"sender": rnd.choice(["mint", *users]), "receiver": rnd.choice([*users[:8], *contracts]),
                                          "amount": rnd.randint(0, 50)})
    for table in ("lock", "delegate_lock"):
        rows = events(60, lock)
        copies = [{**row, "id": 1000 + row["id"], "log_index": next(logs)} for row in rows[:10]]
        out[table] = rows + copies
    for table in ("shutdown_v1", "shutdown_v2"):
        out[table] = events(8, lambda: {"from_address": rnd.choice(users), "immediate_caller": "x",
                                        "join_amount": rnd.randint(1, 9), "contract_address": "y"})
    for table, among in (("wallet_balance", users[:10] + contracts[:4]), ("locked_balance", users[3:] + contracts)):
        out[table] = [{k: v for k, v in row.items() if k != "log_index"}
                      for row in events(120, lambda: {"address": rnd.choice(among), "amount": rnd.randint(0, 99)})]
    out["poll"] = []
    for poll_id, start, days in ((10, 8, 14), (11, 0, 30), (12, 20, 2), (13, 1, 1)):
        row = {"creator": rnd.choice(users), "poll_id": poll_id, "block_created": 1, "start_date": START + start * DAY,
               "end_date": START + (start + days) * DAY, "multi_hash": f"NATION_{poll_id}", "url": "u"}
        out["poll"] += events(2 if poll_id == 11 else 1, lambda row=row: row)
    out["poll_withdrawal"] = events(2, lambda: {"creator": rnd.choice(users), "poll_id": 12, "block_withdrawn": 1})
    out["poll"] = [{**row, "id": i} for i, row in enumerate(out["poll"], start=1)]
    return out


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def _sql_tables(connection, data: dict[str, list[dict]]) -> None:
    for name, rows in data.items():
        fields = [f for f in SCHEMAS[name].fields if any(f.name in row for row in rows)]
        kinds = [_SQL_TYPES.get(f.dataType.simpleString(), "DECIMAL(28,18)") for f in fields]
        table = "locks" if name == "lock" else name
        connection.execute(f"CREATE TABLE {table} ({', '.join(f'{f.name} {k}' for f, k in zip(fields, kinds))})")
        values = [[EPOCH + dt.timedelta(seconds=row[f.name]) if f.name == "block_ts" else row.get(f.name)
                   for f in fields] for row in rows]
        connection.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(fields))})", values)
    connection.execute("""ALTER TABLE poll ADD COLUMN opens TIMESTAMP; ALTER TABLE poll ADD COLUMN closes TIMESTAMP;
        UPDATE poll SET opens = make_timestamp(CAST(start_date AS BIGINT)*1000000),
                        closes = make_timestamp(CAST(end_date AS BIGINT)*1000000)""")


def _spark_tables(spark, data) -> GovTables:
    out = {}
    for name, rows in data.items():
        schema = SCHEMAS[name]
        fields = [f for f in schema.fields if any(f.name in row for row in rows)]
        kind = type(schema)(fields)

        def value(field, v):
            if v is None:
                return None
            if field.name == "block_ts":
                return EPOCH + dt.timedelta(seconds=v)
            return Decimal(v) if field.dataType.simpleString().startswith("decimal") else v

        out[name] = spark.createDataFrame([tuple(value(f, row[f.name]) for f in fields) for row in rows], kind).coalesce(2)
    return GovTables(**out)


@pytest.fixture(scope="module", params=SEEDS)
def world(request, spark):
    data = make(request.param)
    connection = duckdb.connect()
    _sql_tables(connection, data)
    given, sql.TABLES = sql.TABLES, {}
    try:
        texts = {name: text.replace("WITH \n", "").replace("WITH ,", "WITH") for name, text in sql.oracle().items()}
    finally:
        sql.TABLES = given
    return _spark_tables(spark, data), connection, texts


@pytest.mark.parametrize("name", NAMES)
def test_random_tables(world, name):
    tables, connection, texts = world
    df = _over_tables()[name](tables)
    answer = connection.execute(texts[name])
    names = [column[0] for column in answer.description]
    expected = _comparable(names, answer.fetchall())
    assert _comparable(df.columns, df.collect()) == expected
