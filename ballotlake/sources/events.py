"""The model tables derived from the ``events`` and ``nation`` tables.

Every row of ``events`` stands for one block with one transaction; its type
says which fact it is.  ``nation`` gives the polls.  The derivation is a
projection of one scan per table, apart from the two tables of stored
balances, which are running sums: these are written once per session, as the
ingest that owns such tables would, and then read; new or replaced files are
noticed and give new ones.

An event row already holds its block's time, so the facts are written down
*located*: with ``block_number``, ``block_ts`` and ``tx_hash`` beside
``block_id`` and ``tx_id`` (see ``sources.located``).  Operators then need no
join to the block and transaction tables, which have a row per block.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.functions.settle import settle
from ballotlake.model import STORED, GovTables
from ballotlake.operators.balances import lock_changes, running_balances, transfer_changes

# Fixed values of the derivation.
ADDRESSES = 150
SECOND_CHAIN_SHIFT = 500
FIRST_NUMBER, SECOND_NUMBER = 7809000, 789400
FIRST_POLL_START, DAY = 1704067200, 86400
FIRST_CHAIN_ID, SECOND_CHAIN_ID = 1, 42161


def _text(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _user(value: Column) -> Column:
    return _text("u", value)


def event_tables(spark: SparkSession, sf_dir: str, located: bool = True) -> GovTables:
    """The tables of one data folder; ``located=False`` leaves the facts without block columns."""
    n, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    cents = F.col("value").cast("decimal(18,2)").cast(STORED)
    option = F.floor("value").cast("int") % 4
    # The voting contract of a user whose number divides by 5; two of them take turns.
    contract = F.concat(_text("p", user - user % 5), _text("_", F.floor(n / 4).cast("bigint") % 2))

    @cache
    def events() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/events.parquet")

    def nation() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/nation.parquet")

    def place(shift: int, first_number: int, tx_prefix: str) -> list[Column]:
        columns = [
            F.lit(0).alias("log_index"),
            (n + 1 + shift).alias("tx_id"),
            (n + 1 + shift).alias("block_id"),
        ]
        if located:
            columns += [
                (n + first_number).alias("block_number"),
                F.col("ts").alias("block_ts"),
                _text(tx_prefix, n).alias("tx_hash"),
            ]
        return columns

    first = place(0, FIRST_NUMBER, "0xt")
    second = place(SECOND_CHAIN_SHIFT, SECOND_NUMBER, "0xu")

    def blocks(shift: int, first_number: int, prefix: str) -> DataFrame:
        return events().select(
            (n + 1 + shift).alias("id"), (n + first_number).alias("number"),
            _text(prefix, n).alias("hash"), F.col("ts").alias("block_ts"),
        )

    def transactions(shift: int, prefix: str) -> DataFrame:
        return events().select(
            (n + 1 + shift).alias("id"), _text(prefix, n).alias("hash"),
            (n + 1 + shift).alias("block_id"),
        )

    def facts(condition: Column, *columns: Column, at: list[Column] = first) -> DataFrame:
        return events().where(condition).select((n + 1).alias("id"), *columns, *at)

    def votes(event_type: str, chain_id: int, at: list[Column]) -> DataFrame:
        return facts(
            kind == event_type, _user(user).alias("voter"),
            (n % 25).cast("int").alias("poll_id"), option.alias("option_id"),
            option.cast("string").alias("option_id_raw"),
            F.lit(chain_id).alias("chain_id"), at=at,
        )

    def polls() -> DataFrame:
        key = F.col("n_nationkey")
        return nation().select(
            (key + 1).cast("bigint").alias("id"), _text("u", F.col("n_regionkey")).alias("creator"),
            key.cast("int").alias("poll_id"),
            (key + FIRST_NUMBER).cast("bigint").alias("block_created"),
            (key * DAY + FIRST_POLL_START).cast("int").alias("start_date"),
            ((key + 7) * DAY + FIRST_POLL_START).cast("int").alias("end_date"),
            F.col("n_name").alias("multi_hash"),
            F.concat(F.lit("url/"), "n_name").alias("url"),
        )

    def withdrawals() -> DataFrame:
        key = F.col("n_nationkey")
        return nation().where(key % 5 == 3).select(
            (key + 1).cast("bigint").alias("id"), _text("u", F.col("n_regionkey")).alias("creator"),
            key.cast("int").alias("poll_id"),
            F.lit(FIRST_NUMBER + 1).cast("bigint").alias("block_withdrawn"),
        )

    def proxies() -> DataFrame:
        hot = F.when(user % 20 == 0, _user(user)).otherwise(_user((user + 10) % ADDRESSES))
        return facts(
            (kind == "signup") & (user % 5 == 0) & (n % 3 == 0), _user(user).alias("cold"),
            hot.alias("hot"), contract.alias("vote_proxy"),
        )

    def delegates() -> DataFrame:
        return facts(
            (kind == "signup") & (user % 4 == 1),
            _user((user + 1) % ADDRESSES).alias("delegate"), _user(user).alias("vote_delegate"),
        )

    def transfers() -> DataFrame:
        return facts(
            kind != "error", F.when(n % 17 == 5, contract).otherwise(_user(user)).alias("sender"),
            F.when(n % 11 == 2, contract).otherwise(_user((user * 7 + 3) % ADDRESSES)).alias("receiver"),
            cents.alias("amount"),
        )

    def locks(event_type: str, negative: int, caller: Column, contract: Column) -> DataFrame:
        signed = F.when(n % negative == 0, -cents).otherwise(cents)
        return facts(
            kind == event_type, _user(user).alias("from_address"), caller.alias("immediate_caller"),
            signed.alias("lock_amt"), contract.alias("contract_address"),
        )

    def shutdown_joins(parity: int) -> DataFrame:
        return facts(
            (kind == "purchase") & (n % 2 == parity), _user(user).alias("from_address"),
            cents.alias("join_amount"),
        )

    def logs(at: list[Column]) -> DataFrame:
        return facts(
            F.lit(True), _text("0xc", F.col("event_type")).alias("address"),
            F.col("props").alias("data"), _user(user).alias("topics"), at=at,
        )

    def lock() -> DataFrame:
        return locks("error", 3, F.when(n % 4 == 1, contract).otherwise(_user(user % 30)), F.lit("vault"))

    def stored(name: str, changes) -> DataFrame:
        """Written once per session and state of the files, and kept on the session."""
        written = spark.__dict__.setdefault("_ballotlake_stored", {})
        files = spark.read.parquet(f"{sf_dir}/events.parquet").select("_metadata.file_path", "_metadata.file_modification_time")
        state = tuple(sorted((row[0], str(row[1])) for row in files.distinct().collect()))
        if (name, state) not in written:
            written[name, state] = settle(running_balances(changes()), name)
        return written[name, state]

    return GovTables(
        block=lambda: blocks(0, FIRST_NUMBER, "0xb"),
        block2=lambda: blocks(SECOND_CHAIN_SHIFT, SECOND_NUMBER, "0xa"),
        tx=lambda: transactions(0, "0xt"),
        tx2=lambda: transactions(SECOND_CHAIN_SHIFT, "0xu"),
        poll=polls,
        poll_withdrawal=withdrawals,
        vote=lambda: votes("click", FIRST_CHAIN_ID, first),
        vote2=lambda: votes("view", SECOND_CHAIN_ID, second),
        proxy=proxies,
        delegate=delegates,
        transfer=transfers,
        lock=lock,
        delegate_lock=lambda: locks("purchase", 4, _user(user), _user(user % 12)),
        shutdown_v1=lambda: shutdown_joins(0),
        shutdown_v2=lambda: shutdown_joins(1),
        wallet_balance=lambda: stored("wallet_balance", lambda: transfer_changes(transfers())),
        locked_balance=lambda: stored("locked_balance", lambda: lock_changes(lock())),
        log=lambda: logs(first),
        log2=lambda: logs(second),
    )
