"""Table schemas and the bundle of tables every operator works on.

Conventions
-----------
* Block times are ``TIMESTAMP_NTZ`` holding UTC wall time, so no result
  depends on the session time zone.
* Ids, block ids and block numbers are ``BIGINT``: at the target scale
  there are more rows than an ``INT`` can count.
* Amounts are ``DECIMAL(28,18)`` at rest, ``AMOUNT`` while being added and
  ``RESULT`` in outputs.  Spark keeps at most 38 digits, and adding two
  ``DECIMAL(38,18)`` would drop a decimal; two ``AMOUNT`` terms add exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STORED = T.DecimalType(28, 18)
AMOUNT = T.DecimalType(36, 18)
RESULT = T.DecimalType(38, 18)

_LONG, _INT, _STR, _NTZ = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()


def _schema(required: dict, optional: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    fields += [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    return T.StructType(fields)


def _event(columns: dict, optional: dict | None = None) -> T.StructType:
    """An event row: surrogate id, its columns, and its position on the chain."""
    place = {"log_index": _INT, "tx_id": _LONG, "block_id": _LONG}
    return _schema({"id": _LONG, **columns, **place}, optional)


_BLOCK = _schema({"id": _LONG, "number": _LONG, "hash": _STR, "block_ts": _NTZ})
_TX = _schema(
    {"id": _LONG, "hash": _STR, "to_address": _STR, "from_address": _STR, "block_id": _LONG},
    {"nonce": _INT, "value": _STR, "gas_limit": _STR, "gas_price": _STR, "data": _STR},
)
_LOCK = _event({
    "from_address": _STR, "immediate_caller": _STR, "lock_amt": STORED, "contract_address": _STR,
})
_JOIN = _event({
    "from_address": _STR, "immediate_caller": _STR, "join_amount": STORED, "contract_address": _STR,
})
_BALANCE = _schema(
    {"id": _LONG, "address": _STR, "amount": AMOUNT, "tx_id": _LONG, "block_id": _LONG}
)
_LOG = _event({"address": _STR, "data": _STR, "topics": _STR})

SCHEMAS: dict[str, T.StructType] = {
    "chain": _schema({"id": _LONG, "chain_id": _INT, "name": _STR}),
    "block": _BLOCK,
    "block2": _BLOCK,
    "tx": _TX,
    "tx2": _TX,
    "poll": _event({
        "creator": _STR, "poll_id": _INT, "block_created": _LONG,
        "start_date": _INT, "end_date": _INT, "multi_hash": _STR, "url": _STR,
    }),
    "poll_withdrawal": _event({"creator": _STR, "poll_id": _INT, "block_withdrawn": _LONG}),
    "vote": _event(
        {"voter": _STR, "poll_id": _INT},
        {"option_id": _INT, "option_id_raw": _STR, "chain_id": _INT},
    ),
    "vote2": _event(
        {"voter": _STR, "poll_id": _INT, "chain_id": _INT},
        {"option_id": _INT, "option_id_raw": _STR},
    ),
    "proxy": _event({"cold": _STR, "hot": _STR, "vote_proxy": _STR}),
    "delegate": _event({"delegate": _STR, "vote_delegate": _STR}),
    "transfer": _event({"sender": _STR, "receiver": _STR, "amount": STORED}),
    "lock": _LOCK,
    "delegate_lock": _LOCK,
    "shutdown_v1": _JOIN,
    "shutdown_v2": _JOIN,
    "wallet_balance": _BALANCE,
    "locked_balance": _BALANCE,
    "log": _LOG,
    "log2": _LOG,
    "job": _schema(
        {"id": _LONG, "name": _STR, "last_block_id": _LONG, "status": _STR}, {"extra_info": _STR}
    ),
}

# The states a ``job`` row may be in.
JOB_STATES = ("processing", "stopped", "not-ready")

# Which block table, and which transaction table, a fact hangs on.
FIRST_CHAIN_FACTS = (
    "poll", "poll_withdrawal", "vote", "proxy", "delegate", "transfer", "lock", "delegate_lock",
    "shutdown_v1", "shutdown_v2", "wallet_balance", "locked_balance", "log",
)
SECOND_CHAIN_FACTS = ("vote2", "log2")


class GovTables:
    """The model tables by name, each a DataFrame or a function giving one.

    A function is called at the first use of its table, so a query builds
    only the plans of the tables it reads.
    """

    def __init__(self, **sources):
        unknown = set(sources) - set(SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        sources = self.__dict__.get("_sources", {})
        if name not in sources:
            raise AttributeError(f"no table {name!r}; have {sorted(sources)}")
        if not isinstance(sources[name], DataFrame):
            sources[name] = sources[name]()
        return sources[name]

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def names(self) -> list[str]:
        return sorted(self._sources)

    def replace(self, **changes) -> GovTables:
        return GovTables(**{**self._sources, **changes})
