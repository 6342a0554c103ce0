"""Raw event logs, routed to the contracts they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route_logs(logs: DataFrame, contracts: dict[str, str], chain: int) -> DataFrame:
    """The logs of the named contracts, with ``route`` (the name) and ``chain``.

    ``contracts`` maps a name to a contract address.  The addresses become a
    pushed-down filter, so other logs are not read.
    """
    names = F.create_map(*[F.lit(x) for name, address in contracts.items() for x in (address, name)])
    return logs.where(F.col("address").isin(*contracts.values())).select(
        F.lit(chain).alias("chain"), names[F.col("address")].alias("route"), *logs.columns
    )


def write_routed(routed: DataFrame, path: str) -> None:
    """One folder per chain and route, appended; each consumer reads only its own."""
    routed.write.mode("append").partitionBy("chain", "route").parquet(path)
