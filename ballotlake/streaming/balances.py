"""Stored balances kept up to date from a stream of changes.

Every micro-batch is folded like a batch: running sums per address in zones
of positions, so an address that takes part in a third of all changes does
not become one task, which it would as one key of a stateful operator.

The state is the last balance of each address.  A micro-batch writes only
those of the addresses it touched, and every ``COMPACT`` micro-batches they
are put together with the state before.  Reading the state, all addresses
that a micro-batch does not touch are left out first.  A micro-batch that is run
again overwrites its own folders and reads only older ones, so restarts
neither lose nor repeat a change; state from before the last but one
compaction is removed.

Layout under ``path``: ``balances/batch=N``, ``last/batch=N``, ``whole/batch=N``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ballotlake.functions.folds import latest, running, total
from ballotlake.functions.settle import remove_folder
from ballotlake.model import AMOUNT

#: After so many micro-batches the state is put together.
COMPACT = 32

_LAST = "address string, amount decimal(36,18), id long"


def _newest_whole(batch_id: int) -> int:
    """The last batch before this one that was put together; -1: none."""
    return batch_id - batch_id % COMPACT - 1


def _state(spark: SparkSession, path: str, batch_id: int, among: DataFrame | None = None) -> DataFrame:
    """The last balances after the batch before ``batch_id``, of the addresses in ``among``."""
    whole = _newest_whole(batch_id)
    paths = [f"{path}/last/batch={k}" for k in range(whole + 1, batch_id)]
    if whole >= 0:
        paths.append(f"{path}/whole/batch={whole}")
    if not paths:
        return spark.createDataFrame([], _LAST)
    rows = spark.read.schema(_LAST).parquet(*paths)
    if among is not None:
        rows = rows.join(among, "address", "left_semi")
    return _newest(rows)


def _newest(rows: DataFrame) -> DataFrame:
    fold = latest("amount", "amount", "id")
    return rows.groupBy("address").agg(*fold.first()).select("address", "amount", F.col(fold.rank).alias("id"))


def _in_order(position, last_id):
    """The position, or an error if it does not come after what is already folded in."""
    late = F.concat(
        F.lit("change "), position.cast("string"), F.lit(" comes after change "), last_id.cast("string"),
        F.lit(" of the same address; rewind to its block and run again"),
    )
    return F.when(last_id.isNull() | (position > last_id), position).otherwise(
        F.raise_error(late).cast("bigint")
    )


def fold_batch(changes: DataFrame, batch_id: int, path: str) -> None:
    """Adds one micro-batch of changes (address, change, position, tx_id, block_id)."""
    spark = changes.sparkSession
    changes = changes.persist()  # read twice below; a lost part is computed again from the source
    try:
        touched = changes.select("address").distinct()
        opening = _state(spark, path, batch_id, touched).select(
            "address", F.col("amount").alias("opening"), F.col("id").alias("last_id"))
        after = running(changes, ["address"], "position", [total("moved", "change")])
        balance = (
            after.join(opening, "address", "left")
            .select(
                _in_order(F.col("position"), F.col("last_id")).alias("id"), "address",
                (F.coalesce("opening", F.lit(0).cast(AMOUNT)) + F.col("moved")).cast(AMOUNT).alias("amount"),
                "tx_id", "block_id",
            )
        )
        written = f"{path}/balances/batch={batch_id}"
        balance.write.mode("overwrite").parquet(written)
    finally:
        changes.unpersist()
    rows = spark.read.parquet(written).select("address", "amount", "id")
    _newest(rows).write.mode("overwrite").parquet(f"{path}/last/batch={batch_id}")
    if batch_id % COMPACT == COMPACT - 1:
        _state(spark, path, batch_id + 1 - COMPACT).unionByName(
            spark.read.schema(_LAST).parquet(*[f"{path}/last/batch={k}" for k in range(_newest_whole(batch_id) + 1, batch_id + 1)])
        ).transform(_newest).write.mode("overwrite").parquet(f"{path}/whole/batch={batch_id}")
        for old in range(batch_id - 2 * COMPACT + 1, batch_id - COMPACT + 1):
            if old >= 0:
                remove_folder(spark, f"{path}/last/batch={old}")
        remove_folder(spark, f"{path}/whole/batch={batch_id - 2 * COMPACT}")


def running_balance_stream(
    changes: DataFrame, path: str, checkpoint: str, first_batch: int = 0
) -> DataStreamWriter:
    """Writes stored balances from a stream of changes; start it with a trigger of your choice.

    Changes of an address must arrive in order of their position, as they do
    when whole blocks are delivered; one that does not stops the stream.
    """
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: fold_batch(batch, first_batch + batch_id, path)
    )


def stored_balances(spark: SparkSession, path: str) -> DataFrame:
    """The stored-balance table a stream has written so far."""
    schema = "id long, address string, amount decimal(36,18), tx_id long, block_id long, batch int"
    return spark.read.schema(schema).parquet(f"{path}/balances").drop("batch")


def rewind(spark: SparkSession, path: str, to_block: int, new_path: str) -> None:
    """Starts a new balance folder from an old one, up to and including a block id.

    For a reorganised chain: the kept rows become batch 0 with their last
    balances as its state.  Start the stream again on ``new_path`` with a new
    checkpoint and ``first_batch=1`` from the block after.
    """
    kept = stored_balances(spark, path).where(F.col("block_id") <= to_block)
    kept.write.mode("overwrite").parquet(f"{new_path}/balances/batch=0")
    fold = latest("amount", "amount", "id")
    last = spark.read.parquet(f"{new_path}/balances/batch=0").groupBy("address").agg(*fold.first())
    last.select("address", "amount", F.col(fold.rank).alias("id")).write.mode("overwrite").parquet(
        f"{new_path}/last/batch=0"
    )
