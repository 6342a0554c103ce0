"""Event streams: reading tables as they grow, and dropping repeated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ballotlake.model import SCHEMAS
from ballotlake.operators.quality import dedupe_events

_LOCATED = [
    T.StructField("block_number", T.LongType()),
    T.StructField("block_ts", T.TimestampNTZType()),
    T.StructField("tx_hash", T.StringType()),
]


def stream_table(
    spark: SparkSession, path: str, table: str, located: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """A model table as a stream over a growing folder of parquet files."""
    schema = SCHEMAS[table]
    if located:
        schema = T.StructType([*schema.fields, *_LOCATED])
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def dedupe_stream(events: DataFrame) -> DataFrame:
    """Each event once, by log index and transaction, across restarts; the keys seen so far are the state."""
    return events.dropDuplicates(["log_index", "tx_id"])


def dedupe_batch(events: DataFrame, batch_id: int, path: str) -> None:
    """Writes the events of a micro-batch that no earlier one wrote, each once.

    What was written is the state: nothing is forgotten, however late an event or a copy of it comes.  Only files
    with transactions in the micro-batch's range are read for it.  A micro-batch that is run again overwrites its own folder.
    """
    spark = events.sparkSession
    events = events.persist()
    try:
        bounds = events.agg(F.min("tx_id"), F.max("tx_id")).first()
        fresh = dedupe_events(events)
        if batch_id and bounds[0] is not None:
            before = spark.read.schema("log_index int, tx_id long, batch int").parquet(path)
            before = before.where((F.col("batch") < batch_id) & F.col("tx_id").between(*bounds))
            fresh = fresh.join(before.select("log_index", "tx_id"), ["log_index", "tx_id"], "left_anti")
        fresh.select(*events.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    finally:
        events.unpersist()


def dedupe_into(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream of events into a table with each of them once; bounded memory, exact at any delay."""
    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: dedupe_batch(batch, batch_id, path)
    )
