"""A training-data pipeline over ``documents``: each stage keeps what the next one works on.

1. The quality classifier lets documents go that it rejects.
2. Line dedup drops the boilerplate lines of each source.
3. SimHash near-dedup keeps one document of each class of near copies.
4. Decontamination lets documents go in which a window of a benchmark item occurs.
5. The rest is encoded with the piece table: id, number of pieces, piece ids, and whether they decode to the text.

Every stage but the last returns the columns of ``documents``.  Nulls, repeated rows and empty tables are treated as
each operator says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.functions.settle import fresh_folder
from ballotlake.llm import decontaminate, lines, pieces_codec, quality, simhash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces_codec.encode(docs.select("doc_id", "text"), pieces_codec.load(), check=True)
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again."""
    folder = fresh_folder(spark, "pipeline")

    def stage(docs: DataFrame, step) -> DataFrame:
        name, function = step
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(stage, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The classifier and the encoder cannot be said in SQL; the tests hold the rows against plain versions.
ORACLE_SQL = None
