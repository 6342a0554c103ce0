"""COPY text as a data source: batch and stream, both ways, against the reader of built-in functions."""

from __future__ import annotations

import pytest
from conftest import rows

from ballotlake.sources.copysource import Range, _Lines, register
from ballotlake.sources.copytext import load_copy_text, write_copy_text

ODD = ["plain", "", "tab\there", "line\nbreak", "back\\slash", "\\N", "é☃\U0001F600", "\r\x0b\x0c\x08", "\\x41", "a\\tb"]


@pytest.fixture()
def locks(spark, tables):
    register(spark)
    return tables(lock=[{"from_address": ODD[i % len(ODD)], "immediate_caller": f"c{i}", "lock_amt": f"{i - 40}.5", "block_id": i}
                        for i in range(1, 90)]).lock


def test_written_rows_come_back(spark, locks, tmp_path):
    path = str(tmp_path / "out")
    locks.repartition(3).write.format("copytext").mode("append").save(path)
    for split in (7, 100, 1 << 20):
        again = spark.read.format("copytext").option("table", "lock").option("splitbytes", split).load(path)
        assert again.schema.names == locks.schema.names and rows(again) == rows(locks), split
    assert rows(load_copy_text(spark, path, "lock")) == rows(locks)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    locks.limit(5).write.format("copytext").mode("overwrite").save(path)
    assert spark.read.format("copytext").option("table", "lock").load(path).count() == 5
    locks.limit(2).write.format("copytext").mode("append").save(path)
    assert spark.read.format("copytext").option("table", "lock").load(path).count() == 7


def test_files_of_the_other_writer_and_other_orders(spark, locks, tmp_path):
    path = str(tmp_path / "text")
    order = list(reversed(locks.columns))
    write_copy_text(locks.select(*order), path)
    again = spark.read.format("copytext").option("table", "lock").option("columns", ",".join(order)).load(path)
    assert rows(again) == rows(locks)
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("copytext").option("table", "lock").option("columns", "id").load(path).collect()
    (tmp_path / "short").write_text("1\t2\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        spark.read.format("copytext").option("table", "lock").load(str(tmp_path / "short")).collect()


def test_a_failed_write_leaves_nothing(spark, locks, tmp_path):
    from pyspark.sql import functions as F
    path = str(tmp_path / "out")
    broken = locks.withColumn("from_address", F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.col("from_address")))
    with pytest.raises(Exception):
        broken.repartition(4).write.format("copytext").mode("append").save(path)
    assert not list((tmp_path / "out").glob("part-*")) if (tmp_path / "out").exists() else True


def test_every_line_is_in_one_range(spark, tmp_path):
    from pyspark.sql.types import StructType
    text = b"a\nbb\n\nccc\n\\.\ndd"
    (tmp_path / "f").write_bytes(text)
    lines = _Lines(StructType().add("x", "string"), {"path": str(tmp_path / "f")})
    for cut in range(1, len(text) + 1):
        parts = [Range(str(tmp_path / "f"), a, min(a + cut, len(text))) for a in range(0, len(text), cut)]
        found = [x for p in parts for b in lines.batches(p) for x in b.column(0).to_pylist()]
        assert found == ["a", "bb", "", "ccc", "dd"], cut


def test_streams_read_each_file_once(spark, locks, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.format("copytext").option("table", "lock").option("path", source).load()
        query = stream.writeStream.format("copytext").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()

    locks.where("id <= 40").write.format("copytext").mode("append").save(source)
    run()
    locks.where("id > 40").write.format("copytext").mode("append").save(source)
    run()
    run()
    again = spark.read.format("copytext").option("table", "lock").load(out)
    assert rows(again) == rows(locks)
