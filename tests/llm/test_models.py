"""The trained operators: held-out accuracy, odd rows, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ballotlake.llm.quality import fit_quality, held_out, keep_good, op9_quality_classifier, score_quality
from ballotlake.llm.toxicity import fit_toxicity, op10_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(spark, labels):
    rows = op9_quality_classifier(spark, SF)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = [r for r in rows.join(labels, "doc_id").collect() if r.held_out]
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(r.predicted for r in bad) <= 0.4 * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_same_result_twice_and_odd_rows(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs, labels)
    odd = spark.createDataFrame([(None, None, "row"), (1, "", "score"), (1, "", "score"), (2, "é" * 100_000, None)], "doc_id long, text string, score string")
    rows = score_quality(odd, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows if not r.row.text}) == 1
    assert score_quality(odd.limit(0), model).count() == 0
    assert [r.score for r in score_quality(odd, fit_quality(docs, labels.limit(0))).collect()] == [0.5] * 4
    assert keep_good(odd, labels).columns == odd.columns
    assert odd.where(held_out()).count() == odd.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count()


def test_labels_of_held_out_rows_are_never_learned_from(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.row.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    b = {r.row.doc_id: r.score for r in score_quality(docs, fit_quality(docs, turned)).collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_toxicity_on_held_out_rows(spark):
    large = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{large}/labels.parquet")
    rows = op10_toxicity(spark, large).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").where(held_out()).collect()
    clean, toxic = [r for r in rows if not r.truth], [r for r in rows if r.truth]
    assert sum(r.toxic for r in clean) <= 0.005 * len(clean)
    assert sum(r.toxic for r in toxic) >= 0.85 * len(toxic)
    assert all(0 <= r.expected_severity <= 2 and abs(r.expected_severity) >= r.p_toxic - 1e-9 for r in rows)


def test_toxicity_grades_are_ordered_and_odd_rows_pass(spark):
    rows, labels = [], []
    for i in range(300):
        bad = ["", "nasty", "nasty vile foul"][i % 3]
        rows.append((i, f"plain words here {i % 7} {bad}"))
        labels.append((i, None, 1 if bad else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, labels)
    assert model[1].theta[0] < model[1].theta[1]
    odd = spark.createDataFrame([(1, "all plain", 0), (2, "so Nasty", 0), (3, "nasty VILE foul", 0), (None, None, 0), (4, "", 0)], "doc_id long, text string, found int")
    found = {r.row.doc_id: r.found for r in score_toxicity(odd, model).collect()}
    assert found[1].expected_severity < found[2].expected_severity < found[3].expected_severity
    assert found[None].p_toxic == found[4].p_toxic < 0.5 and (found[2].grade, found[3].grade) == (1, 2)
    nothing = score_toxicity(odd, fit_toxicity(docs, labels.limit(0))).collect()
    assert {r.found.expected_severity for r in nothing} == {0.0} and len(nothing) == 5
