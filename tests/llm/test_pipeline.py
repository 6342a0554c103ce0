"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from ballotlake.llm import lines, quality
from tests.llm import brute
from tests.llm.test_simhash import plain_components, plain_fingerprint

SMALL = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    rows = docs
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, rows, SMALL)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in rows.collect()}

    scores = quality.score_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()
    assert set(kept["quality_classifier"]) == {r.row.doc_id for r in scores if r.score >= 0.3}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/quality_classifier/*.parquet'")
    want = dict(con.execute(f"SELECT doc_id, text FROM ({lines.OP2_SQL})").fetchall())
    assert {i: r.text for i, r in kept["line_dedup"].items()} == want

    classes = plain_components([(i, plain_fingerprint(r.text)) for i, r in kept["line_dedup"].items()])
    assert set(kept["simhash_near_dedup"]) == {c for _, _, c in classes}

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = brute.leaks([(i, r.text) for i, r in kept["simhash_near_dedup"].items()], items)
    assert set(kept["decontamination"]) == {r[0] for r in leaks if not r[5]} and any(r[5] for r in leaks)

    last = kept["sentencepiece"]
    assert set(last) == set(kept["decontamination"])
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in last.values())


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "some words that are here now and then", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        out = docs.limit(0) if empty else docs
        for k, (name, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, out, SMALL).write.parquet(str(tmp_path / f"{empty}{k}"))
            out = spark.read.parquet(str(tmp_path / f"{empty}{k}"))
        assert "ids" in out.columns and (out.count() == 0 if empty else out.count() <= 2)
