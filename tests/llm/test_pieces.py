"""Encoding against the library's own unigram search over the same pieces and scores, and exact round trips."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ballotlake.llm import pieces_codec as codec

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    """The file's pieces, with the few scores of -1e9 raised, as the library adds up in single precision."""
    own = codec.load()
    return codec.Vocabulary([(p, i, max(s, -50_000.0)) for p, i, s in own.rows], own.byte_ids, own.by_id)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(codec.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, searched as a unigram model
    for piece in proto.pieces:
        piece.score = max(piece.score, -50_000.0)
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def score(vocabulary, ids):
    by_id = {i: s for _, i, s in vocabulary.rows}
    return sum(by_id.get(i, 0.0) for i in ids), sum(i not in by_id for i in ids)


def test_table_equals_the_library_and_comes_back(spark, vocabulary, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    out = codec.encode(docs, vocabulary, 60_000).withColumn("again", codec.decode(F.col("ids"), vocabulary)).collect()
    same = 0
    for r in out:
        assert r.again == r.row.text
        want = library.encode(r.row.text)
        same += r.ids == want
        assert score(vocabulary, r.ids) == score(vocabulary, want)
    assert len(out) == 60 and same > 50
    some = codec.encode(docs, vocabulary, 60_000, check=True).withColumn("again", codec.decode(F.col("ids"), vocabulary)).collect()
    assert [r.round_trip for r in some] == [r.again == r.row.text for r in some] and len(some) == 60
    rows = codec.op7_sentencepiece(spark, SMALL).collect()
    assert all(r.round_trip for r in rows) and len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_odd_texts(spark, vocabulary, library):
    rnd = random.Random(4)
    texts = ["", None, " ", "   two  spaces ", "\n\t x\r\n", "snow ☃ \U0001F600 中文Ж", "x" * 700, " " * 500 + "end", "a▁b",
             "́mark first", "emoji‍\U0001F468‍\U0001F469", "ALL;\r\n{x}\r", "same", "same"]
    texts += ["".join(rnd.choice("abe éЖ,.\n1\U0001F600") for _ in range(40)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = {r.row.doc_id: r for r in codec.encode(docs, vocabulary, 300).withColumn("again", codec.decode(F.col("ids"), vocabulary)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i].again == (t or "").replace("▁", " ")
        if t and len(t) < 400:
            assert score(vocabulary, out[i].ids) == score(vocabulary, library.encode(t)), t
    assert out[0].ids == out[1].ids == [] and out[12].ids == out[13].ids
    assert codec.encode(docs.limit(0), vocabulary).count() == 0


def test_texts_and_units_are_dealt_once(spark, vocabulary):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        out = codec.encode(docs, vocabulary, 60_000)
        out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" not in plan and plan.count("BroadcastExchange") == 1
    dealt = [line for line in plan.splitlines() if "- Exchange " in line]
    assert plan.count("ReusedExchange") == 1 and len(dealt) == 2, plan


def test_long_units_are_searched_whole(spark, vocabulary, library):
    rnd = random.Random(7)
    texts = ["-" * 700, "=" * 129 + "x", "x" * 700, " " * 128 + "end", " " * 500 + "end", "   " * 300, "0123456789" * 60, "的中国人民" * 90,
             "".join(rnd.choice("internationalmente") for _ in range(5000)), "ไทยภาษา" * 40, "\n" * 400 + "a", "é" * 300, "\U0001F600" * 200]
    texts += ["".join(rnd.choice(["the", "tion", "ers", "é", "Ж", "q", "國"]) for _ in range(rnd.randrange(60, 400))) for _ in range(30)]
    texts += ["".join(rnd.choice("=-_*#.") * rnd.randrange(1, 40) for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.row.doc_id: r for r in codec.encode(docs, vocabulary, 3000).withColumn("again", codec.decode(F.col("ids"), vocabulary)).collect()}
    for i, t in enumerate(texts):
        assert out[i].again == t
        want, got = score(vocabulary, library.encode(t)), score(vocabulary, out[i].ids)
        assert got[1] == want[1] and got[0] >= want[0] - 1e-6 * abs(want[0]), (t[:40], got, want)
    assert any(len(u) > codec.UNIT for t in texts for u in codec.units(t)) and "".join(codec.units(texts[4])) == codec.MARK * 501 + "end"


def test_blocks_hang_on_rows_and_not_on_batches(spark, vocabulary):
    texts = [None, "", "a b  c"] + [f"word{i} and some more" * (i % 7) for i in range(200)] + ["x y " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = []
    for batch in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            for size in (50, 1 << 20):
                found.append(sorted((r.row.doc_id, r.ids) for r in codec.encode(docs, vocabulary, size).collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(x == found[0] for x in found) and len(found[0]) == len(texts)


def test_search_equals_lattice(spark, vocabulary):
    rnd = random.Random(8)
    words = list({codec.MARK * rnd.randrange(3) + "".join(rnd.choice("theinéЖ國q") for _ in range(rnd.randrange(1, 60))) for _ in range(80)})
    search = codec.Search(vocabulary)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for r in codec.lattice(frame, vocabulary).collect():
        assert search(r.word) == r.rows, r.word


def test_edges_are_grouped_in_the_order_they_come(spark, vocabulary):
    words = spark.createDataFrame([(f"{codec.MARK}word{i % 300}",) for i in range(300)], "word string").repartition(3, "word")
    plan = codec.lattice(words, vocabulary)._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "ObjectHashAggregate(keys=" in line]
    assert grouped and all("keys=[at#" in line for line in grouped), plan


def test_fold_takes_the_edges_as_they_are(spark, vocabulary):
    words = spark.createDataFrame([(f"{codec.MARK}word",)], "word string")
    plan = codec.lattice(words, vocabulary)._jdf.queryExecution().analyzed().toString()
    assert "aggregate(edges#" in plan and "transform(edges#" not in plan, plan


def test_of_equal_paths_the_longer_last_piece_stays(spark):
    rnd = random.Random(9)
    found = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(40)})
    tied = codec.Vocabulary([(p, k, -float(len(p))) for k, p in enumerate(found)] + [("c", len(found), 0.0)], list(range(256)), [])
    words = list({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 30))) for _ in range(150)})
    search = codec.Search(tied)
    out = codec.lattice(spark.createDataFrame([(w,) for w in words], "word string"), tied).collect()
    assert len(out) == len(words)
    for r in out:
        assert search(r.word) == r.rows, r.word


def test_units_travel_packed_as_they_are(vocabulary):
    import pyarrow as pa
    units = [f"{codec.MARK}the{k}" for k in range(5)] + ["é" * k for k in range(1, 6)] + [codec.MARK * 3, "x", "\U0001F600", "，", codec.MARK]
    blocks = [k % 2 for k in range(len(units))]
    rows = [[k, k + 1] if k % 3 else [-1 - ord("é"), k] for k in range(len(units))]
    batch = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(units), pa.array(rows, pa.list_(pa.int32()))], ["block", "word", "rows"])
    for own in ([batch], [batch.slice(4, 7), batch.slice(0, 4), batch.slice(11)]):
        found = {0: {}, 1: {}}
        for out in codec._path_batches(iter(own)):
            for block, kind, data in zip(*(out.column(c).to_pylist() for c in ("block", "kind", "data"))):
                import zstandard
                words = codec._Words(vocabulary, None)
                words.load(zstandard.ZstdDecompressor().decompress(data))
                assert kind == 0
                found[block] |= {codec.MARK + w: i for w, i in words.items()} | words.units
        made = codec._Words(vocabulary, None)
        for block in found:
            assert found[block] == {u: made.bytes_of(r) for u, r, b in zip(units, rows, blocks) if b == block}
