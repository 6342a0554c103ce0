"""Suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from ballotlake.llm import substrings

SMALL = "/root/testdata/sf0.001"


def plain(docs, length=100):
    """Rows as op5 gives them; ids are different and not null."""
    first, out = {}, []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in first:
                gone[i:i + length] = b"\1" * length
            else:
                first[w] = (doc_id, i)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len([1 for x in bytes(gone).split(b"\0") if x])
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(docs):
    from pyspark.sql import functions as F
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return sorted((tuple(r) for r in substrings.repeated_bytes(docs).select(
        "doc_id", "n_bytes", removed, F.size("spans").cast("long"), "kept_sha256").collect()), key=str)


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, substrings.op5_suffix_array_dedup(spark, SMALL).collect())) == sorted(plain(docs))


@pytest.mark.parametrize("crowd,segment,shard", [(4096, 4 << 20, 2 << 20), (3, 700, 1)])
def test_random_texts_equal_brute_force(spark, monkeypatch, crowd, segment, shard):
    # local tasks are forked from this process only on first use, so the values travel with the functions
    rnd = random.Random(crowd)
    parts = ["".join(rnd.choice("ab\0é") for _ in range(rnd.choice([30, 99, 100, 101, 150, 400]))) for _ in range(12)]
    docs = [(i * 7 % 101, "".join(rnd.choice(parts)[rnd.randrange(5):] for _ in range(rnd.randrange(6)))) for i in range(60)]
    docs += [(200, "x" * 1500), (201, "xy" * 700), (202, None), (203, ""), (204, "z" * 99), (205, "x" * 100)]
    data = spark.createDataFrame(docs, "doc_id long, text string")
    if crowd != 4096:
        rows = [(d, (t or "").encode()) for d, t in docs]
        assert via_functions(rows, crowd, segment, shard, monkeypatch) == {r[0]: r[2] for r in plain(docs)}
    else:
        assert got(data) == sorted(plain(docs), key=str)


def via_functions(rows, crowd, segment, shard, monkeypatch):
    """The same steps in this process, with small limits."""
    import pyarrow as pa
    for name, value in (("CROWD", crowd), ("SEGMENT", segment), ("SHARD_BYTES", shard)):
        monkeypatch.setattr(substrings, name, value)

    def settle(batches):
        t = pa.Table.from_batches(list(batches), substrings._ROW).sort_by([(c, "ascending") for c in ("k", "h", "id", "at")])
        return pa.Table.from_batches(list(substrings._settled(t.to_batches(max_chunksize=37))), substrings._OUT)

    docs = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["id", "text"])
    first = settle(substrings._stretch_rows([docs])).to_pylist()
    texts = dict(rows)
    wanted = {i: [r for r in first if r["id"] == i and r["what"]] for i in texts}

    def fetched(what):
        own = [[{c: r[c] for c in ("k", "at", "n")} for r in wanted[i] if r["what"] == what] for i in texts]
        batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values())), pa.array(own)], ["id", "text", "wanted"])
        return pa.Table.from_batches(list(substrings._fetched([batch])))

    compare = fetched(1).sort_by([(c, "ascending") for c in ("k", "id", "at")])
    crowded = fetched(2)
    assert crowded.num_rows
    gone = [r for r in first if not r["what"]]
    gone += [r for b in substrings._indexed(compare.to_batches(max_chunksize=11)) for r in b.to_pylist()]
    gone += [r for r in settle(substrings._window_rows(crowded.to_batches())).to_pylist() if not r["what"]]
    per_doc = {i: [g for g in gone if g["id"] == i] for i in texts}
    batch = pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array(list(texts.values())), pa.array([per_doc[i] for i in texts], pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int32())])))], ["id", "text", "gone"])
    return {r["doc_id"]: sum(s["stop"] - s["start"] for s in r["spans"]) for b in substrings._cut([batch]) for r in b.to_pylist()}


def test_run_index_statistics():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(30)] + [b"\0\0\0", b"\0\0"]
    index = substrings.RunIndex(texts)
    suffix = [index.text[p:p + index.left[p]] for p in index.array]
    assert suffix == sorted(suffix) and sorted(index.array.tolist()) == list(range(len(index.text)))
    found = index.statistics()
    for i in range(1, len(suffix)):
        a, b = suffix[i - 1], suffix[i]
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert found[index.array[i]] == same
    for length in (3, 8):
        seen, want = set(), []
        for p in range(len(index.text)):
            if index.left[p] >= length:
                w = index.text[p:p + length]
                if w in seen:
                    want.append(p)
                seen.add(w)
        assert index.later_occurrences(length).tolist() == want


def test_odd_rows(spark):
    line = "the same hundred bytes and some more " * 4
    rows = [(None, line, 1), (4, line, 2), (4, line, 3), (4, "other " + line, 4), (5, None, 5), (None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = [r for r in got(docs)]
    assert len(out) == 6 and [r[1:4] for r in out if r[0] == 5] == [(0, 0, 0)]
    assert [r[2] for r in out if r[0] is None and r[1]] == [len(line)]
    same = [r for r in out if r[0] == 4 and r[1] == len(line)]
    assert len(same) == 2 and same[0] == same[1]
    assert substrings.repeated_bytes(docs.limit(0)).count() == 0
