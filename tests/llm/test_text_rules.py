"""Decontamination and repetition rules against plain versions, with odd rows."""

from __future__ import annotations

import random

import pytest

from ballotlake.llm.decontaminate import decontaminate, find_leaks, op4_decontamination
from ballotlake.llm.repetition import keep_unrepetitive, measure_repetition, op8_quality_rules
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"

ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "One two three."), (4, "One two three."), (None, "a b c d e f g h i j k"),
    (5, "x " * 3000), (6, "é ü ñ " * 9 + "# * | <b>"), (7, "same line here\nsame line here\n \n \nother"),
]


def random_texts(seed, n, letters="abcd", longest=60):
    rnd = random.Random(seed)
    return [(100 + i, " ".join(rnd.choice(letters) for _ in range(rnd.randrange(longest)))) for i in range(n)]


def leak_rows(df):
    from pyspark.sql import functions as F

    from ballotlake.llm.decontaminate import hit_words
    return sorted(df.select("row.doc_id", "found.n_words", hit_words(), F.size("found.item_ids"), "row.text").collect(), key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_leaks_equal_brute_force(spark, block_bytes):
    docs = ODD + random_texts(1, 40)
    items = [(1, "a b c d"), (2, "A a-b b"), (2, "b b"), (3, None), (None, "c c d a"), (4, "d")] + random_texts(2, 6, longest=16)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for window in (4, 10):
        got = [tuple(r)[:4] for r in leak_rows(find_leaks(d, i, window, block_bytes))]
        want = [r[:4] for r in brute.leaks(docs, items, window)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_longest_matches_and_places(spark):
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, " ".join(["x", *words[3:20], "y"]))], "doc_id long, text string")
    i = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    found = find_leaks(d, i).first()["found"]
    assert [tuple(m) for m in found["matches"]] == [(9, 3, 1, 17)]
    assert [tuple(s) for s in found["spans"]] == [(1, 18)]


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    d = spark.createDataFrame([(1, "q " * 20, "found"), (2, "clean text", "row"), (3, None, None)], "doc_id long, text string, found string")
    i = spark.createDataFrame([(1, "q q q")], "item_id long, text string")
    out = decontaminate(d, i)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert decontaminate(d, i.limit(0)).count() == 3 and decontaminate(d.limit(0), i).count() == 0


def test_op4_on_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in op4_decontamination(spark, SMALL).collect()]
    assert sorted(got) == sorted(brute.leaks(docs, items)) and any(r[5] for r in got)


def test_repetition_equals_brute_force(spark):
    docs = ODD + random_texts(3, 60, "ab") + random_texts(4, 60, "abcdefgh", 200) + [(7, "k l m n o p q r s t u v " * 3)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, kept int")
    got = [(r["row"]["text"], tuple(r["found"])[:7]) for r in measure_repetition(d).collect()]
    assert len(got) == len(docs)
    for text, found in got:
        if len(text or "") < 5000:
            assert found == brute.repetition(text), text
        else:
            assert found[0] == 3000 and found[6] == 2999
    assert keep_unrepetitive(d).columns == d.columns and keep_unrepetitive(d.limit(0)).count() == 0


def test_op8_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op8_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if len(docs[r.doc_id]) < 3000:
            want = brute.repetition(docs[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered, r.longest_repeat) == want
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert not any(r.kept and r.base_failed for r in rows)


def test_texts_that_break_hashes_of_machine_words():
    import numpy as np
    from ballotlake.llm import repetition
    run = [bin(i).count("1") % 2 for i in range(4096)]
    words = [f"w{x}" for x in run] + ["between", "them"] + [f"w{1 - x}" for x in run]
    codes = np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64)
    longest, _ = repetition._repeats(codes, np.array([0, len(words)]))
    place: dict = {}
    for i in range(len(words) - 2047):
        place.setdefault(tuple(words[i:i + 2048]), []).append(i)
    assert any(len(x) > 1 for x in place.values())  # 2,048 words repeat
    more = {tuple(words[i:i + 2049]) for i in range(len(words) - 2048)}
    assert len(more) == len(words) - 2048 and longest.max() == 2048  # and no more
