"""Ranked search against SQL and against scoring every document for every item."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from ballotlake.llm import ranked
from ballotlake.llm.ranked import OP11_SQL, op11_ranked_search, search
from tests.llm.brute import lower_ascii

SMALL = "/root/testdata/sf0.001"


def brute(docs, items, top=10):
    import re
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, Counter(term.findall(lower_ascii(t or "")))) for i, t in docs]
    bags = [(i, bag, sum(bag.values())) for i, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(term.findall(lower_ascii(t or "")))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, bag, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in terms if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_table_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({OP11_SQL})").fetchall(), key=str)
    assert rows(op11_ranked_search(spark, SMALL)) == want and len(want) > 300


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    docs = []
    for i in range(600):
        n = rnd.choice([0, 1, 3, 20, 60, 300])
        docs.append((i, " ".join(rnd.choice(vocabulary[: rnd.choice([5, 40, 120])]).title() for _ in range(n))))
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5, docs[5][1]), (None, "abc abc"), (None, None), (9_000, None), (9_001, "--- \n")]
    docs.append((2**63 - 1, " ".join(vocabulary) * 50))
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12)))) for i in range(25)]
    items += [(3, "ab cd"), (None, vocabulary[0]), (30, None), (31, ""), (32, "wordthatnodocumenthas"), (33, "It's A-B a_b")]
    return docs, items


@pytest.mark.parametrize("blocks", [1, 5])
def test_equals_scoring_everything(spark, world, blocks):
    docs, items = world
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item long").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert rows(search(d, q, block_bytes=(8 << 20) if blocks == 1 else 500, bucket=37)) == brute(docs, items)


def test_empty_tables(spark, world):
    docs, items = world
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    none = "item_id long, text string"
    assert search(d.limit(0), q).collect() == []
    assert search(d, spark.createDataFrame([], none)).collect() == []
    assert search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), q).collect() == []


def test_bounds_let_only_lesser_scores_go():
    rnd = np.random.default_rng(3)
    weights = rnd.integers(1, 9000, 50)
    queries = ranked.Queries([np.array([1, 7, 20, 33, 40, 41, 44, 49])], weights, np.zeros(1, np.int64), 10)
    lists = [np.sort(rnd.choice(50, rnd.integers(1, 30), replace=False)) for _ in range(800)]
    at, starts = np.concatenate(lists).astype(np.int32), ranked.offsets([len(x) for x in lists])
    impact = rnd.integers(1, 900_000, len(at))
    length = np.sqrt(np.add.reduceat(weights[at] * impact.astype(float) ** 2, starts[:-1]))
    bucket = ranked._Bucket(np.arange(800), np.zeros(800, bool), length, at, impact, starts, queries)
    weight_of = np.zeros(50, np.int64)
    weight_of[queries.terms[0]] = weights[queries.terms[0]]
    score = bucket.scores(np.arange(800), weight_of)
    for least in np.sort(score)[[0, 400, 700, 790, 799]]:
        left = bucket.survivors(0, int(least))
        assert set(np.flatnonzero(score >= least)) <= set(left)
    assert len(left) < 100  # the greatest score as threshold: few are scored
