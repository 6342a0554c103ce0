"""SimHash near-dedup against brute force."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from ballotlake.llm import simhash
from tests.llm.brute import WS_WORDS, lower_ascii

SMALL = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = WS_WORDS.findall(lower_ascii(text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    root = {}
    fps = sorted({f for _, f in rows})

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=str)


def got(df):
    from pyspark.sql import functions as F
    return sorted(map(tuple, df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()), key=str)


def test_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    assert sorted(map(tuple, simhash.op6_simhash_near_dedup(spark, SMALL).collect()), key=str) == want
    assert any(r[2] != r[0] for r in want)


def test_odd_rows_and_keep_one(spark):
    rows = [(5, None, "p"), (3, "", "q"), (None, " \n", "r"), (7, "one two", "s"), (7, "One TWO", "s"), (2, "one  two", "t"), (None, "alone here", "u"), (9, "é " * 50_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert got(simhash.component_ids(docs)) == plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "9", "None"]
    assert simhash.component_ids(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost(spark, seed):
    rnd = random.Random(seed)
    fps = {rnd.getrandbits(64) & (0xFFFF << 48 | rnd.getrandbits(48)) for _ in range(150)}
    for f in list(fps)[:100]:
        for _ in range(3):
            g = f
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                g ^= 1 << b
            fps.add(g)
    signed = [simhash._signed(f) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    found = [tuple(r) for r in simhash.links(nodes).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_thresholds_cover_the_distance():
    import numpy as np
    differ = np.full(64, 0.5)
    for parts in range(1, 6):
        groups = simhash.grouped_bits(np.eye(64) * 50 + 25, 100.0, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        cost, t = simhash.allotted(groups, differ, 1e9, 4)
        assert sum(x + 1 for x in t) == 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (102, 100)], "a long, b long")
    out = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[i] for i in (100, 101, 102)} == {100}
    assert re.fullmatch(r"[0-9a-f]{16}", f"{simhash.fingerprint(b'a b c d e'):016x}")
