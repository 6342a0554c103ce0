"""The two-level folds against brute force, with zones small enough to matter."""

from __future__ import annotations

import random

import pytest
from conftest import rows

from ballotlake.functions.folds import fold_upto, latest, running, total

SCHEMA = "k string, pos long, id long, amount decimal(28,18)"


def history(spark, seed, n=400, span=200):
    """A third of all rows under one key; several rows may share a position."""
    rnd = random.Random(seed)
    data = [
        ("hot" if rnd.random() < 0.34 else rnd.choice("abcde"), rnd.randrange(span), i, rnd.randrange(-50, 50))
        for i in range(n)
    ]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k string, pos long, id long, amount int").selectExpr(
        "k", "pos", "id", "cast(amount as decimal(28,18)) amount")


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_fold_upto_equals_brute_force(spark, bits):
    data, df = history(spark, bits)
    rnd = random.Random(99)
    asked = {(rnd.choice(["hot", "a", "b", "none"]), rnd.randrange(-5, 260)) for _ in range(60)}
    probes = spark.createDataFrame([*asked, *list(asked)[:5]], "k string, pos long")
    found = fold_upto(probes, df, ["k"], "pos", [total("s", "amount"), latest("v", "amount", "id")], bits)
    expected = []
    for key, pos in asked:
        past = [(i, a) for k, p, i, a in data if k == key and p <= pos]
        expected.append((key, pos, float(sum(a for _, a in past)) if past else None,
                         float(max(past)[1]) if past else None))
    assert rows(found) == sorted(expected, key=lambda r: r[:2])


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_fold_upto_without_keys(spark, bits):
    data, df = history(spark, 7)
    probes = spark.createDataFrame([(p,) for p in range(0, 220, 7)], "pos long")
    found = fold_upto(probes, df, [], "pos", [total("s", "amount")], bits)
    assert rows(found) == [
        (p, float(sum(a for _, q, _, a in data if q <= p))) for p in range(0, 220, 7)]


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_running_equals_brute_force(spark, bits):
    data, df = history(spark, 3)
    after = running(df, ["k"], "id", [total("s", "amount")], bits)
    expected = [
        (k, i, float(sum(b for l, _, j, b in data if l == k and j <= i))) for k, _, i, _ in data]
    assert rows(after, "k", "id", "s") == sorted(expected)
    whole = {k: sum(b for l, _, _, b in data if l == k) for k, *_ in data}
    last = {}
    for k, i, s in rows(after, "k", "id", "s"):
        last[k] = s
    assert last == {k: float(v) for k, v in whole.items()}
