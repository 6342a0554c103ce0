"""LM scoring: brute force of the score, gradients, learning, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballotlake.llm import pseudo_likelihood as lm

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 <> 0")
    frequent, share = lm.corpus_counts(docs)
    return frequent, lm.train(docs, frequent, share)


def test_vocabulary_is_the_most_frequent_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = {}
    for r in docs.collect():
        for w in lm.words(r.text.encode()):
            count[w] = count.get(w, 0) + 1
    frequent, share = lm.corpus_counts(docs)
    assert frequent == sorted(count, key=lambda w: (-count[w], w))[: lm.WORDS]
    ids, places, _ = lm.Tokens(frequent)([r.text.encode() for r in docs.collect()])
    assert share.tolist() == np.bincount(ids[places], minlength=lm.VOCABULARY).tolist()


def test_score_is_the_sum_of_conditionals(spark, model):
    frequent, network = model
    text = "It was the end of aner, Thing. the the"
    row = lm.score(spark.createDataFrame([(text,)], "text string"), frequent, network).first()
    number = lm.Tokens(frequent)
    ids = list(number([text.encode()])[0])
    total = 0.0
    for t in range(2, len(ids) - 2):
        hidden = np.tanh(network.hidden_bias + sum(network.embed[k][ids[t + d]] for k, d in enumerate(lm.SIDES)))
        logits = (network.out @ hidden + network.bias).astype(float)
        total += logits[ids[t]] - math.log(np.exp(logits).sum())
    assert row.n_tokens == 9 and abs(row.log_likelihood - total) < 1e-3


def test_training_follows_the_gradient():
    random_ = np.random.default_rng(1)
    tokens = random_.integers(0, lm.VOCABULARY, 60)
    places = np.arange(2, 58)
    start = lm.Window(lm.first_weights(np.ones(lm.VOCABULARY)))
    after = lm.Window(lm.first_weights(np.ones(lm.VOCABULARY)))
    rate, lm.RATE = lm.RATE, 1e-2
    try:
        after.train(tokens, places)
    finally:
        lm.RATE = rate
    assert after.log_probabilities(tokens, places).sum() > start.log_probabilities(tokens, places).sum()
    loss = lambda n: -n.log_probabilities(tokens, places).mean()
    step = 1e-2
    moved = lm.Window(lm.first_weights(np.ones(lm.VOCABULARY)))
    w = moved.out.copy()
    moved.out[3, 5] += step
    up = loss(moved)
    moved.out[3, 5] -= 2 * step
    slope = (up - loss(moved)) / (2 * step)
    scale = 1e-2 * min(1.0, len(places) / lm.BATCH)
    assert abs(-(after.out[3, 5] - w[3, 5]) / scale - slope) < 5e-3


def test_held_out_rows_beat_word_frequencies_and_mixed_languages(spark, model):
    frequent, network = model
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0 AND n_chars > 500")
    texts = {lang: [r.text for r in docs.where(F.col("lang") == lang).collect()] for lang in ("en", "fr")}
    mean = lambda x: lm.score(spark.createDataFrame([(t,) for t in x], "text string"), frequent, network).agg(
        F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    pairs = list(zip(texts["en"], texts["fr"]))
    apart = [" ".join(t.split()[:60]) for pair in pairs for t in pair]
    mixed = [" ".join(w for two in zip(a.split()[:60], b.split()[:60]) for w in two) for a, b in pairs]
    assert mean(apart) > mean(mixed) + 0.02
    every = [t.encode() for x in texts.values() for t in x]
    ids, places, _ = lm.Tokens(frequent)(every)
    share = network_share(spark)
    assert mean([t.decode() for t in every]) > np.log(share)[ids[places]].mean() + 0.02


def network_share(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 <> 0")
    share = lm.corpus_counts(docs)[1] + 0.5
    return share / share.sum()


def test_odd_rows(spark, model):
    frequent, network = model
    rows = [(1, None, 1), (2, "", 1), (3, " .\n", 1), (4, "one", 1), (4, "one", 1), (None, "long word " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = lm.score(docs, frequent, network).collect()
    found = {r.row.doc_id: r for r in out}
    assert len(out) == 6 and all(found[i].n_tokens == 0 and found[i].log_likelihood == 0 for i in (1, 2, 3))
    assert found[None].n_tokens == 80_000 and found[4].log_likelihood < 0
    empty = docs.limit(0)
    assert lm.score(empty, [], lm.train(empty, *lm.corpus_counts(empty))).count() == 0


def test_query_is_whole_and_repeatable(spark):
    a = {r.doc_id: r for r in lm.op1_lm_scoring(spark, SF).collect()}
    b = {r.doc_id: r for r in lm.op1_lm_scoring(spark, SF).collect()}
    assert len(a) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(abs(a[k].log_likelihood - b[k].log_likelihood) < 1e-6 * (1 + abs(a[k].log_likelihood)) for k in a)


def test_every_word_has_its_own_probability(spark):
    texts = ["the cat sat in the house"] * 60 + ["a grouse ran to the house"] * 3 + [f"w{i}x and the rest" for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = lm.word_counts(docs)
    frequent, share, types = lm.most_frequent(counts, 2)
    assert types.sum() == counts.count() - 2 and share[lm.WORDS:].sum() == counts.agg(F.sum("n")).first()[0] - share[:2].sum()
    shares = lm.Shares(share, types)
    own = {bytes(r.word): r.n for r in counts.collect() if bytes(r.word) not in frequent}
    for k in range(lm.REST):  # the words seen and all other strings of a class make one
        n, t = share[lm.WORDS + k], max(types[k], 1)
        seen = [w for w in own if lm._ending(w) == k]
        rest = t / (n + t) * (1 - sum(math.exp(shares.spelling(w)) for w in seen))
        assert abs(sum(math.exp(shares(w, own[w])) for w in seen) + rest - 1) < 1e-9
    network = lm.train(docs, frequent, share)
    asked = [(i, f"the cat sat in the {w}", "q") for i, w in enumerate(["house", "grouse", "qxqzxse", "house", ""])] + [(None, None, None)]
    asked = spark.createDataFrame(asked, "id long, text string, n_tokens string")
    assert lm._ending(b"house") == lm._ending(b"grouse") == lm._ending(b"qxqzxse")
    plain = {r.row.id: r for r in lm.score(asked, frequent, network).collect()}
    for block_bytes in (20, 1 << 20):
        out = {r.row.id: r for r in lm.score_words(asked, frequent, network, counts, shares, block_bytes).collect()}
        assert len(out) == 6 and all(out[i].n_tokens == plain[i].n_tokens for i in out)
        assert out[0].log_likelihood == out[3].log_likelihood > out[1].log_likelihood + 1 > out[2].log_likelihood + 2
        assert out[None].n_tokens == out[None].log_likelihood == 0
        for i in range(5):
            extra = sum(shares(w, own.get(w, 0)) for w in lm.words(asked.where(f"id = {i}").first().text.encode()) if w not in frequent)
            assert abs(out[i].log_likelihood - plain[i].log_likelihood - extra) < 1e-6
    empty = lm.score_words(asked.limit(0), frequent, network, counts, shares)
    assert empty.count() == 0


def test_texts_split_at_once_have_the_same_words():
    rnd = np.random.default_rng(2)
    texts = [b"", b" ", b"One", b"  b C ", "\u00e9 'x\u2603 \U0001F600".encode(), b"", b"a" * 3000, b"\n"]
    texts += [bytes(rnd.choice(np.frombuffer(b"abAB '09.\xc3\xa9", np.uint8), 40)) for _ in range(60)]
    for some in (texts, texts[:1], [], texts[::-1]):
        found, at = lm.split(some)
        assert found.to_pylist() == [w for t in some for w in lm.words(t)]
        assert np.diff(at).tolist() == [len(lm.words(t)) for t in some]
        for own in (found, found.slice(min(3, len(found)))):
            classes, lengths = lm.endings(own)
            assert classes.tolist() == [lm._ending(w) for w in own.to_pylist()] and lengths.tolist() == list(map(len, own.to_pylist()))
        frequent = [b"one", b"a", b"never"]
        ids, places, at = lm.Tokens(frequent)(some)
        want = [[frequent.index(w) if w in frequent else lm.WORDS + lm._ending(w) for w in lm.words(t)] for t in some]
        border = [lm.VOCABULARY - 1] * lm.REACH
        assert ids.tolist() == border + [i for own in want for i in own + border]
        assert ids[places].tolist() == [i for own in want for i in own]


def test_words_are_counted_once_over_many_hand_overs(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 10)
    batches = [lm.pa.RecordBatch.from_arrays([lm.pa.array([f"w{k} the x{k % 3}", None, "The"])], ["text"]) for k in range(40)]
    total = {}
    for b in lm._counts(iter(batches)):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            total[w] = total.get(w, 0) + n
    assert total[b"the"] == 80 and total[b"x0"] == 14 and len(total) == 44 and sum(total.values()) == 160
