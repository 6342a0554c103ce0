"""LM scoring: masked pseudo-likelihood of a bidirectional window network.

Tokens are lower-cased words.  The vocabulary holds the ``WORDS`` most frequent words of the whole corpus; every other
word is one of ``REST`` classes by its ending, so no token is lost.  The network predicts each token from the ``REACH``
tokens on either side: one embedding table per place, their sum through tanh, and a softmax over the vocabulary.  A
word of a class has the class's probability times its own share of the class, so that every word has its own.  A
document's score is the sum over its words of the log-probability of the word given both sides.

A word's share of its class is (its count + types * spelling) / (count of the class + types), with the class's number of
different words as types (Witten and Bell), so words that are rare or unseen have a small one.  The spelling share is that
of the word among all strings with such an ending, bytes drawn evenly; both add up to one over a class.  The counts
are a table of all words of the corpus, however many: documents are dealt into blocks of about ``BLOCK_BYTES``, and each
different word of a block is joined to its count.  Only the network, which has the classes, is of fixed size.

Everything is learned from all documents.  Word counts are added up in the tasks and then by Spark.  The network is
trained in ``ROUNDS`` rounds, each over another slice of the documents (by hash of the text), so that all take part
once: in a round every task starts from the same weights and runs minibatch descent in numpy over its rows, and Spark
averages the weights of the tasks, weighted by their tokens, row by row of the weight tables.  What goes to the driver
is one set of weights per round, of fixed size.

Tokens beside the text's ends are a border token.  A null, empty or blank text has no tokens, score 0 and no mean.
Repeated rows are scored alike and count as often as they occur.  As
the weights of tasks are averaged, scores depend a little on how the table's files are split into tasks.  An empty table trains nothing and scores nothing.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import matrix, number_rows, number_schema, of, offsets, pieces, raw, summed_rows, with_row, written

WORDS = 96
REST = 31
REACH = 2
WIDTH = 16
ROUNDS = 3
BATCH = 2048
RATE = 3.0
BLOCK_BYTES = 16 << 20
#: Different words that a task counts before it hands them on.
COUNTED = 200_000

VOCABULARY = WORDS + REST + 1  # the last is the border
# Letters, digits, the apostrophe and all beyond ASCII; A-Z in lower case, anything else a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or c == 0x27 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256))
LETTERS = sorted(set(_FOLD) - {0x20})


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def split(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """What ``words`` gives for many texts: all words in order, and where each text's begin among these."""
    data = b" ".join([b"", *texts, b""]).translate(_FOLD)
    letter = np.frombuffer(data, np.uint8) != 0x20
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    at = np.searchsorted(begin, offsets([len(t) + 1 for t in texts]) + 1)
    places = offsets(end - begin).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(data.translate(None, b" "))]), at


def _counts(batches):
    held, n = [], 0
    for batch in batches:
        for part in pieces(batch):
            found = split(raw(part.column("text")))[0].value_counts()
            held.append(pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"]))
            n += len(found)
            if n > COUNTED:
                held = _counted(held)
                n = sum(x.num_rows for x in held)
            if n > COUNTED:
                yield from held
                held, n = [], 0
    if held:
        yield from _counted(held)


def _counted(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    total = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.Table.from_arrays([total.column("word"), total.column("n_sum")], ["word", "n"]).to_batches()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents."""
    return written(
        docs.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def most_frequent(counts: DataFrame, n: int = WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The most frequent words (ties by the word), the count of every token of the vocabulary, and the different words of each class."""
    top = counts.orderBy(F.desc("n"), "word").limit(n).collect()
    ending = (F.crc32(F.expr("substring(word, -2, 2)")) % REST).cast("int")
    share, types = np.zeros(VOCABULARY), np.zeros(REST)
    for r in counts.groupBy(ending.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        share[WORDS + r["k"]], types[r["k"]] = r["n"], r["types"]
    for i, r in enumerate(top):
        share[i] = r["n"]
        share[WORDS + _ending(bytes(r["word"]))] -= r["n"]
        types[_ending(bytes(r["word"]))] -= 1
    return [bytes(r["word"]) for r in top], share, types


def corpus_counts(docs: DataFrame, n: int = WORDS) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words of all documents (ties by the word), and the count of every token of the vocabulary."""
    return most_frequent(word_counts(docs), n)[:2]


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % REST


@cache
def _endings() -> tuple[np.ndarray, np.ndarray]:
    """The class of every word of one byte, and of every two bytes at an end."""
    one = [_ending(bytes([a])) for a in range(256)]
    return np.array(one), np.array([_ending(bytes([a, b])) for a in range(256) for b in range(256)])


def endings(found: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The classes of many words, none of them empty, and their lengths."""
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.frombuffer(found.buffers()[1], np.int32)[found.offset:found.offset + len(found) + 1].astype(np.int64)
    data, lengths = np.frombuffer(found.buffers()[2], np.uint8), np.diff(places)
    one, two = _endings()
    last = data[places[1:] - 1].astype(np.int64)
    return np.where(lengths == 1, one[last], two[data[np.maximum(places[1:] - 2, 0)].astype(np.int64) * 256 + last]), lengths


class Shares:
    """Log of a word's share of its class, from the counts and the different words of the classes."""

    def __init__(self, share: np.ndarray, types: np.ndarray):
        self.counts, self.types = share[WORDS:WORDS + REST].tolist(), np.maximum(types, 1).tolist()
        self.endings = [0] * REST
        for a in LETTERS:
            self.endings[_ending(bytes([a]))] += 1
            for b in LETTERS:
                self.endings[_ending(bytes([a, b]))] += 1

    def spelling(self, word: bytes) -> float:
        """Log of the share of a word among all strings with an ending of its class."""
        return (1 - len(word)) * math.log(len(LETTERS) + 1) - math.log(self.endings[_ending(word)])

    def __call__(self, word: bytes, n: int) -> float:
        k = _ending(word)
        spelt = math.log(self.types[k]) + self.spelling(word)
        seen = math.log(n) if n else -math.inf
        return float(np.logaddexp(seen, spelt)) - math.log(self.counts[k] + self.types[k])


    def of_words(self, classes: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for many words, from their classes, lengths and counts."""
        counts, types = np.array(self.counts), np.array(self.types, float)
        spelt = np.log(types)[classes] + (1 - lengths) * math.log(len(LETTERS) + 1) - np.log(np.array(self.endings, float))[classes]
        with np.errstate(divide="ignore"):
            seen = np.log(n.astype(float))
        return np.logaddexp(seen, spelt) - np.log(counts + types)[classes]


def bordered(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with ``REACH`` border tokens around each text, and the places of the real ones; ``at``: where each text's begin."""
    n = len(at) - 1
    tokens = np.full(len(ids) + REACH * (n + 1), VOCABULARY - 1, np.int64)
    places = np.arange(len(ids)) + REACH * (1 + np.repeat(np.arange(n), np.diff(at)))
    tokens[places] = ids
    return tokens, places


class Tokens:
    """Token numbers of texts, with borders, the places of the real ones, and where each text's begin among these."""

    def __init__(self, frequent: list[bytes]):
        self.frequent = frequent

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, at = split(texts)
        found = found.dictionary_encode()
        ids = WORDS + endings(found.dictionary)[0]
        known = pa.compute.index_in(pa.array(self.frequent, pa.binary()), value_set=found.dictionary)
        for i, k in enumerate(known.to_pylist()):
            if k is not None:
                ids[k] = i
        return *bordered(ids[found.indices.to_numpy()], at), at


SIDES = [d for d in range(-REACH, REACH + 1) if d]
ROWS = VOCABULARY * (len(SIDES) + 1) + 1  # embeddings of each side, output weights, and the hidden bias


class Window:
    """The network; its weights are rows of ``WIDTH`` + 1 numbers (the last one: the output bias)."""

    def __init__(self, weights: np.ndarray):
        cut = VOCABULARY * len(SIDES)
        self.embed = np.ascontiguousarray(weights[:cut, :WIDTH], np.float32).reshape(len(SIDES), VOCABULARY, WIDTH)
        self.out = np.ascontiguousarray(weights[cut:-1, :WIDTH], np.float32)
        self.bias = weights[cut:-1, WIDTH].astype(np.float32)
        self.hidden_bias = weights[-1, :WIDTH].astype(np.float32)

    def weights(self) -> np.ndarray:
        out = np.zeros((ROWS, WIDTH + 1))
        cut = VOCABULARY * len(SIDES)
        out[:cut, :WIDTH] = self.embed.reshape(cut, WIDTH)
        out[cut:-1, :WIDTH], out[cut:-1, WIDTH], out[-1, :WIDTH] = self.out, self.bias, self.hidden_bias
        return out

    def _forward(self, tokens: np.ndarray, places: np.ndarray, room: np.ndarray):
        """The tokens beside each place, the hidden layer, and the softmax before its division: numerators, in ``room``, and their sums."""
        beside = [tokens.take(places + d) for d in SIDES]
        total = self.embed[0].take(beside[0], axis=0)
        total += self.hidden_bias
        for k in range(1, len(SIDES)):
            total += self.embed[k].take(beside[k], axis=0)
        hidden = np.tanh(total, out=total)
        logits = np.matmul(hidden, self.out.T, out=room[:len(places)])
        logits += self.bias
        if self._wide():
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        return beside, hidden, logits, logits.sum(1)

    def _wide(self) -> bool:
        """Whether a logit could leave the range of the exponential function in single precision."""
        return bool((np.abs(self.out).sum(1) + np.abs(self.bias)).max() > 60)

    def log_probabilities(self, tokens: np.ndarray, places: np.ndarray) -> np.ndarray:
        out, room = np.empty(len(places)), np.empty((BATCH, VOCABULARY), np.float32)
        for a in range(0, len(places), BATCH):
            at = places[a:a + BATCH]
            _, _, e, total = self._forward(tokens, at, room)
            out[a:a + BATCH] = np.log(np.maximum(e[np.arange(len(at)), tokens[at]] / total, 1e-12))
        return out

    def train(self, tokens: np.ndarray, places: np.ndarray) -> None:
        room = np.empty((BATCH, VOCABULARY), np.float32)
        for a in range(0, len(places), BATCH):
            at = places[a:a + BATCH]
            wanted = tokens[at]
            beside, hidden, e, total = self._forward(tokens, at, room)
            share = (1 / total)[:, None]
            back = ((e @ self.out) * share - self.out[wanted]) * (1 - hidden ** 2)
            rate = np.float32(RATE * min(1.0, len(at) / BATCH) / len(at))
            self.out -= rate * (e.T @ (hidden * share) - _sums(wanted, hidden))
            self.bias -= rate * ((share.T @ e)[0] - np.bincount(wanted, minlength=VOCABULARY).astype(np.float32))
            self.hidden_bias -= rate * back.sum(0)
            for k, tokens_ in enumerate(beside):
                self.embed[k] -= 4 * rate * _sums(tokens_, back)


def _sums(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each token of the vocabulary: the rows in token order, added up run by run."""
    order = np.argsort(tokens.astype(np.uint8 if VOCABULARY <= 256 else np.int64), kind="stable")
    own = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((VOCABULARY, rows.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(rows.take(order, axis=0), first, axis=0)
    return out


def first_weights(share: np.ndarray) -> np.ndarray:
    """Small random weights; the output bias is the log-frequency of each token."""
    random = np.random.default_rng(3)
    out = random.normal(0, 0.3, (ROWS, WIDTH + 1))
    cut = VOCABULARY * len(SIDES)
    out[cut:, :WIDTH] *= 0.1
    out[:, WIDTH] = 0
    out[cut:-1, WIDTH] = np.log((share + 0.5) / (share + 0.5).sum())
    out[-1] = 0
    return out


def train(docs: DataFrame, frequent: list[bytes], share: np.ndarray, rounds: int = ROUNDS) -> Window:
    tokens = Tokens(frequent)
    weights = first_weights(share)
    for k in range(rounds):
        def descend(batches, start=weights):
            network, seen = Window(start), 0
            for batch in batches:
                for part in pieces(batch):
                    ids, places, _ = tokens(raw(part.column("text")))
                    # Shuffled, as neighbours in a text are alike; always in the same order.
                    network.train(ids, np.random.default_rng(len(places)).permutation(places))
                    seen += len(places)
            if seen:
                own = np.column_stack([network.weights(), np.ones(ROWS)])
                yield number_rows("row", np.arange(ROWS), own * seen)

        part = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k) if rounds > 1 else docs.select("text")
        sums = matrix(summed_rows(part.mapInArrow(descend, number_schema("row", WIDTH + 2)), "row", WIDTH + 2), "row", ROWS, WIDTH + 2)
        if sums[0, -1]:
            weights = sums[:, :-1] / sums[:, -1:]
    return Window(weights)


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each text's values, whatever stands before it."""
    out = np.zeros(len(at) - 1)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, at[:-1][some])
    return out


def score(docs: DataFrame, frequent: list[bytes], network: Window) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``n_tokens`` and ``log_likelihood``."""
    tokens = Tokens(frequent)

    def scored(batches):
        for batch in batches:
            for part in pieces(batch, "row.text"):
                ids, places, at = tokens(raw(of(part, "row.text")))
                total = _per_text(network.log_probabilities(ids, places), at)
                field = part.schema.field("found")
                found = pa.StructArray.from_arrays([pa.array(np.diff(at)), pa.array(total)], fields=list(field.type))
                yield part.set_column(part.schema.get_field_index("found"), field, found)

    out = with_row(docs).withColumn("found", F.lit(None).cast("struct<n_tokens:bigint,log_likelihood:double>"))
    return out.mapInArrow(scored, out.schema).select("row", "found.*")


def score_words(docs: DataFrame, frequent: list[bytes], network: Window, counts: DataFrame, shares: Shares, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``score``, with every word's share of its class; ``counts`` is (word, n)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    rows = with_row(docs).withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    rows = rows.repartition(blocks, "block")

    def different(batches):
        """(block, word) of the words of classes, each once per block and piece."""
        for batch in batches:
            for part in pieces(batch, "row.text"):
                block = part.column("block").to_numpy()
                order = np.argsort(block, kind="stable")
                texts = raw(of(part, "row.text"))
                found, at = split([texts[i] for i in order.tolist()])
                found = found.dictionary_encode()
                place, classed = found.indices.to_numpy(), pa.compute.is_in(found.dictionary, value_set=pa.array(frequent, pa.binary()))
                others, had = ~classed.to_numpy(zero_copy_only=False), np.zeros(len(found.dictionary), bool)
                for begin, stop in zip(starts := [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist()], [*starts[1:], len(order)]):
                    had[place[at[begin]:at[stop]]] = True
                    own = np.flatnonzero(had & others)
                    had[:] = False
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), block[order[begin]], np.int32)), found.dictionary.take(pa.array(own))], ["block", "word"])

    had = rows.mapInArrow(different, "block int, word binary").dropDuplicates(["block", "word"])
    counted = had.join(counts, "word", "left").select("block", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    shape = rows.select("row", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("double").alias("log_likelihood")).schema

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        # Every word of the block has a place here: its token, and the log of its share of its class.
        others = pa.concat_arrays([pa.array([], pa.binary()), *right.column("word").cast(pa.binary()).chunks])
        classes, lengths = endings(others)
        token = np.concatenate([np.arange(len(frequent)), WORDS + classes])
        own = np.concatenate([np.zeros(len(frequent)), shares.of_words(classes, lengths, right.column("n").to_numpy())])
        known = pa.concat_arrays([pa.array(frequent, pa.binary()), others])
        out = []
        for batch in left.select(["row"]).combine_chunks().to_batches():
            for part in pieces(batch, "row.text"):
                found, at = split(raw(of(part, "row.text")))
                found = found.dictionary_encode()
                place = pa.compute.index_in(found.dictionary, value_set=known)
                if place.null_count:
                    raise ValueError("a block's words are not those its rows had before: the input gave other rows when read again")
                flat = place.to_numpy().astype(np.int64)[found.indices.to_numpy()]
                ids, places = bordered(token[flat], at)
                total = _per_text(network.log_probabilities(ids, places) + own[flat], at)
                out.append(pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.diff(at)), pa.array(total)], ["row", "n_tokens", "log_likelihood"]))
        return pa.Table.from_batches(out)

    return rows.select(F.col("block").alias("of"), "row").groupBy("of").cogroup(counted.groupBy("block")).applyInArrow(scored, shape)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = word_counts(docs)
    frequent, share, types = most_frequent(counts)
    scored = score_words(docs, frequent, train(docs, frequent, share), counts, Shares(share, types))
    return scored.select("row.doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
