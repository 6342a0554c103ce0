"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors cover the whole corpus.  Every word (hashed to one of ``BUCKETS`` entries) has a sparse random index
vector; the vector of a word is the sum of the index vectors of the words up to ``REACH`` places beside it, over all
documents.  Each task adds up one table of fixed size, and Spark sums the tables by entry.  A document is the mean of
its word vectors, the mean product of adjacent ones (which tells runs of one word), and its length.

A network of two layers is trained in numpy on at most ``FIT_ROWS`` labelled documents, those with the smallest
hashes of their id among the training rows; a fifth of them is left out of the training and sets the temperature that
calibrates the probabilities.  Labels, language, source and id are never inputs.

A null text is scored like an empty one (no words, all features zero).  Repeated rows are scored alike.  Labels that
are null are not used; without any labels every score is 0.5.  Rows with a null id are never held out or learned from.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import matrix, number_rows, number_schema, of, offsets, pieces, raw, summed_rows, with_row

BUCKETS = 1 << 13
DIM = 32
REACH = 2
#: Bytes of text pooled at once; their word vectors take some 60 times as much.
POOLED_BYTES = 1 << 20
FIT_ROWS = 20_000
HIDDEN = 32
ACCEPT = 0.3
FEATURES = 2 * DIM + 1

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs per entry."""
    random = np.random.default_rng(11)
    return random.integers(0, DIM, (BUCKETS, 2)), random.choice([-1.0, 1.0], (BUCKETS, 2))


def _entries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all words, end to end, and where each text starts."""
    found = [_TOKEN.findall(t) for t in texts]
    at = offsets([len(x) for x in found])
    codes = np.fromiter((c for x in found for c in map(zlib.crc32, x)), np.int64, int(at[-1]))
    return codes & (BUCKETS - 1), at


def _neighbours(batches):
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    count = np.zeros(BUCKETS)
    for batch in batches:
        for part in pieces(batch):
            entry, at = _entries(raw(part.column("text")))
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            count += np.bincount(entry, minlength=BUCKETS)
            for reach in range(1, REACH + 1):
                same = text[reach:] == text[:-reach]
                left, right = entry[:-reach][same], entry[reach:][same]
                for word, beside in ((left, right), (right, left)):
                    for k in range(2):
                        total += np.bincount(word * DIM + places[beside, k], signs[beside, k], BUCKETS * DIM)
    seen = np.flatnonzero(count)
    yield number_rows("entry", seen, np.column_stack([total.reshape(BUCKETS, DIM)[seen], count[seen]]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One row per entry, from all documents; the table's size does not depend on them."""
    tables = docs.select("text").mapInArrow(_neighbours, number_schema("entry", DIM + 1))
    sums = matrix(summed_rows(tables, "entry", DIM + 1), "entry", BUCKETS, DIM + 1)
    count = sums[:, DIM:]
    if not count.any():
        return np.zeros((BUCKETS, DIM), np.float32)
    vectors = sums[:, :DIM] / np.maximum(count, 1)
    vectors -= (vectors * count).sum(0) / count.sum()
    vectors *= count > 0
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    entry, at = _entries(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    counts = np.diff(at)
    some = np.flatnonzero(counts)
    if len(some):
        words = vectors[entry]
        beside = np.zeros_like(words)
        beside[:-1] = words[:-1] * words[1:]
        beside[at[1:][some] - 1] = 0
        n = counts[some, None]
        out[some, :DIM] = np.add.reduceat(words, at[some], axis=0) / n
        out[some, DIM:2 * DIM] = np.add.reduceat(beside, at[some], axis=0) / np.maximum(n - 1, 1)
        out[:, -1] = np.log1p(counts)
    return out


class Network:
    """tanh layer and logistic output, by Adam; ``temperature`` divides the output before the sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 3000, seed: int = 5):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        aside = random.random(len(x)) < 0.2
        if aside.all() or len(np.unique(y[~aside])) < 2:
            aside[:] = False
        wide = x.shape[1]
        self.w = [random.normal(0, wide ** -0.5, (wide, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        train_x, train_y = x[~aside], y[~aside]
        for step in range(1, steps + 1):
            pick = random.integers(0, len(train_x), 256)
            bx, by = train_x[pick], train_y[pick]
            hidden = np.tanh(bx @ self.w[0] + self.w[1])
            error = (_sigmoid(hidden @ self.w[2] + self.w[3][0]) - by) / len(by)
            back = np.outer(error, self.w[2]) * (1 - hidden ** 2)
            slopes = [bx.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
            rate = 0.01 * (1 - step / (steps + 1))
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope ** 2
                self.w[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        self.temperature = 1.0
        if aside.any():
            logits, truth = self._logits(x[aside]), y[aside]
            loss = lambda t: -np.mean(np.log(np.where(truth == 1, _sigmoid(logits / t), _sigmoid(-logits / t)) + 1e-12))
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def remainder(doc_id="doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id="doc_id") -> F.Column:
    """The ids that nothing is learned from."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled training documents, always the same ones."""
    chosen = (
        labels.where(F.col(label).isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` rows of two numbers.  Of rows that repeat an id, the first text in order stands for them.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The word vectors of ``docs`` and the network fitted to ``labels`` (doc_id, quality); None without labels."""
    vectors = word_vectors(docs)

    def pool(batches):
        for batch in batches:
            for part in pieces(batch, limit=POOLED_BYTES):
                x = _pooled(raw(part.column("text")), vectors)
                flat = pa.array(x.ravel(), pa.float32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").cast(pa.int32()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, flat)],
                    ["label", "x"])

    sample = fit_sample(docs, labels, "quality", fit_rows).mapInArrow(pool, "label int, x array<float>").toArrow()
    if not sample.num_rows:
        return vectors, None
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(float)
    y = (sample.column("label").to_numpy() > 0).astype(float)
    order = np.lexsort(x.T)  # rows arrive in any order
    return vectors, Network(x[order], y[order])


def score_quality(docs: DataFrame, model) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``score``."""
    vectors, network = model

    def score(batches):
        for batch in batches:
            for part in pieces(batch, "row.text", POOLED_BYTES):
                x = _pooled(raw(of(part, "row.text")), vectors)
                y = network(x.astype(float)) if network else np.full(len(x), 0.5)
                yield part.set_column(part.schema.get_field_index("score"), part.schema.field("score"), pa.array(y, pa.float64()))

    out = with_row(docs).withColumn("score", F.lit(None).cast("double"))
    return out.mapInArrow(score, out.schema).select("row", "score")


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that score at least ``accept``, with the columns they came with."""
    return score_quality(docs, fit_quality(docs, labels)).where(F.col("score") >= accept).select("row.*")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
