"""Toxicity: cumulative-link ordinal regression of severity on sparse text features.

Features are the words a document has (lower-cased runs of letters) and the beginnings of its words, out of the at most ``FEATURES`` that tell
toxic from other documents best by chi-square in the fit sample.  Severity has three grades.  The labels only say
toxic or not, so the toxic documents of the sample are graded by how many different clearly toxic words (found in
toxic documents at least ``CLEAR`` of the time) they hold: grade 2 from the median up, else grade 1; all others are
grade 0.  One weight vector is shared by the ordered thresholds: P(severity >= k) = sigmoid(w.x - theta_k).

At most ``FIT_ROWS`` labelled documents are fitted (see ``fit_sample``); word counts of the sample are made by Spark,
and only the chosen words and the sample's feature numbers come to the driver.

Null and empty texts have no features and get the severity of the bare thresholds.  Repeated rows score alike.  Without
labels of both kinds, or without a telling word, every severity is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import of, pieces, with_row
from ballotlake.llm.quality import _sigmoid, fit_sample

FIT_ROWS = 20_000
FEATURES = 4096
LEAST_DOCS = 3
CLEAR = 0.6
#: From this probability of any toxicity on a document is called toxic.
CALLED = 0.3
BEGINNINGS = (3, 4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str | None) -> set[str]:
    """The words of a text, and their beginnings (marked ``^``), which inflected forms share."""
    found = set(_WORD.findall(text.lower())) if text else set()
    return found.union(*({f"^{w[:k]}" for w in found if len(w) > k} for k in BEGINNINGS))


def _sample_words(batches):
    for batch in batches:
        for part in pieces(batch, limit=1 << 20):
            labels = part.column("label").to_pylist()
            found = [sorted(_words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([w for x in found for w in x], pa.string()),
                pa.array(np.repeat([1 if y else 0 for y in labels], [len(x) for x in found]).astype(np.int32)),
            ], ["word", "toxic"])


class Ordinal:
    """Cumulative links with shared weights, fitted by Adam on all rows at once."""

    def __init__(self, rows: np.ndarray, features: np.ndarray, n: int, width: int, grade: np.ndarray, steps: int = 400):
        self.w = np.zeros(width)
        self.theta = np.array([1.0, 2.0])
        gap = np.log(np.diff(self.theta))
        state = [np.zeros(width), np.zeros(2), np.zeros(width), np.zeros(2)]
        for step in range(1, steps + 1):
            link = np.bincount(rows, self.w[features], n)
            theta = np.array([self.theta[0], self.theta[0] + np.exp(gap[0])])
            above = _sigmoid(link[:, None] - theta)  # P(severity >= 1), P(severity >= 2)
            edges = np.column_stack([np.ones(n), above, np.zeros(n)])
            p = np.maximum(edges[np.arange(n), grade] - edges[np.arange(n), grade + 1], 1e-9)
            slope = np.column_stack([np.zeros(n), above * (1 - above), np.zeros(n)])
            low, high = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
            by_link = -(low - high) / p / n
            by_theta = np.zeros(2)
            for k in (1, 2):
                by_theta[k - 1] = (np.where(grade == k, low / p, 0) - np.where(grade + 1 == k, high / p, 0)).sum() / n
            grad_w = np.bincount(features, by_link[rows], width) + 2e-5 * self.w
            grad_t = np.array([by_theta.sum(), by_theta[1] * np.exp(gap[0])])
            for k, grad in enumerate((grad_w, grad_t)):
                state[k] = 0.9 * state[k] + 0.1 * grad
                state[k + 2] = 0.999 * state[k + 2] + 0.001 * grad ** 2
                move = 0.05 * (state[k] / (1 - 0.9 ** step)) / (np.sqrt(state[k + 2] / (1 - 0.999 ** step)) + 1e-10)
                if k == 0:
                    self.w -= move
                else:
                    self.theta[0] -= move[0]
                    gap[0] = np.clip(gap[0] - move[1], -4, 4)
        self.theta = np.array([self.theta[0], self.theta[0] + np.exp(gap[0])])

    def above(self, link: np.ndarray) -> np.ndarray:
        return _sigmoid(link[:, None] - self.theta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The weight of each telling word and the fitted thresholds; None where nothing can be learned."""
    sample = fit_sample(docs, labels, "toxic", fit_rows)
    sizes = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    all_, toxic = float(sum(sizes.values())), float(sizes[True])
    counts = sample.select("text", "label").mapInArrow(_sample_words, "word string, toxic int").groupBy("word").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("k"))
    expected = F.col("n") * toxic / all_
    chosen = counts.where(F.col("n") >= LEAST_DOCS).withColumn("chi", (F.col("k") - expected) ** 2 / expected).orderBy(
        F.desc("chi"), "word").limit(FEATURES).collect()
    if not chosen:
        return None
    number = {r["word"]: i for i, r in enumerate(chosen)}
    clear = np.array([r["k"] >= CLEAR * r["n"] for r in chosen])

    def encode(batches):
        for batch in batches:
            for part in pieces(batch):
                ids = [sorted(number[w] for w in _words(t) if w in number) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["label", "ids"])

    table = sample.select("text", "label").mapInArrow(encode, "label int, ids array<int>").toArrow()
    label = table.column("label").to_numpy() > 0
    lists = table.column("ids").combine_chunks()
    features = lists.flatten().to_numpy().astype(np.int64)
    n = len(label)
    rows = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
    strong = np.bincount(rows, clear[features], n)
    graded = strong[label & (strong > 0)]
    cut = np.median(graded) if len(graded) else 1
    grade = np.where(label, np.where(strong >= max(cut, 1), 2, 1), 0)
    return number, Ordinal(rows, features, n, len(number), grade)


def score_toxicity(docs: DataFrame, model) -> DataFrame:
    """Every row of ``docs`` as ``row`` with ``found``: expected severity, probability of any, most likely grade."""
    def score(batches):
        number, ordinal = model
        weight = {w: float(ordinal.w[i]) for w, i in number.items()}
        for batch in batches:
            for part in pieces(batch, "row.text"):
                link = np.array([sum(sorted(weight[w] for w in _words(t) if w in weight)) for t in of(part, "row.text").to_pylist()])
                above = ordinal.above(link)
                each = np.column_stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]])
                field = part.schema.field("found")
                found = pa.StructArray.from_arrays([
                    pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype(np.int32))], fields=list(field.type))
                yield part.set_column(part.schema.get_field_index("found"), field, found)

    kind = "struct<expected_severity:double,p_toxic:double,grade:int>"
    if model is None:
        nothing = F.struct(F.lit(0.0).alias("expected_severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"))
        return with_row(docs).select("row", nothing.alias("found"))
    out = with_row(docs).withColumn("found", F.lit(None).cast(kind))
    return out.mapInArrow(score, out.schema).select("row", "found")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("row.doc_id", "found.*", (F.col("found.p_toxic") >= CALLED).cast("int").alias("toxic"))
