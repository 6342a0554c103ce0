"""Ranked lexical search: exact top documents per query by norm buckets of impact vectors.

A document is a vector with one coordinate per query term, its impact there; a query is a vector of term weights.  The
score is their product in whole numbers.  For the bounds both sides carry the square root of the weight, which leaves the
product as it is and keeps frequent terms from filling the lengths.

1. Documents are read once, where they are: number of terms, and the query terms with their counts.  Nothing is shuffled.
   From this table come N, L and df over all documents, hence impacts and lengths.
2. Vectors are ordered by length, longest first, over range partitions (a row mark splits equal lengths), and written.
   Files hold one stretch of lengths each, so a bound on the length skips files.
3. Rounds go from the longest vectors down.  Each starts from the thresholds the ones before it left: a query's k-th
   best score.  In a round every task cuts its sorted rows into buckets of ``BUCKET`` vectors.  A bucket
   whose greatest length times the query's cannot reach the threshold is skipped (Cauchy-Schwarz).  Inside, each of the
   query's greatest coordinates must lie within the bounds that the threshold sets for a unit vector, and the product
   over them plus the greatest possible rest must reach it.  What survives is scored exactly in 64-bit integers, and the
   task's own k-th best score becomes the threshold of its next bucket.  A task hands on k documents a query.

The bounds only ever let go what is below the threshold, so equal scores stay and the result is exact, whatever the rounds.

Queries are searched in blocks of about ``BLOCK_BYTES`` of different terms, one block after the other; only a block's terms,
weights and thresholds are on the driver and in a task.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null and empty texts have none and are
never found; an item without terms has no rows.  Every row of ``docs`` is a document of its own, also if an id is repeated;
rows of items that share an id are one item.  Equal scores go by ascending id, null last.  Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotlake.llm.common import offsets, pieces, raw, written
from ballotlake.llm.decontaminate import words

TOP = 10
BLOCK_BYTES = 8 << 20
#: Vectors, and coordinates, of a bucket.
BUCKET, BUCKET_TERMS = 4096, 1 << 20
#: How many of a query's coordinates are bounded one by one.
FOCUS = 6
#: Shares of the vectors, longest first, that the rounds before the last one read.
ROUNDS = (0.02, 0.2)
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds are computed in doubles and widened by this share.
_SLACK = 1e-9


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, each once."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(_TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(found)).alias("term")).distinct()


def _counted(docs: DataFrame, key: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, tf): the document's number of terms, and its query terms with their counts, in order."""
    size = len(number)

    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                ids, lengths = [], []
                for x in raw(part.column("text")):
                    found = words(x)
                    lengths.append(len(found))
                    ids.append(np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found)))
                place = np.repeat(np.arange(len(ids)), lengths) if ids else np.zeros(0, np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                known = flat >= 0
                keys, tf = np.unique(place[known] * size + flat[known], return_counts=True)
                starts = offsets(np.bincount(keys // size, minlength=len(ids))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(starts, pa.array((keys % size).astype(np.int32))),
                    pa.ListArray.from_arrays(starts, pa.array(tf.astype(np.int32))),
                ], ["doc_id", "n", "at", "tf"])

    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(count, "doc_id bigint, n bigint, at array<int>, tf array<int>")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin."""
    column = batch.column(name)
    starts = np.asarray(column.offsets).astype(np.int64)
    return column.values.to_numpy()[starts[0]:starts[-1]], starts - starts[0]


def _measured(counted: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """(doc_id, length, at, impact) of the documents that have a query term."""

    def measure(batches):
        for batch in batches:
            at, starts = _lists(batch, "at")
            tf, _ = _lists(batch, "tf")
            sizes = np.diff(starts)
            different, which = np.unique(batch.column("n").to_numpy(), return_inverse=True)
            # In Python's integers: the product may exceed 64 bits.
            m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in different], np.int64)[which]
            tf = tf.astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            squares = np.concatenate([[0.0], np.cumsum(weights[at] * impact.astype(np.float64) ** 2)])
            length = np.sqrt(squares[starts[1:]] - squares[starts[:-1]])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(length), pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(at)),
                pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(impact.astype(np.int32))),
            ], ["doc_id", "length", "at", "impact"])

    return counted.where(F.size("at") > 0).mapInArrow(measure, "doc_id bigint, length double, at array<int>, impact array<int>")


@dataclass
class Queries:
    """The items of one block: term numbers of each, the weights of all terms, and the thresholds so far."""
    terms: list[np.ndarray]
    weights: np.ndarray
    least: np.ndarray
    top: int
    bucket: int = BUCKET

    def norm(self, q: int) -> float:
        return float(np.sqrt(self.weights[self.terms[q]].sum()))


class _Bucket:
    """Vectors of nearly one length, by row and by term."""

    def __init__(self, ids, none, length, at, impact, starts, queries: Queries):
        self.ids, self.none, self.length, self.queries = ids, none, length, queries
        self.at, self.impact, self.starts = at, impact, starts
        order = np.argsort(at, kind="stable")
        self.rows = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.value = np.sqrt(queries.weights[at[order]]) * impact[order]
        self.terms, begin = np.unique(at[order], return_index=True)
        self.begin = np.append(begin, len(at))

    def column(self, term: int) -> slice | None:
        k = int(np.searchsorted(self.terms, term))
        return slice(self.begin[k], self.begin[k + 1]) if k < len(self.terms) and self.terms[k] == term else None

    def survivors(self, q: int, least: int) -> np.ndarray:
        """Rows that the bounds leave for query ``q``."""
        norm = self.queries.norm(q)
        low = least * (1 - _SLACK)
        cosine = low / (norm * self.length)
        left = cosine <= 1
        if least <= 0 or not left.any():
            return np.flatnonzero(left)
        cosine = np.minimum(cosine, 1.0)
        sine = np.sqrt(1 - cosine ** 2)
        own = self.queries.terms[q]
        weights = self.queries.weights[own]
        product, square, used = np.zeros(len(left)), np.zeros(len(left)), 0.0
        for k in np.argsort(-weights, kind="stable")[:FOCUS]:
            value = np.zeros(len(left))
            if (column := self.column(int(own[k]))) is not None:
                value[self.rows[column]] = self.value[column]
            one = math.sqrt(weights[k])
            # A unit vector at that angle or less to the query has this coordinate within these bounds.
            middle, width = cosine * (one / norm), sine * math.sqrt(max(0.0, 1 - weights[k] / norm ** 2)) + _SLACK
            unit = value / self.length
            left &= (unit >= middle - width) & ((unit <= middle + width) | (one * value >= low))
            product += one * value
            square += value ** 2
            used += weights[k]
        rest = math.sqrt(max(0.0, norm ** 2 - used)) * np.sqrt(np.maximum(0.0, self.length ** 2 * (1 + _SLACK) - square))
        return np.flatnonzero(left & ((product + rest) * (1 + _SLACK) >= low))

    def scores(self, rows: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``weight_of`` is the query's weight of every term, 0 elsewhere."""
        begin, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = offsets(size)
        places = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
        return np.add.reduceat(weight_of[self.at[places]] * self.impact[places], ends[:-1])


def _buckets(batch: pa.RecordBatch, queries: Queries):
    """The sorted rows of a batch in slices of at most ``bucket`` vectors or about ``BUCKET_TERMS`` coordinates."""
    at, starts = _lists(batch, "at")
    impact, _ = _lists(batch, "impact")
    impact = impact.astype(np.int64)
    none = np.asarray(batch.column("doc_id").is_null())
    ids = batch.column("doc_id").fill_null(0).to_numpy()
    length = batch.column("length").to_numpy()
    a = 0
    while a < len(ids):
        b = min(a + queries.bucket, max(a + 1, int(np.searchsorted(starts, starts[a] + BUCKET_TERMS, "right")) - 1), len(ids))
        cut = slice(starts[a], starts[b])
        yield _Bucket(ids[a:b], none[a:b], length[a:b], at[cut], impact[cut], starts[a:b + 1] - starts[a], queries)
        a = b


def _searcher(queries: Queries):
    def search(batches):
        size = len(queries.terms)
        least = queries.least.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(size)]
        weight_of = np.zeros(len(queries.weights), np.int64)
        norms = np.array([queries.norm(q) for q in range(size)])
        for batch in batches:
            for bucket in _buckets(batch, queries):
                longest = float(bucket.length.max())
                for q in np.flatnonzero(norms * longest * (1 + _SLACK) >= least):
                    rows = bucket.survivors(q, int(least[q]))
                    if not len(rows):
                        continue
                    own = queries.terms[q]
                    weight_of[own] = queries.weights[own]
                    score = bucket.scores(rows, weight_of)
                    weight_of[own] = 0
                    good = score >= max(1, least[q])
                    if not good.any():
                        continue
                    score, rows = score[good], rows[good]
                    score, ids, none = (np.concatenate(x) for x in zip(best[q], (score, bucket.ids[rows], bucket.none[rows])))
                    first = np.lexsort((ids, none, -score))[:queries.top]
                    best[q] = score[first], ids[first], none[first]
                    if len(first) == queries.top:
                        least[q] = max(least[q], score[first[-1]])
        counts = [len(x[0]) for x in best]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(size, dtype=np.int32), counts)),
            pa.array(np.concatenate([x[1] for x in best] or [[]]).astype(np.int64), mask=np.concatenate([x[2] for x in best] or [[]]).astype(bool)),
            pa.array(np.concatenate([x[0] for x in best] or [[]]).astype(np.int64)),
        ], ["item", "doc_id", "score"])

    return search


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(vectors: DataFrame, queries: Queries) -> DataFrame:
    """(item, rank, doc_id, score) over all vectors, in rounds from the longest down."""
    edges = vectors.agg(F.percentile_approx("length", F.lit([1 - x for x in ROUNDS]), F.lit(1000))).first()[0] or []
    edges = [math.inf, *edges, -1.0]
    found = None
    for k, (above, upto) in enumerate(zip(edges, edges[1:])):
        norms = np.array([queries.norm(q) for q in range(len(queries.terms))])
        short = float((queries.least / np.maximum(norms, 1e-300)).min()) * (1 - _SLACK) if len(norms) else 0.0
        rows = vectors.where((F.col("length") < above) & (F.col("length") >= max(upto, short)))
        here = rows.mapInArrow(_searcher(queries), "item int, doc_id bigint, score bigint")
        found = written(_best(here if found is None else here.unionByName(found.drop("rank")), queries.top), f"found-{k}")
        full = found.where(F.col("rank") == queries.top).select("item", "score").toArrow()
        queries.least[full.column("item").to_numpy()] = full.column("score").to_numpy()
    return found


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
    bucket: int = BUCKET,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, best first, scores above 0 only."""
    asked = written(item_terms(items.select("item_id", "text")), "item-terms")
    kind = asked.schema["item_id"].dataType.simpleString()
    total = asked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = asked.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    sizes = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        own = block.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
        lists = own.column("terms").to_pylist()
        if not lists:
            continue
        number = {t.encode(): i for i, t in enumerate(sorted({t for x in lists for t in x}))}
        counted = written(_counted(docs, key, text, number), "counts")
        # Of all documents, so the same for every block.
        sizes = sizes or tuple(counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
        if not sizes[0]:
            break
        df = np.zeros(len(number), np.int64)
        held = counted.select(F.explode("at").alias("term")).groupBy("term").count().toArrow()
        df[held.column("term").to_numpy()] = held.column("count").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * sizes[0] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        vectors = _measured(counted, *sizes, weights).withColumn("mark", F.monotonically_increasing_id())
        vectors = vectors.repartitionByRange(F.desc("length"), F.xxhash64("mark")).sortWithinPartitions(F.desc("length")).drop("mark")
        vectors = written(vectors, "vectors")
        terms = [np.array([number[t.encode()] for t in x], np.int64) for x in lists]
        found = _search_block(vectors, Queries(terms, weights, np.zeros(len(terms), np.int64), top, bucket))
        names = asked.sparkSession.createDataFrame(pa.table({
            "item": pa.array(range(len(lists)), pa.int32()), "item_id": own.column("item_id")}))
        out = out.unionByName(found.join(names, "item").select(F.col("item_id").cast(kind), "rank", "doc_id", "score"))
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_terms(table: str, key: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, unnest(regexp_extract_all({lower}, '{_TERM}')) AS term FROM {table}"


OP11_SQL = f"""
WITH held AS ({_sql_terms('documents', 'doc_id')}),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
sizes AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id, term FROM ({_sql_terms('benchmark', 'item_id')})),
weighed AS (
  SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM asked JOIN dfs USING (term), sizes
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM weighed JOIN tfs USING (term) JOIN lengths USING (doc_id), sizes GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
