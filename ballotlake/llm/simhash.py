"""SimHash near-dedup: fingerprints of word shingles, linked by a generalised pigeonhole search.

**Fingerprints.** Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; the shingles are all runs of four words
joined by a space (a shorter text is one shingle), each hashed with XXH64, seed 42.  A bit is 1 if it is set in over
half of the hashes.  A text without words, null included, has fingerprint zero.

**Search.** Fingerprints of up to ``DISTANCE`` differing bits are linked.  Bits that go together over all fingerprints
are put into one partition.  With thresholds t of the partitions such that the t + 1 add up to DISTANCE + 1, two
linked fingerprints differ in at most t bits of some partition.  Number of partitions and thresholds are those of
least cost: dynamic programming over the partitions on estimated rows to shuffle and candidates to compare, from
the counts of all fingerprints.  Every fingerprint then probes its own value and all values within t bits; candidates
meet in an equi-join by value and are compared in full inside the join, so only links come out of it.

**Classes.** Equal fingerprints are one node, so copies cost nothing here.  A node has a bounded number of links (those
that differ in at most 4 of 64 bits), and hot values of a partition are split by adaptive execution, since both sides
of the join come straight from their shuffles.  Components are found by alternating star contraction on the links;
each round is cut from the lineage by a written table.

Ids may be null: such a row has a fingerprint and a component, whose id is null if no member has one.  Rows that repeat
an id are members like others.  Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import matrix, number_rows, number_schema, of, pieces, raw, summed_rows, written

SHINGLE = 4
DISTANCE = 4
BITS = 64

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    k = min(SHINGLE, len(words))
    hashed = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1:] - 1).tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = np.array(hashed[at:at + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        for part in pieces(batch):
            found = np.array([fingerprint(t) for t in raw(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _bit_table(batches):
    """Of a task's fingerprints: how often each bit is set with each other, and in the last column its own count."""
    total = np.zeros((BITS, BITS))
    count = 0
    for batch in batches:
        bits = np.unpackbits(np.asarray(batch.column("fp")).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        total += bits.T @ bits
        count += len(bits)
    yield number_rows("bit", np.arange(BITS), np.column_stack([total, np.full(BITS, float(count))]))


def grouped_bits(together: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """The 64 bits (0 is the highest) in ``parts`` partitions of about equal size, each of bits that go together."""
    mean = np.diag(together) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    alike = np.abs((together / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(alike, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        own = [max(left, key=lambda b: (alike[b, sorted(left)].sum(), -b))]
        while len(own) < size:
            rest = sorted(left - set(own))
            own.append(rest[int(np.argmax(alike[np.ix_(own, rest)].sum(0)))])
        left -= set(own)
        out.append(sorted(own))
    return out


def allotted(groups: list[list[int]], differ: np.ndarray, n: float, distance: int) -> tuple[float, list[int]]:
    """The least estimated cost, and the threshold of every partition (-1: not probed)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        chance = reduce(np.convolve, [np.array([1 - differ[b], differ[b]]) for b in bits])
        costs = [0.0]
        for t in range(min(distance, len(bits) - 1) + 1):
            probes = sum(comb(len(bits), k) for k in range(t + 1))
            costs.append(n * (probes + 1) + 0.05 * n * n / 2 * chance[: t + 1].sum())
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for share, more in enumerate(costs):  # share = threshold + 1
                if used + share <= distance + 1 and (used + share not in new or cost + more < new[used + share][0]):
                    new[used + share] = (cost + more, [*chosen, share - 1])
        best = new
    return best[distance + 1] if distance + 1 in best else (float("inf"), [])


def plan_search(nodes: DataFrame, distance: int = DISTANCE) -> list[tuple[int, list[int]]]:
    """(mask, values to flip) of each probed partition, from the bit counts of all fingerprints."""
    table = matrix(summed_rows(nodes.select("fp").mapInArrow(_bit_table, number_schema("bit", BITS + 1)), "bit", BITS + 1), "bit", BITS, BITS + 1)
    together, n = table[:, :BITS], max(table[0, BITS], 1.0)
    mean = np.diag(together) / n
    differ = np.clip(2 * mean * (1 - mean), 1e-6, 1)
    plans = []
    for parts in range(1, distance + 2):
        groups = grouped_bits(together, n, parts)
        cost, thresholds = allotted(groups, differ, n, distance)
        probes = max((comb(len(g), t) for g, t in zip(groups, thresholds)), default=0)
        if probes <= 1 << 12:  # the values to flip are part of the plan
            plans.append((cost, groups, thresholds))
    _, groups, thresholds = min(plans, key=lambda x: x[0])
    out = []
    for bits, t in zip(groups, thresholds):
        if t >= 0:
            values = [1 << (BITS - 1 - b) for b in bits]
            flips = [_signed(sum(c)) for k in range(t + 1) for c in combinations(values, k)]
            out.append((_signed(sum(values)), t, flips))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: the pairs of different fingerprints with at most ``distance`` differing bits, each once."""
    plan = plan_search(nodes, distance)
    probes, values = [], []
    for k, (mask, _, flips) in enumerate(plan):
        own = F.col("fp").bitwiseAND(F.lit(mask))
        probes.append(nodes.select(F.col("fp").alias("a"), F.lit(k).alias("part"), F.explode(F.array(*[own.bitwiseXOR(F.lit(f)) for f in flips]) if len(flips) < 40 else F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: own.bitwiseXOR(f))).alias("value")))
        values.append(nodes.select(F.col("fp").alias("b"), F.lit(k).alias("part"), own.alias("value")))
    left, right = reduce(DataFrame.unionAll, probes).alias("l"), reduce(DataFrame.unionAll, values).alias("r")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    met = (F.col("l.part") == F.col("r.part")) & (F.col("l.value") == F.col("r.value")) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance)
    for k, (mask, t, _) in enumerate(plan[:-1]):
        # A pair that an earlier partition finds is left to it.
        met &= (F.col("l.part") <= k) | (F.bit_count(differ.bitwiseAND(F.lit(mask))) > t)
    return left.join(right, met).select("a", "b")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches; nodes without an edge are absent."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least)
        edges = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)


def near_classes(docs: DataFrame, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and of every fingerprint (fp, first, root): its least id and its class."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, distance))
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return rows, written(classes, "classes")


def component_ids(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    rows, classes = near_classes(docs, distance)
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = written(classes.join(least, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One document of each class, that with the least id, with the columns it came with.

    Rows with a null id come last; of rows that agree in id and fingerprint one stays.
    """
    _, classes = near_classes(docs, distance)
    order = F.struct(F.col("first").isNull(), F.col("first").alias("first"), F.col("fp").alias("fp"))
    kept = written(classes.groupBy("root").agg(F.min(order).alias("k")).select("k.first", F.col("k.fp").alias("own")), "kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("fp"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    def with_fingerprint(batches):
        for batch in batches:
            for part in pieces(batch, "row.text"):
                found = np.array([fingerprint(t) for t in raw(of(part, "row.text"))], np.uint64).view(np.int64)
                yield part.set_column(1, part.schema.field(1), pa.array(found))

    rows = rows.mapInArrow(with_fingerprint, rows.schema)
    # Ids spread the rows of a group of copies over the tasks.
    here = rows.join(kept, (rows["fp"] == kept["own"]) & rows["id"].eqNullSafe(kept["first"]), "left_semi")
    return here.dropDuplicates(["id", "fp"]).select("row.*")


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return component_ids(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
