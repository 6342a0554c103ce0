"""Benchmark decontamination by suffix arrays of the training documents.

Documents are cut into shards (bounded slices of a task's rows).  A shard's words are numbered by the benchmark's
vocabulary, and its suffixes that begin like some benchmark suffix are sorted: the shard's suffix array.  (A suffix
that begins otherwise matches no window, so leaving it out loses nothing.)  Every benchmark suffix that holds a whole
window is then searched in it by bisection, which gives the interval of all training suffixes that begin with the
window; matches are prolonged word by word to the longest verbatim match.

The benchmark is read in blocks of bounded bytes, each shipped to the tasks and searched in all documents in turn;
documents are never shuffled.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null and empty texts have no words and are
never hit; repeated documents are judged row by row; items that share an id count as one item; an item without
words has no window.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import of, offsets, pieces, raw, with_row

WINDOW = 10
#: Bytes of benchmark text searched in one pass over the documents.
BLOCK_BYTES = 8 << 20
#: A suffix is indexed if its first so many words begin a benchmark suffix.
HEAD = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)

_table = bytearray(b" " * 256)
for _c in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _table[_c] = _c
for _c in range(0x41, 0x5B):
    _table[_c] = _c + 32
_FOLD = bytes(_table)

MATCHES = "array<struct<item_id:bigint,item_start:int,doc_start:bigint,n_words:int>>"
FOUND = f"struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,item_ids:array<bigint>,matches:{MATCHES}>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Suffixes:
    """The windows of one block of items, as keys that sort like their words."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.items, starts = [], []
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            if ids:
                starts += [(len(self.items), j, min(window, len(ids))) for j in range(max(1, len(ids) - window + 1))]
                self.items.append((item_id, np.array(ids, np.int64)))
        self.starts = starts
        whole = np.zeros((len(starts), window), ">u4")
        above = np.full((len(starts), window), 0xFFFFFFFF, ">u4")
        heads: dict[int, list[np.ndarray]] = {}
        for row, (i, j, n) in enumerate(starts):
            ids = self.items[i][1][j:j + n] + 1
            whole[row, :n] = above[row, :n] = ids
            heads.setdefault(min(n, HEAD), []).append(ids[: min(n, HEAD)])
        self.low, self.high = self.keys(whole), self.keys(above)
        self.heads = {n: np.unique(self.mixed(np.array(rows).T)) for n, rows in heads.items()}

    def keys(self, columns: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(columns).view(f"S{4 * self.window}").ravel()

    @staticmethod
    def mixed(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = (out ^ np.asarray(c).astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
        return out


def _search(block: Suffixes, texts: list[bytes]):
    """Per text: its number of words, hit flags of all words, and (text, item, item start, start, words) of matches."""
    ids, counts = [], []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        ids.append(np.fromiter(map(block.number.get, found, repeat(-1)), np.int64, len(found)))
        ids.append(np.full(1, -1, np.int64))  # ends every match
    starts = offsets(np.array(counts, np.int64) + 1)
    # One more than the number; 0 is a word that no item has, or the end of a text.
    corpus = np.concatenate([*ids, np.full(block.window, -1, np.int64)]) + 1
    n = int(starts[-1])
    begins = np.zeros(n, bool)
    for head, known in block.heads.items():
        here = np.flatnonzero(corpus[:n])
        for k in range(1, head):
            here = here[corpus[here + k] > 0]
        mix = Suffixes.mixed([corpus[here + k] for k in range(head)])
        at = np.minimum(np.searchsorted(known, mix), len(known) - 1)
        begins[here[known[at] == mix]] = True
    places = np.flatnonzero(begins)
    edge = np.zeros(n + 1, np.int64)
    matches = []
    if len(places):
        keys = block.keys(corpus[places[:, None] + np.arange(block.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        array, keys = places[order], keys[order]
        low, high = np.searchsorted(keys, block.low), np.searchsorted(keys, block.high, "right")
        for row in np.flatnonzero(high > low):
            i, j, w = block.starts[row]
            item_id, item = block.items[i]
            found = array[low[row]:high[row]]
            np.add.at(edge, found, 1)
            np.add.at(edge, found + w, -1)
            # A match that also goes on to the left is part of the one reported from there.
            if j:
                found = found[(found == 0) | (corpus[found - 1] != item[j - 1] + 1)]
            length = np.full(len(found), w, np.int64)
            more = np.arange(len(found))
            while len(more) and j + length[more[0]] < len(item):
                step = length[more[0]]
                more = more[corpus[found[more] + step] == item[j + step] + 1]
                length[more] += 1
            text = np.searchsorted(starts, found, "right") - 1
            matches += [(int(t), item_id, j, int(p - starts[t]), int(m)) for t, p, m in zip(text, found, length)]
    hit = np.cumsum(edge[:n]) > 0
    return counts, starts, hit, matches


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    step = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(step[::2].tolist(), step[1::2].tolist()))


def _searcher(block: Suffixes):
    def search(batches):
        for batch in batches:
            for part in pieces(batch, "row.text"):
                before = part.column("found").to_pylist()
                counts, starts, hit, matches = _search(block, raw(of(part, "row.text")))
                per_text: dict[int, list] = {}
                for t, *match in matches:
                    per_text.setdefault(t, []).append(match)
                out = []
                for t, n in enumerate(counts):
                    old, own = before[t], per_text.get(t, [])
                    if not own:
                        out.append({**(old or {"spans": [], "item_ids": [], "matches": []}), "n_words": n})
                        continue
                    flags = hit[starts[t]:starts[t] + n].copy()
                    for x in old["spans"] if old else []:
                        flags[x["start"]:x["stop"]] = True
                    ids = {m[0] for m in own} | set(old["item_ids"] if old else [])
                    out.append({
                        "n_words": n,
                        "spans": [{"start": a, "stop": b} for a, b in _spans(flags)],
                        "item_ids": sorted(ids, key=lambda x: (x is None, x)),
                        "matches": (old["matches"] if old else []) + [
                            dict(zip(("item_id", "item_start", "doc_start", "n_words"), m)) for m in own],
                    })
                kind = part.schema.field("found").type
                yield part.set_column(part.schema.get_field_index("found"), part.schema.field("found"), pa.array(out, kind))

    return search


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of all its columns) with ``found``: words, hit spans, items, matches.

    ``docs`` needs ``text``, ``items`` needs ``item_id`` and ``text``.  Only benchmark text comes to the driver, a
    block of about ``block_bytes`` at a time.
    """
    items = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = with_row(docs).withColumn("found", F.lit(None).cast(FOUND))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        out = out.mapInArrow(_searcher(Suffixes([(r[0], bytes(r[1])) for r in rows], window)), out.schema)
    return out.select("row", "found")


def hit_words() -> F.Column:
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those in which a window of an item occurs, with the columns they came with."""
    return find_leaks(docs, items, window).where(F.size("found.spans") == 0).select("row.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = F.array_sort(F.transform("found.item_ids", lambda x: F.coalesce(x.cast("string"), F.lit("null"))))
    return find_leaks(docs, items).select(
        "row.doc_id", "found.n_words", hit_words().alias("n_hit"),
        F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (hit_words() > 0).alias("contaminated"),
    )
