"""Suffix-array dedup: run-length BWT indexes over content-dealt shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller id, or earlier
in the same document.  Texts are never compared across document borders.

**Dealing by content.** Every window of ``LENGTH`` bytes picks one of its ``GRAM``-byte strings, that of least hash,
as its anchor; equal windows pick equal anchors, so whatever can match meets where its anchor is dealt to.  Neighbouring
windows mostly pick the same anchor: they form one *stretch*, and only (anchor, hash of the stretch, place) is shuffled,
about one row for 40 bytes.  Equal stretches are settled there: all but the first one go.  A task drops repeats inside
its own slices before the shuffle, so a passage that a third of all documents have is a row per slice, not per document.

**Indexes.** Stretches that differ but share their anchor may still share windows.  Their bytes are fetched, and all
stretches of an anchor are put, with others, into a shard of bounded size.  Over a shard a suffix array is sorted and its
Burrows-Wheeler transform run-length encoded; the longest common prefixes are compared only at the sampled run ends, as
inside a run the prefix of a suffix is one byte longer than that of the suffix after it.  Streaming along the text, a
running maximum then gives every position's matching statistic, and runs of the suffix array with matches of ``LENGTH``
bytes are the windows that occur again; all but the first of them go.

**Crowded anchors.** Beyond ``CROWD`` different stretches an anchor (say of a line on every page) would outgrow a shard.
Its windows are dealt one by one instead, by 128 bits of hash, and the same first-of-equals rule settles them.

Stretches and windows are compared by 128 bits of hash.  A null text is an empty one.  Rows with a null id come last
(an id of 2**63 - 1 counts as null).
Rows that share their id but not their text are told apart by a hash of the text, which also orders them; rows equal
in both are one document, and each of them gets its result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import pieces, raw, written

LENGTH = 100
GRAM = 24
CROWD = 4096
#: Bytes of stretches in one index.
SHARD_BYTES = 2 << 20
#: A longer text is cut into segments that overlap by a window; stretches end at their borders.
SEGMENT = 4 << 20
#: Of a position: the low bits are the place in the text, the others tell rows of one id apart.
PLACE_BITS = 40

#: Stands for a null id while documents are compared; it sorts last.
NO_ID = 2**63 - 1

GONE, COMPARE, CROWDED = 0, 1, 2
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ROW = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
_OUT = pa.schema([("what", pa.int32()), ("k", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])


def _grams(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data),), (1,))
    m = len(data) - GRAM + 1
    h = (word[:m] * _A) ^ (word[8:8 + m] * _B)
    h ^= h >> np.uint64(29)
    h = (h ^ word[16:16 + m]) * _C
    h ^= h >> np.uint64(32)
    h *= _A
    return h ^ (h >> np.uint64(29))


def stretches(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, start, stop) of every run of windows that pick the same anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    width, h = length - GRAM + 1, _grams(data)
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if done < width:
        key = np.minimum(key[: len(key) - (width - done)], key[width - done:])
    anchor = (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    stop = np.concatenate([first[1:], [len(anchor)]]) - 1 + length
    return h[anchor[first]], first, stop


def _places(ids: np.ndarray, texts: list[bytes]) -> tuple[list[int], list[int]]:
    return ids.tolist(), [(xxhash.xxh3_64_intdigest(t) & 0x7FFFFF) << PLACE_BITS for t in texts]


def _first_of_equals(k, h, id_, at, n) -> tuple[pa.RecordBatch, np.ndarray]:
    """Of a task's rows, the first of those equal in (k, h); the others, keyed by their own place, to pass through."""
    order = np.lexsort((at, id_, h, k))
    k, h, id_, at, n = (x[order] for x in (k, h, id_, at, n))
    again = np.concatenate([[False], (k[1:] == k[:-1]) & (h[1:] == h[:-1])]) if len(k) else np.zeros(0, bool)
    # A row that is known to go has n < 0 and any key.
    k, h = np.where(again, id_ * 31 + at, k), np.where(again, 0, h)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, h, id_, at, np.where(again, -n, n).astype(np.int32))], schema=_ROW)


def _stretch_rows(batches):
    for batch in batches:
        for part in pieces(batch):
            texts = raw(part.column("text"))
            ids, marks = _places(part.column("id").to_numpy(zero_copy_only=False), texts)
            found = []
            for doc, mark, text in zip(ids, marks, texts):
                for base in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
                    piece = text[base:base + SEGMENT + LENGTH - 1]
                    k, start, stop = stretches(piece)
                    if len(k):
                        h = np.fromiter((xxhash.xxh3_64_intdigest(piece[a:b]) for a, b in zip(start.tolist(), stop.tolist())), np.uint64, len(k))
                        found.append((k.view(np.int64), h.view(np.int64), np.full(len(k), doc), start + (mark + base), stop - start))
            if found:
                yield _first_of_equals(*(np.concatenate(x) for x in zip(*found)))


def _settled(batches):
    """Rows sorted by (k, h, id, at): all but the first of equals go; anchors with several stretches are to be compared."""
    held: list[tuple] = []  # the first rows of the stretches of the current anchor, CROWD at most
    key = last = None
    crowded = False

    def flush(out):
        if len(held) > 1 and not crowded:
            out += [(COMPARE, *r) for r in held]
        held.clear()

    for batch in batches:
        k, h, id_, at, n = (np.asarray(batch.column(c)) for c in ("k", "h", "id", "at", "n"))
        gone = n < 0
        out: list[tuple] = []
        live = np.flatnonzero(~gone)
        arrays = [[np.full(int(gone.sum()), GONE), k[gone], id_[gone], at[gone], -n[gone]]]
        if len(live):
            k, h, id_, at, n = (x[live] for x in (k, h, id_, at, n))
            new_key = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            new = new_key | np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
            again = ~new
            arrays.append([np.full(int(again.sum()), GONE), k[again], id_[again], at[again], n[again]])
            # Anchors that begin and end inside this batch with one stretch need nothing more.
            at_new = np.flatnonzero(new)
            starts = np.flatnonzero(new_key[at_new])
            alone = np.zeros(len(at_new), bool)
            if len(starts):
                sizes = np.diff(np.concatenate([starts, [len(at_new)]]))
                alone[starts[:-1][sizes[:-1] == 1]] = True
            for i, single in zip(at_new.tolist(), alone.tolist()):
                if new_key[i]:
                    flush(out)
                    crowded = False
                if single:
                    continue
                row = (int(k[i]), int(id_[i]), int(at[i]), int(n[i]))
                if crowded:
                    out.append((CROWDED, *row))
                elif len(held) == CROWD:
                    crowded = True
                    out += [(CROWDED, *r) for r in held] + [(CROWDED, *row)]
                    held.clear()
                else:
                    held.append(row)
            key, last = k[-1], h[-1]
        if out:
            arrays.append([np.array(x) for x in zip(*out)])
        what, k, id_, at, n = (np.concatenate(x) for x in zip(*arrays))
        yield pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(k), pa.array(id_), pa.array(at), pa.array(n.astype(np.int32))], schema=_OUT)
    out = []
    flush(out)
    if out:
        what, k, id_, at, n = (np.array(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(what.astype(np.int32)), pa.array(k), pa.array(id_), pa.array(at), pa.array(n.astype(np.int32))], schema=_OUT)


class RunIndex:
    """The run-length encoded BWT of several texts, with the suffix array sampled at its run ends."""

    def __init__(self, texts: list[bytes]):
        self.text = b"".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        n = len(self.text)
        self.begin = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(texts)), size)
        self.left = np.repeat(self.begin + size, size) - np.arange(n)  # bytes to the text's end
        padded = np.frombuffer(self.text + b"\0" * 16, np.uint8)
        self.word = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (n + 8,), (1,))
        self.array = self._sorted(n)
        before = padded[self.array - 1]
        starts = np.zeros(n, bool)
        starts[self.begin[size > 0]] = True
        starts = starts[self.array]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | starts[1:] | starts[:-1]
        self.heads = np.flatnonzero(head)  # where runs begin; the ends are one before the next
        self.runs = before[self.heads]

    def _sorted(self, n: int) -> np.ndarray:
        """Suffixes by prefix doubling; a text's end sorts first, and equal texts to their ends by place."""
        width, place = 7, np.arange(n)
        key = self.word[:n].byteswap() >> np.uint64(8)
        key &= np.array([(1 << 56) - (1 << (8 * (7 - min(k, 7)))) for k in range(8)], np.uint64)[np.minimum(self.left, 7)]
        key = (key << np.uint64(8)) | np.minimum(self.left, 7).astype(np.uint64)
        longest = int(self.left.max(initial=0))
        while True:
            order = np.argsort(key)
            sorted_ = key[order]
            new = np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]) if n else np.zeros(0, np.int64)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if width >= longest or new.all():
                return np.argsort(rank * n + place) if not new.all() else order
            after = np.where(self.left > width, rank[np.minimum(place + width, n - 1)], 0)
            key = rank * (n + 1) + after
            width *= 2

    def statistics(self) -> np.ndarray:
        """For each position, how far it agrees with the suffix before it in order.

        Compared only where runs begin; elsewhere the running maximum along the text has it.
        """
        here, there = self.array[self.heads], self.array[np.maximum(self.heads - 1, 0)]
        limit = np.minimum(self.left[here], self.left[there])
        limit[self.heads == 0] = 0
        common = np.zeros(len(here), np.int64)
        open_ = np.flatnonzero(limit > 0)
        while len(open_):
            x = self.word[here[open_] + common[open_]] ^ self.word[there[open_] + common[open_]]
            low = x & (~x + np.uint64(1))
            step = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            common[open_] += step
            open_ = open_[(step == 8) & (common[open_] < limit[open_])]
        reach = np.full(len(self.text), -1, np.int64)
        reach[here] = here + np.minimum(common, limit)
        return np.maximum.accumulate(reach) - np.arange(len(self.text))

    def later_occurrences(self, length: int) -> np.ndarray:
        """Positions from which ``length`` bytes (inside one text) also start at an earlier position."""
        if not len(self.text):
            return np.zeros(0, np.int64)
        same = self.statistics()[self.array] >= length
        first = np.minimum.reduceat(self.array, np.flatnonzero(~same))
        return np.sort(self.array[self.array != first[np.cumsum(~same) - 1]])


def _runs(starts: np.ndarray, tied: np.ndarray, length: int):
    """Consecutive positions of one owner as (first, covered length)."""
    cut = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (tied[1:] != tied[:-1])]))
    last = np.concatenate([cut[1:], [len(starts)]]) - 1
    return cut, starts[cut], starts[last] - starts[cut] + length


def _indexed(batches):
    """Stretches sorted by (k, id, at), all of an anchor in one shard: the windows that occur earlier."""
    rows: list[tuple] = []
    size = 0

    def index():
        found = RunIndex([r[3] for r in rows])
        later = found.later_occurrences(LENGTH)
        if not len(later):
            return None
        owner = found.owner[later]
        cut, start, n = _runs(later, owner, LENGTH)
        own = owner[cut]
        ids, ats = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ats[own] + start - found.begin[own]), pa.array(n.astype(np.int32))], ["id", "at", "n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("k", "id", "at", "part"))):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                if (out := index()) is not None:
                    yield out
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows and (out := index()) is not None:
        yield out


def _window_rows(batches):
    """The windows of crowded stretches as rows of their own, by 128 bits of hash."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            found: list[tuple] = []
            for doc, at, part in zip(*(batch.slice(a, 4096).column(c).to_pylist() for c in ("id", "at", "part"))):
                for i in range(len(part) - LENGTH + 1):
                    d = xxhash.xxh3_128_intdigest(part[i:i + LENGTH])
                    found.append((d >> 64, d & (2**64 - 1), doc, at + i))
            if found:
                k, h = (np.array([r[j] for r in found], np.uint64).view(np.int64) for j in (0, 1))
                id_, at = (np.array([r[j] for r in found], np.int64) for j in (2, 3))
                yield _first_of_equals(k, h, id_, at, np.full(len(k), LENGTH))


def _fetched(batches):
    """The bytes of each wanted stretch of a document."""
    for batch in batches:
        for part in pieces(batch):
            out = []
            for doc, text, wanted in zip(part.column("id").to_pylist(), raw(part.column("text")), part.column("wanted").to_pylist()):
                mark = _places(np.array([doc]), [text])[1][0]
                for w in wanted:
                    place = w["at"] - mark
                    if 0 <= place < 1 << PLACE_BITS:
                        out.append((w["k"], doc, w["at"], text[place:place + w["n"]]))
            for a in range(0, len(out), 50_000):
                k, id_, at, data = zip(*out[a:a + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(id_, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["k", "id", "at", "part"])


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for part in pieces(batch):
            out = []
            for doc, text, gone in zip(part.column("id").to_pylist(), raw(part.column("text")), part.column("gone").to_pylist()):
                spans: list[list[int]] = []
                if gone:
                    mark = _places(np.array([doc]), [text])[1][0]
                    for a, b in sorted((g["at"] - mark, g["at"] - mark + g["n"]) for g in gone if 0 <= g["at"] - mark < 1 << PLACE_BITS):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out.append((None if doc == NO_ID else doc, len(text), b"".join(kept), [{"start": a, "stop": b} for a, b in spans]))
            ids, sizes, data, spans = zip(*out)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(data, pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in data])], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])


def _settle(rows: DataFrame) -> DataFrame:
    return rows.repartition("k").sortWithinPartitions("k", "h", "id", "at").mapInArrow(_settled, "what int, k long, id long, at long, n int")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its id, n_bytes, removed spans, and the bytes that are left."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    shape = "k long, h long, id long, at long, n int"
    first = written(_settle(texts.mapInArrow(_stretch_rows, shape)), "stretches")

    def fetched(what: int) -> DataFrame:
        wanted = first.where(F.col("what") == what).groupBy("id").agg(F.collect_list(F.struct("k", "at", "n")).alias("wanted"))
        return texts.join(wanted, "id").mapInArrow(_fetched, "k long, id long, at long, part binary")

    indexed = fetched(COMPARE).repartition("k").sortWithinPartitions("k", "id", "at").mapInArrow(_indexed, "id long, at long, n int")
    crowded = _settle(fetched(CROWDED).mapInArrow(_window_rows, shape)).where(F.col("what") == GONE).select("id", "at", "n")
    gone = first.where(F.col("what") == GONE).select("id", "at", "n").unionByName(indexed).unionByName(crowded)
    per_doc = gone.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    # The texts are dealt by id once; Spark reuses that shuffle for all three joins.
    joined = texts.join(per_doc, "id", "left")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return repeated_bytes(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
