"""Quality rules: suffix-array repetition inside each document.

The words of a shard (a bounded slice of a task's documents) are laid end to end.  Starts of five-word windows are
sorted by window, and only windows that occur twice or more in their document go on, which is everything a repeat
can begin with.  Their suffixes are sorted by prefix doubling; neighbours in that suffix array give the longest
common prefixes.  A suffix's longest repeat is the larger prefix it shares with a neighbour; the intervals of equal
prefixes are the maximal repeated substrings, and the union of all their occurrences is the covered part.

A document fails the base rules with under ``MIN_WORDS`` words or over ``MAX_REPEAT_PERCENT`` percent of words in
repeated windows, and the method's rule if repeats of at least ``LONG_REPEAT`` words cover over ``MAX_COVERED`` of
its words or one repeat is over ``MAX_LONGEST`` words.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text has no words, like an empty one, and fails; overlapping occurrences
count; repeated rows are judged one by one.  No table is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import of, offsets, pieces, raw, with_row

GRAM = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LONG_REPEAT = 10
MAX_COVERED = 0.2
MAX_LONGEST = 50

MEASURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_covered:bigint,longest_repeat:bigint,repeats:array<struct<start:bigint,n_words:bigint>>,"
    "base_failed:boolean,kept:boolean>"
)

_SPACE = np.zeros(256, np.int64)
_SPACE[[0x20, *range(0x09, 0x0E)]] = 1
_WIDE = np.ones(256, np.int64)  # one for each byte that begins a character
_WIDE[0x80:0xC0] = 0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = offsets(flags)
    return run[at[1:]] - run[at[:-1]]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


# Hashes are polynomials over two prime fields: over the integers modulo 2^64 there are texts (Thue and Morse) that agree in
# every base without being equal.
_FIELDS = ((2147483647, 1103515245), (2147483629, 1664525947))


def _powers(n: int, base: int, prime: int) -> np.ndarray:
    """base^0 ... base^n, by doubling."""
    out, size, step = np.ones(n + 1, np.uint64), 1, base
    while size <= n:
        m = min(size, n + 1 - size)
        out[size:size + m] = out[:m] * np.uint64(step) % np.uint64(prime)
        size, step = size * 2, step * step % prime
    return out


class Prefixes:
    """Rolling hashes of a shard's words."""

    def __init__(self, codes: np.ndarray):
        self.fields = []
        for prime, base in _FIELDS:
            p, power = np.uint64(prime), _powers(len(codes), base, prime)
            prefix = np.zeros(len(codes) + 1, np.uint64)
            prefix[1:] = np.cumsum(codes % p * power[:-1] % p) % p
            self.fields.append((p, power, prefix))

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words from ``a`` are those from ``b`` (a < b)."""
        out = np.ones(len(a), bool)
        for p, power, prefix in self.fields:
            out &= (prefix[a + n] + p - prefix[a]) % p * power[b - a] % p == (prefix[b + n] + p - prefix[b]) % p
        return out

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` share, at most ``most``: by bisection."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.same(a, b, mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low


def _repeats(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the shard, the longest repeat that begins there (0: none), and which words are in repeated windows."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = starts[1:][text] if n else text
    windows = np.flatnonzero(np.arange(n) + GRAM <= ends)
    if not len(windows):
        return longest, np.zeros(n, bool)
    mixed = (text[windows].astype(np.uint64) + np.uint64(1)) * _BASE
    for k in range(GRAM):
        mixed = (mixed ^ codes[windows + k]) * _BASE
        mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    at, mixed = windows[order], mixed[order]
    same = mixed[1:] == mixed[:-1]
    if not same.any():
        return longest, np.zeros(n, bool)
    group = np.concatenate([[0], np.cumsum(~same)])
    size = np.bincount(group)
    twice = size[group] > 1
    at, group = at[twice], np.unique(group[twice], return_inverse=True)[1]
    # Prefix doubling: ``rank`` orders the suffixes by their first ``width`` words.
    rank = np.zeros(n + 1, np.int64)
    rank[at] = group + 1
    width, longest_text = GRAM, int(np.diff(starts).max())
    while width < longest_text:
        after = at + width
        following = np.where(after < ends[at], rank[np.minimum(after, n)], 0)
        # The words themselves come before the rank of the window they begin, so that suffixes that share only some
        # of them stand together; of windows without a rank no two are equal.
        keys = [following]
        for k in reversed(range(GRAM - 1)):
            keys.append(np.where(after + k < ends[at], codes[np.minimum(after + k, n - 1)], 0))
        keys.append(rank[at])
        order = np.lexsort(keys)
        at, keys = at[order], [k[order] for k in keys]
        new = np.zeros(len(at), bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        rank[at] = np.cumsum(new)
        if new.all():
            break
        width *= 2
    # Neighbours in the suffix array that share a window at all, and by how much.
    first, second = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
    inside = text[first] == text[second]
    first, second = first[inside], second[inside]
    common = Prefixes(codes).shared(first, second, ends[second] - second)
    np.maximum.at(longest, first, common)
    np.maximum.at(longest, second, common)
    grams = np.flatnonzero(longest >= GRAM)
    return longest, _covered(grams, np.full(len(grams), GRAM), n)


def _measure(texts: list[bytes]) -> list[dict]:
    split = [t.split() for t in texts]
    counts = np.array([len(x) for x in split], np.int64)
    starts = offsets(counts)
    codes = np.fromiter((hash(w) for x in split for w in x), np.int64, int(starts[-1])).view(np.uint64)
    longest, repeated = _repeats(codes, starts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = offsets([len(t) for t in texts])
    chars = _per_text((_WIDE - _SPACE)[data], at)
    symbols = _per_text(_SYMBOL[data], at)
    n_repeat = _per_text(repeated, starts)
    long_ = np.flatnonzero(longest >= LONG_REPEAT)
    covered = _covered(long_, longest[long_], len(codes))
    n_covered = _per_text(covered, starts)
    out = []
    for i, text in enumerate(texts):
        own = slice(starts[i], starts[i + 1])
        n, most = int(counts[i]), int(longest[own].max(initial=0))
        base = n < MIN_WORDS or 100 * int(n_repeat[i]) > MAX_REPEAT_PERCENT * n
        step = np.flatnonzero(np.diff(np.concatenate([[0], covered[own].view(np.int8), [0]]))) if n_covered[i] else np.zeros(0, int)
        out.append({
            "n_words": n, "word_chars": int(chars[i]), "n_symbols": int(symbols[i]), "n_dup_lines": _dup_lines(text),
            "n_repeat_words": int(n_repeat[i]), "n_covered": int(n_covered[i]), "longest_repeat": most,
            "repeats": [{"start": a, "n_words": b - a} for a, b in zip(step[::2].tolist(), step[1::2].tolist())],
            "base_failed": base,
            "kept": not base and int(n_covered[i]) <= MAX_COVERED * n and most <= MAX_LONGEST,
        })
    return out


def _measured(batches):
    for batch in batches:
        for part in pieces(batch, "row.text"):
            kind = part.schema.field("found").type
            found = pa.array(_measure(raw(of(part, "row.text"))), kind)
            yield part.set_column(part.schema.get_field_index("found"), part.schema.field("found"), found)


def measure_repetition(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (which has ``text``) as ``row``, with the measures and the verdict in ``found``."""
    out = with_row(docs).withColumn("found", F.lit(None).cast(MEASURES))
    return out.mapInArrow(_measured, out.schema).select("row", "found")


def keep_unrepetitive(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return measure_repetition(docs).where("found.kept").select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure_repetition(docs).select("row.doc_id", "found.*").drop("repeats")
