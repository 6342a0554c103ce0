"""Fill-in-middle transformation over seekable compressed frames.

``store`` turns every text into independent zstandard frames of ``FRAME_BYTES`` bytes, each with the number of units
(a word with the blanks before it; trailing blanks are one more) and of code points that end by its end.  The counts are
cumulative, so a cut after unit k lies in the first frame whose count reaches k.  The store is written once to the shared
folder and can be cut again with any seed.

``cut`` finds the places where prefix and middle end.  Only the one or two frames that hold a cut are decompressed; all
others go from the store to the output as they are, since frames are independent and a file of frames is read one after
the other.  The output is a list of frames again: prefix, middle and suffix in the order of the form, each behind its
marker.  ``output_text`` puts it together, ``digests`` streams it: one frame is open at a time, both for the output and
for the text that is restored from it by finding the markers.

Nothing is shuffled, and a task holds about ``PIECE_BYTES`` of text, or one longer document with its compressed output.

Null and empty texts have no units, are ``plain`` and stay empty.  A text that holds a marker is ``plain``.  Repeated rows
are cut each by itself, rows of one id at the same units.  A null id is cut like an id with no digits.  All columns but
the text stay in ``row``, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlake.llm.common import offsets, pieces, raw, written

FRAME_BYTES = 32 << 10
#: Of a hundred texts: how many are transformed, and how many of those put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The markers of a form, in order, each with the segment behind it (0 prefix, 1 middle, 2 suffix).
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

FRAMES = "array<struct<units:bigint,chars:bigint,data:binary>>"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _codec():
    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def _inner_ends(data: np.ndarray) -> np.ndarray:
    """Where units end inside the data: before a blank that follows something else."""
    blank = _BLANK[data]
    return np.flatnonzero(~blank[:-1] & blank[1:]) + 1


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _framed(text: bytes, compress, frame_bytes: int) -> list[tuple[int, int, bytes]]:
    """(units, code points, frame) of each frame; both counts are those up to its end."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    ends = np.append(_inner_ends(data), len(text))
    out, chars = [], 0
    for a in range(0, len(text), frame_bytes):
        own = data[a:a + frame_bytes]
        chars += _chars(own)
        out.append((int(np.searchsorted(ends, a + len(own), "right")), chars, compress(own)))
    return out


def _frames_column(lists: list[list[tuple]]) -> pa.Array:
    flat = [x for own in lists for x in own]
    columns = [pa.array([x[k] for x in flat], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
    struct = pa.StructArray.from_arrays(columns, ["units", "chars", "data"])
    return pa.ListArray.from_arrays(offsets([len(own) for own in lists]).astype(np.int32), struct)


def store(docs: DataFrame, text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The columns of ``docs`` but the text as ``row``; ``n`` units, whether a marker is in the text, and its frames."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), docs[text].alias("text"))
    kind = rows.select("row").schema["row"].dataType.simpleString()

    def framed(batches):
        compress, _ = _codec()
        for batch in batches:
            for part in pieces(batch):
                texts = raw(part.column("text"))
                own = [_framed(x, compress, frame_bytes) for x in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), pa.array([x[-1][0] if x else 0 for x in own], pa.int64()),
                    pa.array([any(m in x for m in (PREFIX, SUFFIX, MIDDLE)) for x in texts]), _frames_column(own),
                ], ["row", "n", "marked", "frames"])

    return rows.mapInArrow(framed, f"row {kind}, n bigint, marked boolean, frames {FRAMES}")


def _plan(stored: DataFrame, key: Column, seed: int, rate: int, suffix_first: int) -> DataFrame:
    """The form of every text and the units after which prefix and middle end, from the hash of its id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("name", 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    places = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    form = F.when((F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    return stored.withColumn("name", name).select(
        "row", "n", form.alias("form"), F.least(*places).alias("first"), F.greatest(*places).alias("second"), "frames")


class _Cuts:
    """One stored text: where a unit ends, and any stretch of it as frames."""

    def __init__(self, units, chars, frames, compress, decompress):
        self.units, self.chars, self.frames = units, chars, frames
        self.compress, self.decompress, self.opened = compress, decompress, {}

    def open(self, j: int) -> bytes:
        if j not in self.opened:
            self.opened[j] = self.decompress(self.frames[j])
        return self.opened[j]

    def after(self, k: int) -> tuple[int, int, int]:
        """(frame, byte within, code points before) of the place after unit k."""
        if k == 0:
            return 0, 0, 0
        j = int(np.searchsorted(self.units, k))
        before = (int(self.units[j - 1]), int(self.chars[j - 1])) if j else (0, 0)
        data = np.frombuffer(self.open(j), np.uint8)
        ends = _inner_ends(data)
        # The last unit that ends in a frame and not inside it ends with it.
        at = int(ends[k - before[0] - 1]) if k - before[0] <= len(ends) else len(data)
        return j, at, before[1] + _chars(data[:at])

    def stretch(self, a: tuple, b: tuple) -> list[bytes]:
        if a[0] == b[0]:
            parts = [self.open(a[0])[a[1]:b[1]]]
            return [self.compress(x) for x in parts if x]
        head, tail = self.open(a[0])[a[1]:] if a[1] else None, self.open(b[0])[:b[1]] if b[1] else b""
        out = [self.frames[a[0]]] if head is None else [self.compress(head)] if head else []
        return out + list(self.frames[a[0] + 1:b[0]]) + ([self.compress(tail)] if tail else [])


def cut(stored: DataFrame, key: Column, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``row``, ``n``, ``form``, code points of prefix and middle (null if plain), and the output as frames."""
    planned = _plan(stored, key, seed, rate, suffix_first)
    kind = planned.schema["row"].dataType.simpleString()

    def made(batches):
        compress, decompress = _codec()
        markers = {m: compress(m) for m in (PREFIX, SUFFIX, MIDDLE)}
        for batch in batches:
            forms, firsts, seconds = (batch.column(c).to_pylist() for c in ("form", "first", "second"))
            lists = batch.column("frames")
            at = np.asarray(lists.offsets)
            units, chars = (lists.values.field(c).to_numpy() for c in ("units", "chars"))
            data = lists.values.field("data")
            prefix, middle, output = [], [], []
            for i, form in enumerate(forms):
                a, b = at[i], at[i + 1]
                frames = data[a:b].to_pylist()
                if form == "plain":
                    prefix.append(None)
                    middle.append(None)
                    output.append(frames)
                    continue
                text = _Cuts(units[a:b], chars[a:b], frames, compress, decompress)
                start, stop, end = text.after(firsts[i]), text.after(seconds[i]), (len(frames), 0)
                segments = [text.stretch((0, 0), start), text.stretch(start, stop), text.stretch(stop, end)]
                prefix.append(start[2])
                middle.append(stop[2] - start[2])
                output.append([x for marker, k in FORMS[form] for x in (markers[marker], *segments[k])])
            flat = pa.array([x for own in output for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("n"), batch.column("form"), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.ListArray.from_arrays(offsets([len(x) for x in output]).astype(np.int32), flat),
            ], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    shape = f"row {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>"
    return planned.mapInArrow(made, shape)


def restored(frames: list[bytes], form: str, decompress) -> Iterator[bytes]:
    """The original text, in chunks, from the output and its form alone; one frame is open at a time."""
    if form == "plain":
        yield from map(decompress, frames)
        return
    marks, found, done, tail = FORMS[form], [], 0, b""
    for frame in frames:
        data = tail + decompress(frame)
        at = 0
        while len(found) < len(marks) and (hit := data.find(marks[len(found)][0], at)) >= 0:
            at = hit + len(marks[len(found)][0])
            found.append((done + hit, done + at))
        # A marker may begin in one frame and end in the next one.
        keep = min(2, len(data) - at)
        done, tail = done + len(data) - keep, data[len(data) - keep:]
    stops = [a for a, _ in found[1:]] + [done + len(tail)]
    segments = sorted((k, start, stop) for (_, k), (_, start), stop in zip(marks, found, stops))
    for _, start, stop in segments:
        begin = 0
        for frame in frames:
            size = zstandard.frame_content_size(frame)
            if begin < stop and begin + size > start:
                yield decompress(frame)[max(0, start - begin):stop - begin]
            begin += size


def _sha(chunks: Iterable[bytes]) -> str:
    out = hashlib.sha256()
    for chunk in chunks:
        out.update(chunk)
    return out.hexdigest()


def digests(made: DataFrame) -> DataFrame:
    """``made`` with the sha256 of the output and of the text restored from it, in place of the output."""
    kept = [c for c in made.columns if c != "output"]
    shape = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in kept)

    def digested(batches):
        _, decompress = _codec()
        for batch in batches:
            forms, output = batch.column("form").to_pylist(), batch.column("output")
            shas = ([], [])
            for i, form in enumerate(forms):
                frames = output[i].as_py()
                shas[0].append(_sha(map(decompress, frames)))
                shas[1].append(_sha(restored(frames, form, decompress)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(x, pa.string()) for x in shas],
                [*kept, "output_sha256", "restored_sha256"])

    return made.mapInArrow(digested, f"{shape}, output_sha256 string, restored_sha256 string")


def output_text(frames: Column) -> Column:
    """The text of a list of frames."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        _, decompress = _codec()
        return pa.array([b"".join(map(decompress, x.as_py() or ())).decode(errors="replace") for x in lists], pa.string())

    return texts(frames)


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Stores the texts of ``docs`` and cuts them; ``key`` is the column the cuts hang on."""
    stored = written(store(docs, text, frame_bytes), "frames")
    return cut(stored, F.col("row")[key], seed)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = digests(fill_in_middle(docs))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS name
  FROM documents
), hashed AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(name, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(name, 9, 8) AS UBIGINT) AS h2,
         CAST('0x' || substr(name, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(name, 25, 8) AS UBIGINT) AS h4
  FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:n], '') AS suffix
  FROM formed
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM parts
), back AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(substr(output, 4), '<S>', 1) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1) END AS again
  FROM made
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256, sha256(again) AS restored_sha256
FROM back
"""
