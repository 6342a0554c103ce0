"""SentencePiece encoding and decoding over a relational lattice.

Spaces become ``\\u2581``, one is put in front, and the text is cut into units: marks of space, then letters, or then
anything else.  No piece of the table mixes letters with other characters, or has a mark inside, so no piece crosses
a border of units and the units can be encoded one by one (checked when the table is read).

A block is a stretch of one input partition of about ``BLOCK_BYTES`` of text, so neither copies nor a hot id fill one.
A block hands on each of its different units once.  By unit, these meet in one place: there the different units of the
whole corpus are exploded into substrings of at most the longest piece's length, equi-joined to the piece table,
grouped back to units, and a higher-order aggregate folds the edges, sorted by where they end, to the path of the highest
total score (ties: the longer last piece).  A character that no piece covers is an edge of its own and becomes its UTF-8
bytes.  The paths of a block's units go back to it, packed, and meet its documents there: rows travel as compressed
batches, and a task holds the units of one block and one batch of rows.
A unit is one row per block however often it occurs, and a block is of bounded size.  A unit of over ``UNIT`` characters
(text without any space or sign for pages, long rulers) would be a long list of edges to fold; it stays in its block, where the same
search runs over it once, position by position, in time that grows with its length only.  No unit is cut.

Input partitions are read twice, once for their units and once for their rows, and must hold the same rows in the same
order both times, as tables do; a block whose units and rows do not fit together is an error, never a wrong result.

The piece table is broadcast: it has at most ``MOST_PIECES`` rows, whatever the corpus.  Its vocabulary comes from a
SentencePiece model file; scores are the model's.

``decode`` gives the text back: ids to bytes, marks to spaces, the first space dropped.  Only a text that itself holds
``\\u2581`` comes back changed (as a space).  A null or empty text has no ids and decodes to the empty text.  Repeated
rows are encoded each by itself.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotlake.llm.common import of, offsets, pieces, with_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 16 << 20
UNIT = 4096
MOST_PIECES = 1 << 20
MARK = "▁"
UNITS = rf"{MARK}*+[\p{{L}}\p{{M}}]++|{MARK}*+[^\p{{L}}\p{{M}}{MARK}]++|{MARK}++"


@dataclass
class Vocabulary:
    """(piece, id, score) of the ordinary pieces, the id of every byte, and all pieces by id."""
    rows: list[tuple[str, int, float]]
    byte_ids: list[int]
    by_id: list[bytes]

    @property
    def unknown(self) -> float:
        return min((s for _, _, s in self.rows), default=0.0) - 10

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.rows), default=1)


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    if len(model) > MOST_PIECES:
        raise ValueError(f"{len(model)} pieces are too many to broadcast")
    rows, byte_ids, by_id = [], [-1] * 256, []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            by_id.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            by_id.append(b"")
        else:
            rows.append((piece, i, float(model.get_score(i))))
            by_id.append(piece.encode())
            body = piece.lstrip(MARK)
            if MARK in body or len({unicodedata.category(c)[0] in "LM" for c in body}) > 1:
                raise ValueError(f"piece {piece!r} would cross a border of units")
    if -1 in byte_ids:
        raise ValueError("the model has no piece for some bytes")
    return Vocabulary(rows, byte_ids, by_id)


def _constants(values) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",")


_UNITS = regex.compile(UNITS)


def units(text: str | None) -> list[str]:
    return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


def words_of(text: str) -> list[str]:
    """What stands between single spaces; further spaces before a word, or at the end, go with it as marks.

    The units of the words, one after the other, are those of the text.
    """
    own = text.replace(MARK, " ").split(" ")
    if "" not in own:
        return own
    out, marks = [], 0
    for word in own:
        if word:
            out.append(MARK * marks + word)
            marks = 0
        else:
            marks += 1
    if marks:
        out.append(MARK * (marks - 1))
    return out


def units_of(word: str) -> list[str]:
    """The units of a word of ``words_of``: most words are letters, with a sign at the end or without."""
    if word.isalpha():
        return [MARK + word]
    body, sign = word[:-1], word[-1:]
    if sign < "\x80" and body.isalpha() and not sign.isalpha():
        return [MARK + body, sign]
    return _UNITS.findall(MARK + word)


# An edge in one long: where it ends, where it starts, and the row of the score table.  Of those that end at one place
# the longest comes first.
_BELOW_END = (1 << 40) - 1


def _edge(end: Column, start: Column, row: Column) -> Column:
    return F.shiftleft(end.cast("long"), 40) + F.shiftleft(start.cast("long"), 24) + row.cast("long")


def _end(e: Column) -> Column:
    return F.shiftright(e, 40)


def _start(e: Column) -> Column:
    return F.shiftright(e, 24).bitwiseAND(F.lit(0xFFFF))


def _row(e: Column) -> Column:
    return e.bitwiseAND(F.lit(0xFFFFFF))


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``words`` (word; different ones) with the rows of the piece table on the best path; -1 - c for character c.

    Where ``words`` is dealt by word already, nothing is dealt anew.
    """
    spark = words.sparkSession
    table = spark.createDataFrame(
        [(p, k) for k, (p, _, _) in enumerate(vocabulary.rows)], "piece string, row int")
    scores = _constants([s for _, _, s in vocabulary.rows] + [vocabulary.unknown]).cast("array<double>")
    none = len(vocabulary.rows)
    size = F.length("word")
    # Words are numbered as they come: edges then arrive in the order they are grouped in, and nothing is left to sort.
    begun = words.select("word", F.monotonically_increasing_id().alias("at")).select("at", "word", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    cut = begun.select(
        "at", "word", "start",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), size - F.col("start") + 1))).alias("n"))
    cut = cut.withColumn("piece", F.substring("word", F.col("start"), F.col("n")))
    found = cut.join(F.broadcast(table), "piece", "left").where(F.col("row").isNotNull() | (F.col("n") == 1))
    edges = found.select("at", "word", _edge(F.col("start") + F.col("n") - 1, F.col("start") - 1, F.coalesce("row", F.lit(none))).alias("edge"))
    grouped = edges.groupBy("at", "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"))

    # Settled positions have their best score and last edge in the arrays; those of the current end, to which edges up to
    # ``until`` lead, are in ``best`` and ``edge``.  The first edge beyond settles them, and may itself start there: that score
    # is not in its array yet.  An edge no better than a longer one before it leaves the state as it is.
    def step(s: Column, e: Column) -> Column:
        before, own = F.get(s["score"], _start(e)), F.get(scores, _row(e))
        opened = F.struct(
            F.array_append(s["score"], s["best"]).alias("score"), F.array_append(s["back"], s["edge"]).alias("back"),
            e.bitwiseOR(F.lit(_BELOW_END)).alias("until"), (F.coalesce(before, s["best"]) + own).alias("best"), e.alias("edge"))
        better = F.struct(
            s["score"].alias("score"), s["back"].alias("back"), s["until"].alias("until"), (before + own).alias("best"), e.alias("edge"))
        return F.when(e > s["until"], opened).when(before + own > s["best"], better).otherwise(s)

    first = F.struct(
        F.array().cast("array<double>").alias("score"), F.array().cast("array<bigint>").alias("back"), F.lit(_BELOW_END).alias("until"),
        F.lit(0.0).alias("best"), F.lit(0).cast("bigint").alias("edge"))
    back = F.aggregate("edges", first, step, lambda s: F.array_append(s["back"], s["edge"]))
    folded = grouped.select("word", F.reverse(back).alias("back"))

    def walk(s: Column, e: Column) -> Column:
        here = (_end(e) == s["at"]) & (s["at"] > 0)
        return F.when(here, F.struct(_start(e).alias("at"), F.array_append(s["path"], e).alias("path"))).otherwise(s)

    last = F.struct(F.length("word").cast("long").alias("at"), F.array().cast("array<bigint>").alias("path"))
    path = F.reverse(F.aggregate("back", last, walk, lambda s: s["path"]))
    rows = F.transform(path, lambda e: F.when(
        _row(e) == none, -1 - F.ascii(F.substring("word", (_start(e) + 1).cast("int"), F.lit(1)))).otherwise(_row(e).cast("int")))
    return folded.select("word", rows.alias("rows"))


class Search:
    """The best path of one unit, in time that grows with its length: what ``lattice`` finds, for a long unit."""

    def __init__(self, vocabulary: Vocabulary):
        self.rows = {p: (s, k) for k, (p, _, s) in enumerate(vocabulary.rows)}
        self.unknown = vocabulary.unknown
        lengths: dict[str, set] = {}
        for p in self.rows:
            lengths.setdefault(p[0], {1}).add(len(p))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}

    def __call__(self, unit: str) -> list[int]:
        """The rows of the piece table on the path; -1 - c for character c."""
        size = len(unit)
        score, start, row = [0.0] + [-math.inf] * size, [0] * (size + 1), [0] * (size + 1)
        for i, c in enumerate(unit):
            for n in self.lengths.get(c, (1,)):
                if i + n > size:
                    break
                own, k = self.rows.get(unit[i:i + n], (None, 0))
                if own is None:
                    if n > 1:
                        continue
                    own, k = self.unknown, -1 - ord(c)
                # A start further to the left came first: of equal scores the longer last piece stays.
                if score[i] + own > score[i + n]:
                    score[i + n], start[i + n], row[i + n] = score[i] + own, i, k
        path, at = [], size
        while at:
            path.append(row[at])
            at = start[at]
        return path[::-1]


class _Blocks:
    """Numbers the blocks of the partitions: a row's block hangs on the bytes of text before it, not on Arrow's batches."""

    def __init__(self, rows: DataFrame, block_bytes: int):
        sizes = rows.groupBy("part").agg(F.sum(F.coalesce(F.octet_length("row.text"), F.lit(0))).alias("size")).collect()
        counts = {r.part: r.size // block_bytes + 1 for r in sizes}
        self.first, self.n, self.block_bytes = {}, 0, block_bytes
        for part in sorted(counts):
            self.first[part] = self.n
            self.n += counts[part]

    def cut(self, batches):
        """(block, rows): the batches in slices of one block each, and of bounded bytes."""
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first = self.first[batch.column("part")[0].as_py()]
            size = np.array(pa.compute.fill_null(pa.compute.binary_length(of(batch, "row.text").cast(pa.binary())), 0), np.int64)
            before = done + np.cumsum(size) - size
            done += int(size.sum())
            block = before // self.block_bytes
            for begin, stop in zip(starts := [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()], [*starts[1:], len(block)]):
                for part in pieces(batch.slice(begin, stop - begin), "row.text"):
                    yield first + int(block[begin]), part


def _different_units(blocks: _Blocks):
    """(block, word): the units of up to ``UNIT`` characters, each once per block."""

    def found(block, words):
        different = set()
        while words:  # a word goes as its units come
            different.update(units_of(words.pop()))
        own = [u for u in different if len(u) <= UNIT]
        del different
        for a in range(0, len(own), 100_000):
            some = own[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int32()), pa.array(some, pa.string())], ["block", "word"])

    def run(batches):
        current, words = None, set()
        for block, part in blocks.cut(batches):
            if block != current:
                yield from found(current, words)
                current, words = block, set()
            for text in of(part, "row.text").to_pylist():
                if text:
                    words.update(words_of(text))
        yield from found(current, words)
        pa.default_memory_pool().release_unused()

    return run


def _row_batches(blocks: _Blocks):
    """(block, kind 1, data): whole rows as compressed Arrow streams."""
    import zstandard

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for block, part in blocks.cut(batches):
            sink = pa.BufferOutputStream()
            part = part.select(["row"])
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            data = squeeze(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([1], pa.int32()), pa.array([data], pa.binary())], ["block", "kind", "data"])

    return run


def _path_batches(batches):
    """(block, kind 0, data): the units of a block in this partition with their paths, packed together."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    held, count = [], 0

    def packed():
        table = pa.Table.from_batches(held).combine_chunks()
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        table, block = table.take(order), block[order]
        for begin, stop in zip(starts := [0, *(np.flatnonzero(np.diff(block)) + 1).tolist()], [*starts[1:], len(block)]):
            some = table.slice(begin, stop - begin)
            words = some.column("word").combine_chunks().cast(pa.large_binary())
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
            lists = some.column("rows").combine_chunks()
            sizes = np.diff(np.asarray(lists.offsets))
            data = b"".join([
                np.int32(len(words)).tobytes(), np.diff(ends).astype(np.int32).tobytes(), sizes.astype(np.int32).tobytes(),
                lists.flatten().to_numpy().astype(np.int32).tobytes(), words.buffers()[2][int(ends[0]):int(ends[-1])]])
            yield pa.RecordBatch.from_arrays([
                pa.array([block[begin]], pa.int32()), pa.array([0], pa.int32()), pa.array([squeeze(data)], pa.binary())], ["block", "kind", "data"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count > 1 << 19:
            yield from packed()
            held, count = [], 0
    if count:
        yield from packed()


class _Words(dict):
    """The ids of a block's words, as bytes, put together from those of their units at first use."""

    def __init__(self, vocabulary: Vocabulary, opened):
        self.ids = np.array([i for _, i, _ in vocabulary.rows], np.int32)
        self.byte_ids, self.opened = vocabulary.byte_ids, opened
        #: Units that are not one mark and a word without marks; those are words, and listed as such.
        self.units: dict[str, bytes] = {}

    def bytes_of(self, path) -> bytes:
        own = [i for r in path for i in ([self.ids[r]] if r >= 0 else [self.byte_ids[b] for b in chr(-1 - r).encode()])]
        return np.array(own, np.int32).tobytes()

    def load(self, data: bytes) -> None:
        n = int(np.frombuffer(data, np.int32, 1)[0])
        lengths, sizes = np.frombuffer(data, np.int32, 2 * n, 4).reshape(2, n)
        rows = np.frombuffer(data, np.int32, int(sizes.sum()), 4 + 8 * n)
        ends = np.cumsum(sizes).tolist()
        known = self.ids[np.maximum(rows, 0)].tobytes()
        odd = np.add.reduceat(rows < 0, np.cumsum(sizes) - sizes).tolist()
        at = 4 + 8 * n + 4 * len(rows)
        begin = 0
        for length, end, missing in zip(lengths.tolist(), ends, odd):
            unit = data[at:at + length].decode()
            at += length
            own = self.bytes_of(rows[begin:end].tolist()) if missing else known[4 * begin:4 * end]
            begin = end
            if unit[0] == MARK and MARK not in unit[1:]:
                self[unit[1:]] = own
            else:
                self.units[unit] = own

    def unit(self, unit: str) -> bytes:
        own = dict.get(self, unit[1:]) if unit[0] == MARK else None
        if own is None and (own := self.units.get(unit)) is None:
            if len(unit) <= UNIT:
                raise ValueError("the rows of a block are not those its units came from: the input gave other rows when read again")
            self.units[unit] = own = self.bytes_of(self.opened()(unit))
        return own

    def __missing__(self, word: str) -> bytes:
        self[word] = own = b"".join(map(self.unit, units_of(word)))
        return own


def _put_together(vocabulary: Vocabulary, check: bool):
    """Each block's paths come first; then its rows get their ids, batch by batch."""
    import zstandard

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        search: list[Search] = []
        texts = _texts_of(vocabulary) if check else None

        def opened() -> Search:
            return search[0] if search else search.append(Search(vocabulary)) or search[0]

        current, known = None, None
        for batch in batches:
            for block, kind, data in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if block != current:
                    current, known = block, _Words(vocabulary, opened)
                data = open_(data.as_py())
                if kind == 0:
                    known.load(data)
                    continue
                rows = pa.ipc.open_stream(data).read_next_batch()
                for a in range(0, rows.num_rows, 256):
                    some = rows.slice(a, 256)
                    given = of(some, "row.text").to_pylist()
                    out = [b"".join(map(known.__getitem__, words_of(x))) if x else b"" for x in given]
                    flat = pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32())
                    ids = pa.ListArray.from_arrays(offsets([len(x) // 4 for x in out]).astype(np.int32), flat)
                    columns = [some.column("row"), ids]
                    if check:
                        again = zip(texts(ids), given)
                        columns.append(pa.array([x == (y or "").replace(MARK, " ") for x, y in again], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(columns, ["row", "ids", "round_trip"][:len(columns)])
        # Other tasks' workers need the room that this one's dictionary had.
        known = None
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, block_bytes: int = BLOCK_BYTES, check: bool = False) -> DataFrame:
    """Every row of ``docs`` (with ``text``) as ``row``, with its ``ids``.

    ``check`` adds ``round_trip``: whether the ids, decoded on the spot as ``decode`` does it, give ``comes_back_as`` the text.
    """
    rows = with_row(docs).withColumn("part", F.spark_partition_id())
    blocks = _Blocks(rows, block_bytes)
    texts = rows.select(F.struct("row.text").alias("row"), "part")
    had = texts.mapInArrow(_different_units(blocks), "block int, word string")
    # No unit is null; the join below would say so on one branch only, and the two would not read the same shuffle.
    had = had.where(F.col("word").isNotNull()).repartition("word")
    # The least block is not needed; with it, this branch reads the same shuffle as the one below.
    words = had.groupBy("word").agg(F.min("block").alias("block"))
    paths = had.join(lattice(words.where(F.col("block") >= 0), vocabulary), "word").select("block", "word", "rows")
    packed = paths.mapInArrow(_path_batches, "block int, kind int, data binary").unionByName(
        rows.mapInArrow(_row_batches(blocks), "block int, kind int, data binary"))
    added = [F.array().cast("array<int>").alias("ids"), F.lit(True).alias("round_trip")]
    shape = rows.select("row", *added[:2 if check else 1]).schema
    met = packed.repartitionById(max(1, blocks.n), "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_put_together(vocabulary, check), shape)


def _texts_of(vocabulary: Vocabulary):
    """Lists of ids to texts: all pieces of some lists are taken at once, then cut at the ends of the lists."""
    pieces_by_id = pa.array([x.replace(MARK.encode(), b" ") for x in vocabulary.by_id], pa.large_binary())

    def texts(lists: pa.Array) -> list[str]:
        out = []
        for a in range(0, len(lists), 256):
            some = lists.slice(a, 256)
            ends = offsets(pa.compute.fill_null(pa.compute.list_value_length(some), 0).to_numpy(zero_copy_only=False))
            found = pieces_by_id.take(some.flatten())
            starts = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
            data = found.buffers()[2].to_pybytes() if len(found) else b""
            for begin, end in zip(starts[ends[:-1]].tolist(), starts[ends[1:]].tolist()):
                out.append(data[begin + (data[begin:begin + 1] == b" "):end].decode(errors="replace"))
        return out

    return texts


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of an array of ids; control and unknown ids give nothing."""
    found = _texts_of(vocabulary)

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        return pa.array(found(lists), pa.string())

    return texts(ids)


def comes_back_as(text: Column) -> Column:
    """What decoding gives for a text: a mark in the text itself comes back as the space it stands for."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(" "))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = load()
    out = encode(docs, vocabulary, check=True)
    return out.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
