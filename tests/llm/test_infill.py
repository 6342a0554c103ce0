"""Fill-in-middle against a plain version and SQL, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import zstandard
from pyspark.sql import functions as F

from ballotlake.llm import infill
from ballotlake.llm.infill import OP12_SQL, op12_fill_in_middle

SMALL = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    name = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_table_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    out = op12_fill_in_middle(spark, SMALL)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({OP12_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert len({r[2] for r in want}) == 3


def test_odd_texts(spark):
    rnd = random.Random(12)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a<P>b", "<M>", "a < S > b", "x" * 5000, " " * 4000 + "end", "    é",
             "same here", "same here"]
    texts += ["".join(rnd.choice(" \n\x0b\x1cab<PSM>é☃\U0001F600") for _ in range(rnd.randint(1, 900))) for _ in range(150)]
    rows = [(i if i % 9 else None, t, "row", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames string, n int").repartition(3)
    for size in (1, 7, 64, infill.FRAME_BYTES):
        made = infill.fill_in_middle(docs, frame_bytes=size)
        got = infill.digests(made.withColumn("text", infill.output_text(F.col("output")))).collect()
        assert len(got) == len(rows)
        forms = set()
        for r in got:
            doc_id, text = r.row.doc_id, texts[r.row.n]
            n, form, prefix, middle, output = brute(doc_id, text)
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.text) == (n, form, prefix, middle, output)
            assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
            assert r.row.frames == "row"
            forms.add(form)
        assert forms == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.digests(infill.fill_in_middle(docs)).collect() == []


def test_only_frames_with_a_cut_are_opened():
    text = (" word" * 400).encode()
    compress, decompress = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
    units, chars, frames = zip(*infill._framed(text, compress, 100))
    cuts = infill._Cuts(np.array(units), np.array(chars), list(frames), compress, decompress)
    a, b = cuts.after(33), cuts.after(333)
    middle = cuts.stretch(a, b)
    assert b"".join(map(decompress, middle)) == b" word" * 300 and len(cuts.opened) == 2
    assert sum(x in frames for x in middle) >= len(middle) - 2  # all others are the stored ones
    assert zstandard.ZstdDecompressor().stream_reader(b"".join(middle), read_across_frames=True).read() == b" word" * 300
