"""A dump read in many small splits, against the tables it was written from."""

from __future__ import annotations

import pytest
from conftest import rows

from ballotlake.model import SCHEMAS
from ballotlake.sources.dump import dump_lines, load_dump, split_dump, write_dump


@pytest.fixture()
def small_splits(spark):
    """Splits of 40 bytes: nearly every line starts in another one."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


DUMP = r"""-- a dump
SET client_encoding = 'UTF8';

COPY public.notes (id, "text") FROM stdin;
1	COPY mkr.transfer_event (id, sender) FROM stdin;
2	plain
\.


COPY vulcan2x.block (id, number, hash, "timestamp") FROM stdin;
1	10	0xaa	2024-01-01 00:00:00+00
2	11	0xbb	2024-01-01 02:30:01.5+02:30
3	12	0xcc	2023-12-31 23:00:00-01
\.

COPY mkr.transfer_event (id, sender, receiver, amount, log_index, tx_id, block_id) FROM stdin;
\.

COPY dschief.lock (id, from_address, immediate_caller, lock, contract_address, log_index, tx_id, block_id) FROM stdin;
COPY mkr.transfer_event (id, sender) FROM stdin;	a	b	1	c	1	1	1
4	a\tb	c\\d	-2.5	e	0	1	1
\.
SELECT setval('x', 1);
COPY dschief.lock (block_id, id, from_address, immediate_caller, lock, contract_address, log_index, tx_id) FROM stdin;
2	5	f	g	7	h	3	2
\.
"""


@pytest.mark.parametrize("reader", ["lines", "folders"])
def test_sections_of_one_file(spark, tmp_path, small_splits, reader):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP.replace("COPY mkr.transfer_event (id, sender) FROM stdin;\ta", "9\ta"))
    t = load_dump(spark, str(path)) if reader == "lines" else split_dump(spark, str(path), str(tmp_path / "out"))
    assert set(t.names()) == {"block", "transfer", "lock"}
    assert rows(t.block, "id", "number", "block_ts") == [(1, 10, 1704067200.0), (2, 11, 1704067201.5), (3, 12, 1704067200.0)]
    assert t.transfer.collect() == [] and t.transfer.columns == SCHEMAS["transfer"].names
    assert rows(t.lock, "id", "from_address", "immediate_caller", "lock_amt", "log_index", "block_id") == [
        (4, "a\tb", "c\\d", -2.5, 0, 1), (5, "f", "g", 7.0, 3, 2), (9, "a", "b", 1.0, 1, 1)]


def test_a_line_that_looks_like_a_header_is_data_inside_a_section(spark, tmp_path, small_splits):
    path = tmp_path / "dump.sql"
    path.write_text("COPY a.b (x) FROM stdin;\none\nCOPY mkr.balances (id) FROM stdin;\nCOPY c.d (x) FROM stdin;\ntwo\n\\.\n"
                    "between\n\\.\nCOPY c.d (x) FROM stdin;\nthree\n\\.\n")
    found = {(r.header[5:8], r.value) for r in dump_lines(spark, str(path)).collect()}
    assert found == {("a.b", "one"), ("a.b", "COPY mkr.balances (id) FROM stdin;"), ("a.b", "COPY c.d (x) FROM stdin;"),
                     ("a.b", "two"), ("c.d", "three")}


@pytest.mark.parametrize("files", [1, 3])
def test_written_dump_comes_back(spark, tables, tmp_path, small_splits, files):
    t = tables(
        block=[(i, 100 + i, 1704067200 + i) for i in range(1, 40)],
        transfer=[{"sender": f"s\\{i}", "receiver": "r\tx", "amount": i, "block_id": i} for i in range(1, 40)],
        vote=[{"voter": f"v{i}", "poll_id": i, "option_id_raw": None if i % 3 else "", "block_id": i} for i in range(1, 20)])
    names = ["block", "transfer", "vote", "lock"]
    write_dump(t, str(tmp_path / "dump"), names, files)
    parts = list((tmp_path / "dump").glob("part-*"))
    assert len(parts) == files and all(p.read_text().count("FROM stdin;") == 4 for p in parts)
    for again in (load_dump(spark, str(tmp_path / "dump")), split_dump(spark, str(tmp_path / "dump"), str(tmp_path / "out"))):
        for name in names:
            assert rows(getattr(again, name)) == rows(getattr(t, name)), name


def test_lines_are_not_shuffled(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP)
    plan = dump_lines(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan
