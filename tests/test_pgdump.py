import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dumpdeck import encode
from dumpdeck.functions.rows import accepted, rejects
from dumpdeck.sources.open import inventory, open_dump, skipped_indexes
from dumpdeck.sources.pgdump import PgDump, read_pgdump

FULL = """\\restrict k3

SET statement_timeout = 0;

CREATE TABLE lab.sample (
    barcode uuid NOT NULL,
    taken_on date,
    ph real,
    tags text[]
);

CREATE UNLOGGED TABLE "Assay Run" (
    sample uuid,
    "Result %" numeric(7,4) DEFAULT 0.5 NOT NULL,
    span interval,
    CONSTRAINT positive CHECK (("Result %" > (0)::numeric))
);

COPY "Assay Run" (span, sample, "Result %") FROM stdin;
1 day\t5f0c0d6e-0000-4000-8000-000000000001\t12.0625
\\N\t5f0c0d6e-0000-4000-8000-000000000002\t0.5000
02:00:00\t\\N\t99.9999
\\.

COPY lab.sample (barcode, taken_on, ph, tags) FROM stdin;
5f0c0d6e-0000-4000-8000-000000000001\t1999-12-31\t6.5\t{a,b}
\\.

COPY public.nowhere (a) FROM stdin;
5
\\.

CREATE INDEX by_result ON public."Assay Run" USING btree ("Result %" DESC NULLS LAST);
CREATE INDEX by_span ON public."Assay Run" USING btree (span, sample);
CREATE UNIQUE INDEX by_tags ON lab.sample USING gin (tags array_ops);
ALTER TABLE ONLY lab.sample
    ADD CONSTRAINT sample_key PRIMARY KEY (barcode);
ALTER TABLE ONLY public."Assay Run" ADD CONSTRAINT of_sample FOREIGN KEY (sample) REFERENCES lab.sample(barcode);
"""


def test_full_dump(spark, write):
    d = PgDump(spark, write("full.sql", FULL))
    assert d.tables() == ["Assay Run", "lab.sample"]
    cols = {(r.table_name, r.column_name): r for r in d.columns.collect()}
    assert len(cols) == 7
    assert cols["lab.sample", "barcode"].is_pk and cols["lab.sample", "tags"].is_unique
    assert cols["Assay Run", "Result %"].type == "DECIMAL(7,4)" and cols["Assay Run", "Result %"].not_null
    rules = {(r.kind, r.name, tuple(r.columns), r.ref_table) for r in d.constraints.collect()}
    assert rules == {
        ("pk", "sample_key", ("barcode",), None), ("fk", "of_sample", ("sample",), "lab.sample"),
        ("index", "by_result", ("Result %",), None), ("index", "by_span", ("span", "sample"), None),
        ("unique", "by_tags", ("tags",), None),
    }
    counts = {(r.table_name, r.n) for r in inventory(d).collect()}
    assert counts == {("Assay Run", 3), ("lab.sample", 1), (None, 4)}
    assert [(r.name, r.reason) for r in skipped_indexes(d.constraints).collect()] == [("by_span", "composite index")]
    runs = accepted(d.rows("Assay Run")).select("span", "Result %").collect()
    assert sorted((str(a), str(b)) for a, b in runs) == [("02:00:00", "99.9999"), ("1 day", "12.0625"), ("None", "0.5000")]
    assert accepted(d.rows("lab.sample")).count() == 1
    with pytest.raises(ValueError):
        d.rows("nowhere")


def test_hostile_data(spark, write):
    """Data may look like headers, statements or DDL, and may end in a semicolon."""
    text = """CREATE TABLE public.notes (
    id bigint,
    body text
);
COPY public.notes (id, body) FROM stdin;
1\tplain;
2\tline\\none\\ttab \\\\ back \\q
COPY public.notes (id, body) FROM stdin;
CREATE TABLE public.fake (
    id bigint
);
3\t\\\\.
\\.
COPY public.other (x) FROM stdin;
9
\\.
"""
    d = PgDump(spark, write("notes.sql", text))
    assert d.tables() == ["notes"]
    rows = d.rows("notes")
    good = accepted(rows).orderBy("id").collect()
    assert [tuple(r) for r in good] == [(1, "plain;"), (2, "line\none\ttab \\ back \\q"), (3, "\\.")]
    bad = rejects(rows, "notes").collect()
    assert sorted(r.raw for r in bad) == [
        "    id bigint", ");", "COPY public.notes (id, body) FROM stdin;", "CREATE TABLE public.fake (",
    ]
    assert {r.reason for r in bad} == {"expected 2 fields, got 1"} and all(r.dropped for r in bad)


def test_header_order_and_undeclared_columns(spark, write):
    text = "CREATE TABLE t (\n    a integer,\n    b text\n);\nCOPY t (b, a, extra) FROM stdin;\nx\t1\t7\n\\.\n"
    rows = read_pgdump(spark, write("t.sql", text), "t")
    assert rows.dtypes == [("b", "string"), ("a", "bigint"), ("extra", "string")]
    assert [tuple(r) for r in rows.collect()] == [("x", 1, "7")]


def test_misfits_become_null(spark, write):
    text = "CREATE TABLE t (\n    a integer,\n    b boolean\n);\nCOPY t (a, b) FROM stdin;\nx\tt\n2\tf\n\\.\n"
    rows = PgDump(spark, write("t.sql", text)).rows("t")
    assert {tuple(r) for r in accepted(rows).collect()} == {(None, True), (2, False)}
    (bad,) = rejects(rows, "t").collect()
    assert (bad.reason, bad.dropped, bad.raw) == ("does not fit: a", False, "x\tt")


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _big(tables: int, rows: int) -> str:
    out = []
    for t in range(tables):
        out.append(f"CREATE TABLE public.t{t} (\n    id bigint,\n    body text\n);")
        out.append(f"COPY public.t{t} (id, body) FROM stdin;")
        # Every tenth row looks like a header of the next table.
        for i in range(rows):
            out.append(f"{i}\tx{i}" if i % 10 else f"COPY public.t{(t + 1) % tables} (id, body) FROM stdin;")
        out.append("\\.")
    return "\n".join(out) + "\n"


def test_many_splits(spark, write, small_splits):
    d = PgDump(spark, write("big.sql", _big(4, 1000)))
    assert d.lines.rdd.getNumPartitions() > 10
    for t in range(4):
        rows = accepted(d.rows(f"t{t}"))
        assert rows.agg(F.count("*"), F.sum("id")).first()[:] == (900, sum(i for i in range(1000) if i % 10))
    assert {r.n for r in d.counts().collect()} == {1000}
    d.close()


def test_many_files_and_staging(spark, write, tmp_path, small_splits):
    for i in range(3):
        write(f"in/{i}.sql", _big(2, 200))
    d = PgDump(spark, str(tmp_path / "in"))
    staged = str(tmp_path / "staged")
    d.stage(staged)
    for rows in (d.rows("t1"), d.rows("t1", staged=staged), d.rows("t1", spread=5)):
        assert accepted(rows).agg(F.count("*"), F.sum("id")).first()[:] == (540, 3 * sum(i for i in range(200) if i % 10))


def test_compressed_and_crlf(spark, tmp_path, write):
    path = tmp_path / "full.sql.gz"
    path.write_bytes(gzip.compress(FULL.encode()))
    assert read_pgdump(spark, str(path), "Assay Run").count() == 3
    crlf = write("crlf.sql", FULL.replace("\n", "\r\n"))
    runs = open_dump(spark, crlf).rows("Assay Run")
    assert sorted(r.span or "" for r in accepted(runs).collect()) == ["", "02:00:00", "1 day"]


def test_no_tables(spark, write):
    d = PgDump(spark, write("none.sql", "-- PostgreSQL database dump\n\nSET x = 1;\n"))
    assert d.tables() == [] and d.counts().collect() == [] and d.blocks.count() == 0


def test_round_trip_of_random_text(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("\\N\"\n\r\t;().' aé") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t if i % 11 else None) for i, t in enumerate(texts)], "id long, t string")
    path = encode.write_pgdump({"r": df, "s": df.select("t")}, str(tmp_path / "d"))
    got = {r.id: r.t for r in read_pgdump(spark, path, "r").collect()}
    assert got == {i: t if i % 11 else None for i, t in enumerate(texts)}
    single = Counter(r.t for r in read_pgdump(spark, path, "s").collect())
    assert single == Counter(got.values())


def test_blocks_cross_chunks(spark, write, monkeypatch):
    """Many blocks of one split, in chunks of a few lines."""
    monkeypatch.setattr("dumpdeck.sources.ddl.CHUNK", 4)
    rows = [[f"{i}.{n}" for n in range(i % 13)] for i in range(60)]
    text = "CREATE TABLE public.c (\n    v text\n);\n" + "".join(
        "\n".join(["COPY public.c (v) FROM stdin;", *r, *["COPY public.c (v) FROM stdin;"] * (i % 3), "\\.", "", ""]) for i, r in enumerate(rows)
    )
    path = write("chunks.sql", text)
    dump = PgDump(spark, path)
    assert dump.blocks.count() == 60
    # No window takes the lines of a whole file at once.
    plan = dump._marks._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk" in plan
    dump.close()
    found = Counter(r.v for r in read_pgdump(spark, path, "c").collect())
    assert found == Counter([v for r in rows for v in r] + ["COPY public.c (v) FROM stdin;"] * 60)
