"""Every query with SQL gives DuckDB's rows; citation forms, files and the stream on literal cases."""

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from statvine.functions import citations as C
from statvine.functions import text as T
from statvine.plans.all import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    return f"{float(v):.6g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    ours = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = duck.sql(ORACLES[name])
    order = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(df.columns) == sorted(sql.columns)
    assert ours == sorted(tuple(plain(r[i]) for i in order) for r in sql.fetchall())


def column(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_citation_forms(spark):
    assert column(spark, C.normalize_chapter, ["8:08", "Chap. 8:08", "chapter 8-8", "8 08", "", "chapter eight", "8", "8:", None, "8:123"]) == ["8:08"] * 4 + [None] * 5 + ["8:123"]
    assert column(spark, C.normalize_section, ["12", "s. 3a", "section 12 (3) (A)", "ss 24(1)(b)", "", "section twelve", "12(", "12(a"]) == ["12", "3A", "12(3)(a)", "24(1)(b)"] + [None] * 4
    assert column(spark, C.citation_title, ["  Debtors ", "Road  Rules", None]) == ["Debtors Act", "Road Rules", "Title unavailable"]
    assert column(spark, C.parse_iso_date, ["2016-12-31", "2016-02-30", "x"]) == [datetime.date(2016, 12, 31), None, None]


def test_text(spark):
    assert column(spark, T.query_terms, ["the Debtor debtor absconded"]) == [["the", "debtor", "absconded"]]
    (cut,) = column(spark, lambda v: T.excerpt_around_query(v, F.lit("needle"), 40), ["hay " * 50 + "needle " + "hay " * 50])
    assert "needle" in cut and cut[0] == cut[-1] == "…" and len(cut) <= 42
    (parts,) = column(spark, lambda v: T.highlight_segments(v, ["a.b"]), ["xA.Byab"])
    assert [(p["text"], p["match"]) for p in parts] == [("x", False), ("A.B", True), ("yab", False)]


def test_labels(spark):
    days = [(0, "2016-12-31", "Rev", True, None), (1, "2015-01-01", "", False, None), (0, None, "Rev", False, None), (1, "2015-01-01", None, False, "2016-01-01")]
    rows = spark.createDataFrame(days, "position int, day string, label string, latest boolean, asked string").withColumn("day", F.col("day").cast("date")).withColumn("asked", F.col("asked").cast("date"))
    got = rows.select(T.version_label(F.col("position"), F.col("day"), F.col("label")), T.authority_label(F.col("day"), F.col("latest"), F.col("asked"))).collect()
    assert [r[0] for r in got] == ["Latest available · 2016-12-31 · Rev", "2015-01-01", "Date unavailable · Rev", "2015-01-01"]
    assert [r[1] for r in got] == ["Latest available", "Historical version", "No effective date on file", "Available as at 2016-01-01"]


def test_files(spark, tmp_path):
    from statvine.sources import files, html

    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"t","body":"b"}\n\n{broken\n{"record_id":"2","title":"u","text":"c"}\n')
    (tmp_path / "._a.jsonl").write_text('{"id":"9","body":"hidden"}\n')
    assert sorted(map(tuple, files.read_cases(spark, str(tmp_path)).collect())) == [("1", "t", "b"), ("2", "u", "c")]
    folder = tmp_path / "law" / "8_08_Absconding_Debtors"
    folder.mkdir(parents=True)
    (folder / "77.md").write_text("# Act\n## 1. Short title\nx\n## 2A. Arrest\ny\nz\n")
    rows = files.sections(files.read_markdown(spark, str(tmp_path / "law"))).orderBy("chunk_index").collect()
    assert [(r["chapter_number"], r["title"], r["download_id"], r["section_ref"], r["heading"]) for r in rows] == [("8:08", "Absconding Debtors", 77, "1", "Short title"), ("8:08", "Absconding Debtors", 77, "2A", "Arrest")]
    page = '<ul><li class="x"><a href="/p?currentid=5"><strong class="block">Debtors</strong><small>a</small><small>Chapter 8:08 (repealed)</small></a></li></ul>'
    got = html.listing(spark.createDataFrame([(page,), ("<ul></ul>",)], "html string")).collect()
    assert [tuple(r) for r in got] == [(5, "Debtors", "8:08", "repealed")]
    assert column(spark, html.ordinal_date, ["as at December 31st 2016", "soon"]) == [datetime.date(2016, 12, 31), None]


def test_stream_takes_a_version_once(spark, tmp_path):
    from statvine.streaming import versions

    row = ("8:08", "1", 7, datetime.date(2016, 1, 1), datetime.datetime(2024, 1, 1))
    for _ in range(2):
        spark.createDataFrame([row, row], versions.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        versions.append(versions.incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_bare_references_read_their_context(spark):
    from statvine.operators.graph import bare_references

    texts = [(1, "Act 1:05, 1:06 and, long after the word, far beyond forty characters, 1:07"), (2, "pact 1:05"), (3, "CAP\n1:05 1:99")]
    known = spark.createDataFrame([("1:05",), ("1:06",), ("1:07",)], "chapter_number string")
    got = bare_references(spark.createDataFrame(texts, "chunk_id long, chunk_text string"), known).collect()
    assert sorted(map(tuple, got)) == [(1, "1:05", "medium", "REGEX"), (1, "1:06", "medium", "REGEX"), (3, "1:05", "medium", "REGEX")]
    (sure,) = bare_references(spark.createDataFrame([(4, "Cap. 1:05")], "chunk_id long, chunk_text string"), known).collect()
    assert sure["confidence"] == "high"
