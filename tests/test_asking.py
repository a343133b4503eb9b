"""Tools, expectations, replies and detail pages on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from statvine.functions import replies
from statvine.operators import golden, tools
from statvine.sources import html

DAY = datetime.date


@pytest.fixture(scope="module")
def library(spark):
    chunks = [
        (1, "8:08", "1", "This Act may be cited as the Debtors Act", DAY(2014, 12, 31), 70, "2006 Edition"),
        (2, "8:08", "1", "Short title, as amended by the Debtors Act", DAY(2016, 12, 31), 90, ""),
        (3, "8:08", "3", "Arrest of a debtor", None, None, None),
    ]
    return tools.Library(
        spark.createDataFrame([("8:08", "Absconding Debtors"), ("9:01", None)], "chapter_number string, title string"),
        spark.createDataFrame(chunks, "chunk_id long, chapter_number string, section_ref string, chunk_text string, as_at_date date, download_id long, version_label string"),
        spark.createDataFrame([("a", "Roe v Doe", 2001), ("b", "", None), ("c", None, 1999)], "id string, title string, year int"),
        spark.createDataFrame([("a", "8:08"), ("b", "8:08"), ("c", "9:01")], "case_id string, chapter_number string"),
    )


def shown(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("place").collect()]


def test_seven_tools(library):
    assert sorted(tools.TOOLS) == ["citing_cases", "expand_case", "list_chapters", "lookup_section", "resolve_citation", "search_cases", "search_provisions"]


def test_lookup_and_search(library):
    assert shown(tools.lookup_section(library, "8:08", "1"), "source_id", "date", "url") == [("lookup:90:0", "2016-12-31", "/api/pdf/90"), ("lookup:70:1", "2014-12-31", "/api/pdf/70")]
    assert shown(tools.lookup_section(library, "8:08", "1", "2015-06-01"), "source_id") == [("lookup:70:0",)]
    assert shown(tools.lookup_section(library, "8:08", "2"), "source_id") == []
    assert shown(tools.search_provisions(library, "debtors act", date="2015-06-01"), "source_id", "title") == [("chunk:1", "Absconding Debtors")]
    assert shown(tools.search_provisions(library, "debtors", chapter="9:01"), "source_id") == []


def test_lookup_shows_every_version(spark, library):
    rows = [(n, "8:08", "1", "text", DAY(2000, 1, 1) + datetime.timedelta(n), n, "") for n in range(150)]
    many = tools.Library(library.chapters, spark.createDataFrame(rows, library.chunks.schema), library.cases, library.citations)
    assert shown(tools.lookup_section(many, "8:08", "1"), "source_id") == [(f"lookup:{149 - n}:{n}",) for n in range(150)]
    assert len(shown(tools.lookup_section(many, "8:08", "1", limit=3), "source_id")) == 3


def test_resolve(library):
    (hit,) = tools.resolve_citation(library, "Chap. 8:8", "s. 1").collect()
    assert hit["source_id"] == "chunk:2" and hit["line"].split("\n") == ["found", "Absconding Debtors Act, Chap. 8:08, s. 1 (version available as at 31 December 2016)", "Chap. 8:08, s. 1", "Short title, as amended by the Debtors Act"]
    got = shown(tools.resolve_citation(library, "8:08", "2"), "source_id", "section", "line")
    assert [x[:2] for x in got] == [("", ""), ("chunk:2", "1"), ("chunk:3", "3")] and got[0][2] == "Citation status: not_found for Chap. 8:08, s. 2."
    assert shown(tools.resolve_citation(library, "chapter eight", "2"), "source_id", "line") == [("", "Invalid citation reference: chapter eight, 2")]


def test_ambiguous_citations(spark, library):
    rows = [(n, "8:08", "7", text, DAY(2010, 1, 1), n, "") for n, text in ((1, "one"), (2, "other"))]
    two = tools.Library(library.chapters, spark.createDataFrame(rows, library.chunks.schema), library.cases, library.citations)
    assert shown(tools.resolve_citation(two, "8:08", "7"), "kind", "line")[0] == ("status", "Citation status: ambiguous for Chap. 8:08, s. 7.")


def test_schemas_of_tools():
    told = {x["function"]["name"]: x["function"]["parameters"] for x in tools.schemas()}
    assert sorted(told) == sorted(tools.TOOLS) and told["resolve_citation"]["required"] == ["chapter", "section"]
    assert told["search_provisions"]["properties"]["limit"]["type"] == "integer"


def test_cases(library):
    assert shown(tools.citing_cases(library, "chapter 8-8"), "source_id", "line") == [("a", "Roe v Doe (a) cites Chap. 8:08"), ("b", "b cites Chap. 8:08")]
    assert shown(tools.search_cases(library, "ROE"), "line") == [("Roe v Doe (a) (2001)",)]
    assert shown(tools.expand_case(library, "case:a"), "source_id") == [("b",)] and shown(tools.expand_case(library, "c"), "source_id") == []
    assert shown(tools.list_chapters(library, limit=1), "source_id", "title") == [("chapter:8:08", "Absconding Debtors")]


def test_expectations(spark):
    schema = "id string, must_contain array<string>, must_not_contain array<string>, min_chars int, should_exist boolean, differs_from array<string>, same_as array<string>"
    rows = [("a", ["x"], ["y"], 3, True, ["b"], ["c"]), ("b", ["q"], ["x"], 9, None, ["c"], ["a"]), ("c", None, None, None, None, ["a"], None), ("d", ["x"], None, 5, False, None, None), ("e", None, None, None, True, None, None)]
    texts = spark.createDataFrame([("a", "xxx"), ("b", "x"), ("c", "xxx")], "id string, text string")
    got = {r["id"]: r["failed"] for r in golden.check(spark.createDataFrame(rows, schema), texts).collect()}
    assert got == {"a": [], "b": ["must_contain", "must_not_contain", "min_chars", "same_as"], "c": ["differs_from"], "d": [], "e": ["should_exist"]}


def test_replies(spark):
    good = 'Sure: {"answer":"x","source_ids":["s"]} done'
    rows = [(good, ["s", "t"], 1), (good, ["t"], 1), ("prose", ["t"], 1), ("prose", [], 1), (None, ["t"], 1), ('{"answer":"x"}', ["t"], 1), (good, ["s"], 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, reply string, ids array<string>, rounds int")
    got = df.orderBy("i").select(replies.decide(F.col("reply"), F.col("ids"), F.col("rounds")).alias("s")).collect()
    assert [r["s"] for r in got] == ["ok", "refused", "refused", "ok", "refused", "refused", "error"]


def test_detail_page(spark):
    page = """<h4 class="x"><a href="#">Road Traffic Chap. 48:50</a></h4><p><i class="fa"></i><strong>
      An Act about
      roads. </strong></p><ul><li><a href="#"><i></i> Year - 1934</a></li><li><a href="#"><i></i> Act Number - 42</a></li>
      <li><a href="#"><i></i> Commencement Date -  Fri, 5 Jan 1934</a></li><li><a href="#"><i></i> Classification - TRANSPORT</a></li></ul>
      <ul><li><a href="/r/download/7?type=act" class="t"><img src="i.png" /></a><a href="/r/download/7?type=act" class="clear">
      <strong><small class="pull-right">as at December 31st 2016</small></strong> <strong class="block">2006 Edition </strong></a></li>
      <li><a href="/r/download/5?type=act"><img /></a><a href="/r/download/5?type=act"><strong><small>soon</small></strong><strong class="block">Old</strong></a></li></ul>"""
    first, empty = html.detail(spark.createDataFrame([(page,), ("<p></p>",)], "html string")).collect()
    assert tuple(first)[:7] == ("Road Traffic", "48:50", "An Act about roads.", 1934, "42", DAY(1934, 1, 5), "TRANSPORT")
    assert [tuple(r) for r in first["revisions"]] == [(7, DAY(2016, 12, 31), "2006 Edition"), (5, None, "Old")]
    assert empty["title"] == "" and empty["revisions"] == [] and empty["year"] is None
