"""Structure of laws, graph files, many terms, case nodes, states and SQL table functions on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from statvine.functions import replies
from statvine.operators import casework, graph, search, sqltools, structure, tools
from statvine.sources import files

LAW = """# Antibiotics
Preliminary words
## PART I Preliminary
## 1. Short title
This Act may be cited.
2A. Interpretation
(1) In this Act
12. is not announced within text, though it looks so
PART II
**FIRST SCHEDULE**
1. Penicillin
PART of an item
2. Aureomycin
## Second Schedule
Repealed
SCHEDULE
Chloramphenicol"""


def test_structure_carries_what_was_announced(spark):
    laws = spark.createDataFrame([(1, LAW), (2, None), (3, "no structure\nat all"), (4, "SCHEDULE"), (5, "1. One\r\ntext\r\n2. Two\r\n")], "download_id long, text string")
    rows = [r for r in structure.chunked(laws, "download_id").orderBy("download_id", "chunk_index").collect()]
    got = [(r["chunk_index"], r["part"], r["schedule"], r["section_ref"], r["heading"], r["chunk_text"].count("\n")) for r in rows if r["download_id"] == 1]
    assert got == [
        (0, "I", None, "1", "Short title", 1), (1, "I", None, "2A", "Interpretation", 1), (2, "I", None, "12", "is not announced within text, though it looks so", 0),
        (3, None, "FIRST SCHEDULE", "FIRST SCHEDULE", "", 3), (4, None, "SECOND SCHEDULE", "SECOND SCHEDULE", "", 1), (5, None, "SCHEDULE", "SCHEDULE", "", 1)]
    schedule = next(r for r in rows if r["section_ref"] == "FIRST SCHEDULE")
    assert "Penicillin" in schedule["chunk_text"] and "Aureomycin" in schedule["chunk_text"]
    assert [r["download_id"] for r in rows if r["download_id"] != 1] == [4, 5, 5]
    assert [r["heading"] for r in rows if r["download_id"] == 5] == ["One", "Two"]
    assert structure.lines(laws, "download_id").where("download_id = 2").first()["chunk"] == 0


def test_schedules_are_looked_up_like_sections(spark):
    laws = spark.createDataFrame([("30:02", 106044, datetime.date(2016, 12, 31), LAW)], "chapter_number string, download_id long, as_at_date date, text string")
    found = files.sections(laws).where("chapter_number = '30:02' and section_ref = 'FIRST SCHEDULE' and as_at_date <= date '2016-12-31'").first()
    assert found["schedule"] == "FIRST SCHEDULE" and "Penicillin" in found["chunk_text"]


def test_graph_files_say_what_they_hold(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "idea"), ("b", "idea"), ("c", "chapter")], "id string, type string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(x):
        seen.add(1)
        return x

    edges = spark.createDataFrame([("c", "a", "PART_OF", "EXTRACTED"), ("c", "b", "PART_OF", "EXTRACTED"), ("a", "b", "SEMANTIC", "INFERRED")], "source string, target string, type string, evidence string")
    files.write_graph(nodes, edges.withColumn("source", watched("source")), str(tmp_path / "g"))
    assert seen.value == 3  # edges are evaluated once
    (meta,) = files.read_meta(spark, str(tmp_path / "g")).collect()
    assert (meta["nodes"], meta["edges"]) == (3, 3) and meta["node_types"] == {"idea": 2, "chapter": 1}
    assert meta["edge_types"] == {"PART_OF": 2, "SEMANTIC": 1} and meta["evidence"] == {"EXTRACTED": 2, "INFERRED": 1}
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "g"))] == [3, 3]
    with pytest.raises(ValueError, match="no node"):
        files.write_graph(nodes, edges.withColumn("target", F.lit("z")), str(tmp_path / "h"))
    assert not (tmp_path / "h").exists()


@pytest.mark.parametrize("most", [1000, 0])
def test_many_terms_are_found_either_way(spark, most):
    terms = ["the Act", "the Minister", "the", "Debtor", "Public Officer", "Public  Officer", "Officer", "Court of Law", "Re-hearing", "Debtor's goods"]
    texts = ["the Act binds the Minister.", "(Debtor) or “Debtor”,", "a Public Officer; a Public  Officer.", "xDebtor Debtors", "at the Court of Law", " the Court of Laws", "a Re-hearing: Debtor's goods,", None, "", "Debtor", " Officer "]
    ideas = spark.createDataFrame([(f"idea:{i}", t) for i, t in enumerate(texts)], "id string, chunk_text string")
    found = graph.mentions(ideas, spark.createDataFrame([(t,) for t in terms + terms[:2]], "term string"), most).collect()
    want = set()
    for i, text in enumerate(texts):
        for t in terms:
            at = (text or "").find(t)
            while at >= 0:
                if at > 0 and text[at - 1] in graph.OPENS and text[at + len(t) : at + len(t) + 1] and text[at + len(t)] in graph.CLOSES:
                    want.add((f"idea:{i}", f"concept:{t}"))
                at = text.find(t, at + 1)
    assert sorted((r["source"], r["target"]) for r in found) == sorted(want) and len(want) >= 9


def test_short_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 3, "needle in hay"), (2, 2, None), (3, 1, "hay"), (4, 0, "")], "doc_id long, n_chars long, text string")
    items = spark.createDataFrame([(10, "needle"), (11, "in hay"), (12, "eedl"), (13, ""), (14, "hay"), (15, "hay"), (16, "needle in hay")], "item_id long, passage string")
    got = sorted((r["item_id"], r["doc_id"]) for r in search.holding(docs, items).collect())
    assert got == [(10, 1), (11, 1), (12, 1), (13, 1), (13, 3), (13, 4), (14, 1), (14, 3), (15, 1), (15, 3), (16, 1)]
    monkeypatch.setattr(search, "SHORT", 3)
    with pytest.raises(ValueError, match="less than three"):
        search.holding(docs, items)


def test_cases_that_only_citations_name(spark):
    nodes = spark.createDataFrame([("case:1", "case", "Known", "t"), ("chapter:1", "chapter", "c", "c")], "id string, type string, label string, text string")
    edges = spark.createDataFrame([("case:1", "chapter:1", "d", "x"), ("case:2", "chapter:1", "says", "R v. Two"), ("case:2", "chapter:2", "later", None), ("case:3", "chapter:1", "", None), ("idea:9", "chapter:1", "d", None)], "source string, target string, detail string, title string")
    got = {r["id"]: (r["type"], r["label"], r["text"]) for r in graph.with_case_nodes(nodes, edges).collect()}
    assert set(got) == {"case:1", "case:2", "case:3", "chapter:1"} and got["case:1"][1] == "Known"
    assert got["case:2"][0] == "case" and got["case:3"] == ("case", "case:3", "")
    assert {r["id"] for r in graph.with_case_nodes(nodes, edges.drop("title")).collect()} == set(got)


def test_the_surest_citation_comes_first(spark):
    edges = spark.createDataFrame([("case:a", "low"), ("case:a", "medium"), ("case:b", "high"), ("case:c", "medium"), ("case:d", None), ("case:gone", "high")], "source string, confidence string")
    cases = spark.createDataFrame([("a", "A", 1990), ("b", "B", 1950), ("c", "C", None), ("d", "D", 2020)], "id string, title string, year int")
    assert [(r["id"], r["confidence"]) for r in casework.by_confidence(edges, cases).collect()] == [("b", "high"), ("a", "medium"), ("c", "medium"), ("d", None)]


def test_all_states_and_rules(spark):
    good = '{"answer":"x","source_ids":["s"]}'
    rows = [(good, ["s"], 1, False, None), (good, ["s"], 1, None, True), (good, ["s"], 9, True, False), (good, ["t"], 1, None, None), (good, [], 1, None, None), (None, ["s"], 1, True, False), (good, ["s"], 1, True, False)]
    frame = spark.createDataFrame(rows, "reply string, ids array<string>, rounds int, keyed boolean, failed boolean")
    got = [r[0] for r in frame.select(replies.decide(F.col("reply"), F.col("ids"), F.col("rounds"), F.col("keyed"), F.col("failed"))).collect()]
    assert got == ["unconfigured", "error", "error", "refused", "ok", "refused", "ok"]
    asked = spark.createDataFrame([("fts", "research", "ok", 1, 0), ("ftsx", "precedent", "unconfigured", 100, 5), (None, "", "bad", 101, -1)], "mode string, chat_mode string, status string, limit int, offset int")
    assert [r[0] for r in asked.select(replies.broken_rules()).collect()] == [[], ["mode"], ["mode", "chat_mode", "status", "limit", "offset"]]


def test_tools_by_sql_give_the_same(spark):
    day = datetime.date
    chapters = spark.createDataFrame([("8:08", "Absconding Debtors"), ("9:01", "Road Rules")], "chapter_number string, title string")
    chunks = spark.createDataFrame([(i, c, s, t, d, i % 3, v) for i, (c, s, t, d, v) in enumerate([
        ("8:08", "3", "the debtor shall pay", day(2001, 1, 1), "a"), ("8:08", "3", "the debtor shall   pay more " * 40, day(2010, 1, 1), ""), ("8:08", "3", "another text", day(2010, 1, 1), "b"),
        ("8:08", "4", "a debtor 'quoted'", None, "a"), ("9:01", "12(3)(a)", "roads and the debtor", day(2005, 5, 5), "c"), ("9:01", "", "the whole debtor", day(2005, 5, 5), "c")])], "chunk_id long, chapter_number string, section_ref string, chunk_text string, as_at_date date, download_id long, version_label string")
    cases = spark.createDataFrame([("a", "R v. A", 1999), ("b", "", 2001), ("c", None, None)], "id string, title string, year int")
    citations = spark.createDataFrame([("a", "8:08"), ("b", "8:08"), ("c", "9:01"), ("a", "9:01")], "case_id string, chapter_number string")
    lib = tools.Library(chapters, chunks, cases, citations)
    assert sqltools.register(spark, lib) == sorted(tools.TOOLS)
    calls = [("lookup_section", "8:08", "3"), ("lookup_section", "8:08", "3", "2005-01-01"), ("lookup_section", "x", "3"), ("list_chapters",), ("list_chapters", "road"), ("citing_cases", "Chapter 8-8"), ("citing_cases", "bad"),
             ("search_cases", "r v"), ("expand_case", "case:a"), ("search_provisions", "the debtor"), ("search_provisions", "debtor", "9:01"), ("search_provisions", "debtor", "", "2006-01-01"), ("search_provisions", "nothing"),
             ("resolve_citation", "Chap. 8:08", "s. 3"), ("resolve_citation", "8:8", "3", "2002-01-01"), ("resolve_citation", "9:1", "section 12 (3) (A)"), ("resolve_citation", "8:08", "77"), ("resolve_citation", "?", "3"), ("resolve_citation", "8:08", "4")]
    for name, *args in calls:
        said = ", ".join(f"'{a}'" for a in args)
        by_sql = spark.sql(f"SELECT * FROM {name}({said})").collect()
        assert sorted(map(tuple, by_sql)) == sorted(map(tuple, tools.TOOLS[name](lib, *args).collect())), (name, args)
    joined = spark.sql("SELECT c.year FROM lookup_section('8:08', '3') s JOIN library_citations x ON x.chapter_number = s.chapter JOIN library_cases c ON c.id = x.case_id WHERE s.place = 0")
    assert sorted(r[0] for r in joined.collect()) == [1999, 2001]


def test_schemas_describe_every_parameter():
    for told in tools.schemas():
        assert all(p["description"] and p["type"] in ("string", "integer") for p in told["function"]["parameters"]["properties"].values())
