"""The text graph, similar vectors, search and sinks on literal rows."""

import datetime
import os
import random

import numpy as np
import pytest

from statvine.operators import casework, graph, search, similarity
from statvine.operators.textindex import TextIndex
from statvine.sources import files
from statvine.sources.shared import scratch, stash

DAY = datetime.date
CHUNKS = "chunk_id long, chapter_number string, section_ref string, heading string, chunk_text string, as_at_date date, download_id long, version_label string"


@pytest.fixture(scope="module")
def ideas(spark):
    rows = [
        (1, "8:08", "1", "Terms", "old text without terms", DAY(2000, 1, 1), 1, "a"),
        (2, "8:08", "1", "Terms", "\u201cDebtor\u201d means one who owes. The expression\"Public Officer\" is wide. Debtor: see section 2 and section 9, Cap. 9:01, Ch. 9:01 and Chap. 77:7", DAY(2010, 1, 1), 2, "b"),
        (3, "8:08", "2", "", "every Debtor shall pay", DAY(2010, 1, 1), 2, "b"),
        (4, "8:08", "3", "", "Debtors and xDebtor and a Debtor-like", DAY(2010, 1, 1), 2, "b"),
        (5, "9:01", "1", "Undated", "short", None, 3, ""),
        (6, "9:01", "1", "Undated", "\"Debtor\" means another; expression\"Public Officer\"; section 1", None, 4, ""),
        (7, "9:01", "2", "", "the Public Officer, and (Debtor)", DAY(2011, 1, 1), 5, None),
    ]
    return graph.ideas(spark.createDataFrame(rows, CHUNKS))


@pytest.fixture(scope="module")
def chapters(spark):
    return spark.createDataFrame([("8:08", "Absconding Debtors"), ("9:01", "Public Officers")], "chapter_number string, title string")


def test_ideas(ideas):
    got = {r["id"]: r for r in ideas.collect()}
    assert set(got) == {"idea:8:08|1", "idea:8:08|2", "idea:8:08|3", "idea:9:01|1", "idea:9:01|2"}
    assert (got["idea:8:08|1"]["chunk_id"], got["idea:8:08|1"]["label"], got["idea:8:08|1"]["n_versions"]) == (2, "8:08 1 Terms", 2)
    assert got["idea:8:08|1"]["dates"] == [DAY(2000, 1, 1), DAY(2010, 1, 1)] and got["idea:9:01|1"]["dates"] == []
    assert got["idea:9:01|1"]["chunk_id"] == 6  # undated: the longest


def test_mentions_lead_from_ideas_to_concepts(ideas):
    concepts = graph.concepts(ideas)
    assert {r["term"]: (r["n_chapters"], r["n_ideas"]) for r in concepts.collect()} == {"Debtor": (2, 2), "Public Officer": (2, 2)}
    got = {(r["source"], r["target"], r["evidence"]) for r in graph.mentions(ideas, concepts).collect()}
    named = [("8:08|1", "Debtor"), ("9:01|1", "Debtor"), ("8:08|2", "Debtor"), ("8:08|1", "Public Officer"), ("9:01|1", "Public Officer"), ("9:01|2", "Public Officer")]
    assert got == {(f"idea:{i}", f"concept:{c}", "EXTRACTED") for i, c in named}


def test_references_and_dangling_edges(spark, ideas, chapters):
    known = graph.chapter_references(ideas, chapters)
    assert sorted((r["source"], r["target"], r["detail"]) for r in known.collect()) == [("idea:8:08|1", "chapter:9:01", "Cap. 9:01"), ("idea:8:08|1", "chapter:9:01", "Ch. 9:01")]
    assert [(r["source"], r["target"], r["detail"]) for r in graph.section_references(ideas).collect()] == [("idea:8:08|1", "idea:8:08|2", "section 2")]
    nodes = ideas.select("id").unionByName(chapters.selectExpr("concat('chapter:', chapter_number) as id"))
    graph.require_whole(nodes, known)
    loose = graph.chapter_references(ideas)
    assert [r["target"] for r in graph.dangling(nodes, loose).collect()] == ["chapter:77:7"]
    with pytest.raises(ValueError, match="77:7"):
        graph.require_whole(nodes, loose)


def test_statements_and_sinks(spark, ideas, chapters, tmp_path):
    nodes = chapters.selectExpr("concat('chapter:', chapter_number) as id", "'chapter' as type", "title as label").unionByName(ideas.selectExpr("id", "'idea' as type", "'a \"b\" \\\\c' as label"))
    edges = graph.part_of(ideas)
    said = [r["statement"] for r in graph.cypher(nodes, edges, most=4).orderBy("kind", "statement").collect()]
    assert len(said) == 2 + 2 + 2 and 'CREATE (n:`IDEA` {id:"idea:8:08|1", label:"a \'b\'  c"});' in said
    assert 'MATCH (a {id:"chapter:8:08"}),(b {id:"idea:8:08|2"}) CREATE (a)-[:PART_OF {evidence:"EXTRACTED"}]->(b);' in said
    for form in ("parquet", "json"):
        files.write_graph(nodes, edges, str(tmp_path / form), form)
        back = files.read_graph(spark, str(tmp_path / form), form)
        assert (back[0].count(), back[1].count()) == (7, 5) and graph.dangling(*back).isEmpty()
    with pytest.raises(ValueError):
        files.write_graph(nodes.limit(1), edges, str(tmp_path / "broken"))
    assert not os.path.exists(tmp_path / "broken")
    assert {(r["what"], r["type"]): r["n"] for r in graph.audit(nodes, edges).collect()} == {("node", "chapter"): 2, ("node", "idea"): 5, ("edge", "PART_OF"): 5, ("evidence", "EXTRACTED"): 5}
    files.write_clusters(spark.createDataFrame([(1, 2, 1), (1, 2, 5)], "community long, size long, id long"), graph.audit(nodes, edges), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c" / "clusters")).count() == 2


def test_case_edges_once_a_method(spark, chapters, tmp_path):
    texts = spark.createDataFrame([("1", "by Cap. 8:08, Chap. 8:08 and the Public Officers Act"), ("2", "under the Act, 9:01 says; at 8:08 nothing is said of it in more than forty letters: 8:08"), ("3", "none")], "case_id string, text string")
    edges = casework.case_edges(texts, chapters)
    got = sorted((r["source"], r["target"], r["method"], r["confidence"], r["detail"]) for r in edges.collect())
    assert got == [
        ("case:1", "chapter:8:08", "REGEX", "medium", "Ch. 8:08"), ("case:1", "chapter:9:01", "TITLE_MATCH", "high", "the Public Officers Act"),
        ("case:2", "chapter:8:08", "REGEX", "medium", "8:08"), ("case:2", "chapter:9:01", "REGEX", "medium", "9:01"),
    ]
    told = {(r["what"], r["name"]): r["n"] for r in casework.report(texts, edges).collect()}
    assert told["cases_loaded", ""] == 3 and told["case_nodes", ""] == 2 and told["confidence", "high"] == 1 and told["target", "chapter:8:08"] == 2
    files.write_case_edges(edges, casework.report(texts, edges), str(tmp_path / "cases"))
    assert spark.read.json(str(tmp_path / "cases" / "edges")).count() == 4


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_vectors(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 5)).round(1)
    vectors[10:14] = vectors[10]  # ties
    rows = [(f"v{i:02}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None), ("zero", [0.0] * 5)]
    got = sorted((r["source"], r["target"]) for r in similarity.nearest(spark.createDataFrame(rows, "id string, embedding array<double>"), 4, 0.5, block).collect())
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    expected = []
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), -sims[i])) if j != i][:4]
        expected += [(f"v{i:02}", f"v{j:02}") for j in order if j > i and sims[i, j] >= 0.5]
    differ = set(got) ^ set(expected)
    assert len(got) == len(expected) and all(10 <= int(b[1:]) < 14 for _, b in differ)  # equal sums may differ in the last digit


def test_full_text_by_scan_and_index(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["debtor", "pay", "the", "Act", "officer"], k=rnd.randint(0, 9)))) for i in range(60)] + [(100, None), (101, "Pay, DEBTOR! pay")]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_text string")
    index = TextIndex.build(chunks.repartition(4))
    for query in ("debtor pay", "the", "debtor nowhere", "", "Pay pay DEBTOR act officer"):
        scan = sorted(map(tuple, search.fts(chunks, query).collect()))
        assert sorted(map(tuple, index.fts(query).collect())) == scan
        words = search.wanted(query)
        held = [i for i, t in rows if words and all(w in (t or "").lower().replace(",", " ").replace("!", " ").split() for w in words)]
        assert [i for i, _ in scan] == held


def test_hits_by_provision(spark, chapters):
    rows = [(n, "8:08", "1", "Pay", f"debtor {n}", DAY(2000 + n, 1, 1), n, "v") for n in (1, 2, 3)] + [(9, "9:01", "4", None, "debtor debtor", None, 9, None)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    got = {r["key"]: r for r in search.grouped(chunks, search.fts(chunks, "debtor"), None, chapters).collect()}
    hit = got["8:08::1"]
    assert hit["title"] == "Absconding Debtors" and hit["heading"] == "Pay" and hit["matched_version"]["chunk_text"] == "debtor 3" and hit["matched_version"]["pdf_url"] == "/api/pdf/3"
    assert [v["download_id"] for v in hit["versions"]] == [3, 2, 1] and hit["latest_available"]["version_label"] == "v"
    assert got["9:01::4"]["latest_available"] is None and got["9:01::4"]["matched_version"]["version_label"] == ""
    old = {r["key"]: r for r in search.grouped(chunks, search.fts(chunks, "debtor"), "2002-06-01", chapters).collect()}
    assert list(old) == ["8:08::1"] and [v["download_id"] for v in old["8:08::1"]["versions"]] == [2, 1]


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, 5, "so one two three four five six seven eight nine ten eleven end"), (2, 5, "xone twox"), (3, 5, "a two three b")], "doc_id long, n_chars long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "one two"), (3, "two three"), (4, "wo three fou"), (5, "absent words here")], "item_id long, passage string")
    assert sorted((r["item_id"], r["doc_id"]) for r in search.holding(docs, items).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 3), (4, 1)]


def test_scratch_is_removed(spark):
    with scratch(spark):
        kept = stash(spark.range(3), "gone")
        (path,) = {os.path.dirname(f.removeprefix("file://")) for f in kept.inputFiles()}
        assert kept.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_bare_numbers_as_sql_takes_them(spark, tmp_path):
    import duckdb

    from statvine.plans.all import ORACLES, QUERIES

    texts = ["ch " + "x" * n + " 1:05" for n in range(26, 37)] + [" act", "Act 1:05, 1:06 and cap 1:07 1:08", "chapter\n1:05", "éch. 1:05 pact 1:06 éact 1:07", "act é1:05é 1:06", "_act 1:05", "act 1:05:06", "ordinance 1:051 1:06", "Ch.\u000b1:05", "cap \U0001f600" * 9 + "1:09", None, ""]
    spark.createDataFrame([(i, t, "web", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 3000).selectExpr("id as p_partkey", "'x' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    ours = sorted(map(tuple, QUERIES["cites_bare_regex"](spark, str(tmp_path)).select("chunk_id", "chapter", "confidence", "method").collect()))
    assert ours == sorted(con.execute(ORACLES["cites_bare_regex"]).fetchall()) and len(ours) > len(texts)


def plain_nearest(ids, vectors, top, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -2)
    order = [np.lexsort((np.arange(len(ids)), -s))[:top] for s in sims]
    return sorted((ids[i], ids[j]) for i, near in enumerate(order) for j in near if j > i and sims[i, j] >= least)


def test_nearest_of_copies_is_spread_from_the_first(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 5))
    for first, copies in ((3, range(20, 30)), (7, range(40, 44)), (8, [50]), (60, range(61, 65))):
        vectors[list(copies)] = vectors[first]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100 + i, [0.0] * 5) for i in range(3)] + [(110, [float("inf")] * 5), (111, [float("inf")] * 5), (112, [float("nan")] * 5), (113, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    met = []
    between = similarity._between_blocks
    monkeypatch.setattr(similarity, "_between_blocks", lambda df, n, *rest: met.append(n) or between(df, n, *rest))
    for block in (2048, 7):
        got = sorted((r["source"], r["target"]) for r in similarity.nearest(df, 4, 0.2, block).collect())
        assert got == plain_nearest(list(range(90)), vectors, 4, 0.2)
    assert met == [71, 71]  # copies don't meet one by one


@pytest.mark.parametrize("crowded", [32, 0])
def test_tiles_leave_out_only_what_is_not_near(monkeypatch, crowded):
    """Near copies, whose similarities floats don't tell apart, and the rest; small tiles, so bars rise in between."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 8))
    vectors[50:150] = vectors[50] + 1e-7 * rng.normal(size=(100, 8))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    monkeypatch.setattr(similarity, "TILE", 24)
    monkeypatch.setattr(similarity, "CROWDED", crowded)
    for a, b, same in ((unit[:210], unit[210:], False), (unit, unit, True), (unit[:100], unit[100:], False)):
        sims = sum(x[:, None] * y[None, :] for x, y in zip(a.T, b.T))
        sims = np.minimum(sims, 1)
        if same:
            np.fill_diagonal(sims, -2)
        for (at, other, _), of in zip(similarity._between(a, b, same, 5, -1.0), (sims, sims.T)):
            expected = {(i, j) for i, s in enumerate(of) for j in np.lexsort((np.arange(len(s)), -s))[:5]}
            assert set(zip(at.tolist(), other.tolist())) == expected
