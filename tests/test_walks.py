"""Walks, components, communities and names against plain versions on small graphs."""

import random

import pytest

from statvine.operators import casework, communities, walks
from statvine.plans.all import QUERIES

NODES = "id string, type string, label string, text string"
EDGES = "source string, target string, ordinal long"


@pytest.fixture(scope="module")
def law(spark):
    dice = random.Random(7)
    kind = {f"n{i}": dice.choice(["idea", "idea", "concept", "case", "chapter", "note"]) for i in range(60)}
    edges = [(f"n{dice.randrange(62)}", f"n{dice.randrange(62)}", i) for i in range(150)]
    nodes = spark.createDataFrame([(k, t, k.upper(), None if k == "n1" else "x" * 1000) for k, t in kind.items()], NODES).cache()
    return kind, edges, nodes, spark.createDataFrame(edges, EDGES).cache()


def steps(kind, edges, node):
    near = [(o, t) for s, t, o in edges if s == node] + [(o, s) for s, t, o in edges if t == node]
    for _, other in sorted(near):
        if kind.get(other) in ("idea", "concept", "case") or (kind.get(other) == "chapter" and kind.get(node) in ("case", "concept")):
            yield other


@pytest.mark.parametrize("most", [1, 7, 40, 400])
def test_breadth_first(law, most):
    kind, edges, nodes, frame = law
    seeds = ["n3", "n4", "n3", "gone"]
    found = ["n3", "n4", "gone"]
    for node in found:
        for other in steps(kind, edges, node):
            if other not in found and len(found) < most:
                found.append(other)
    got = walks.breadth_first(nodes, frame, seeds, most)
    assert got == found[:most]
    rows = walks.context(nodes, got).orderBy("place").collect()
    assert [r["id"] for r in rows] == [x for x in got if x in kind] and all(len(r["text"]) in (0, 900) for r in rows)


@pytest.mark.parametrize("depth,most", [(0, 40), (2, 5), (2, 40), (3, 400)])
def test_depth_first(law, depth, most):
    kind, edges, nodes, frame = law
    seen = []

    def go(node, level):
        if node in seen or len(seen) >= most:
            return
        seen.append(node)
        if level < depth:
            for other in steps(kind, edges, node):
                go(other, level + 1)

    for seed in ("n3", "n4", "n5"):
        go(seed, 0)
    assert walks.depth_first(nodes, frame, ["n3", "n4", "n5"], depth, most) == seen


def test_walks_without_edges(law, spark):
    none = spark.createDataFrame([], EDGES)
    assert walks.breadth_first(law[2], none, ["n3"]) == ["n3"] and walks.depth_first(law[2], none, ["n3"]) == ["n3"]


def weighed(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, weight long")


def test_communities_find_cliques(spark):
    cliques = [(c * 5 + i, c * 5 + j, 10) for c in range(4) for i in range(5) for j in range(i)]
    edges = weighed(spark, cliques + [(4, 5, 1), (9, 10, 1), (14, 15, 1), (30, 30, 3), (None, 1, 5)])
    found = communities.greedy_communities(edges)
    assert sorted(map(tuple, found.collect())) == [(i, i // 5 * 5) for i in range(20)] + [(30, 30)]
    assert communities.modularity(edges, found).first()[0] == pytest.approx(plain_modularity(edges.collect(), dict(map(tuple, found.collect()))))
    sizes = [tuple(r) for r in communities.ranked(found).collect()]
    assert sizes == [(0, 5), (5, 5), (10, 5), (15, 5), (30, 1)]


def plain_modularity(edges, part):
    edges = [(a, b, w) for a, b, w in edges if a is not None]
    m = sum(w for *_, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0) + w
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0) + w
    return sum(inside.get(c, 0) / m - (degree[c] / 2 / m) ** 2 for c in degree)


def test_star_folds_at_once_and_nothing_gives_nothing(spark):
    star = weighed(spark, [(0, i, 1) for i in range(1, 30)])
    found = communities.greedy_communities(star, most_rounds=8)
    assert found.where("community = 0").count() == found.count() == 30
    assert communities.greedy_communities(weighed(spark, [])).count() == 0
    assert communities.connected_components(weighed(spark, [])).count() == 0


def test_random_unions_beat_singletons(spark):
    dice = random.Random(3)
    rows = [(dice.randrange(40), dice.randrange(40), dice.randrange(1, 9)) for _ in range(90)]
    part = dict(map(tuple, communities.greedy_communities(weighed(spark, rows)).collect()))
    assert all(part[c] == c and c <= x for x, c in part.items())
    assert plain_modularity(rows, part) > 0.3 > plain_modularity(rows, {x: x for x in part})


def test_components_with_loops(spark):
    edges = weighed(spark, [(3, 2, 1), (2, 1, 1), (9, 9, 1), (7, 8, 1), (8, 7, 1)])
    assert sorted(map(tuple, communities.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]


def test_components_of_a_star_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(communities, "HUB", 20)
    monkeypatch.setattr(communities, "FEW", 0)
    rnd = random.Random(8)
    edges = [(900, i) for i in range(100, 400)] + [(i, 500 + i) for i in range(100, 400, 3)] + [(2000 + i, 2001 + i) for i in range(0, 60)] + [(rnd.randrange(5000, 5400), rnd.randrange(5000, 5400)) for _ in range(300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = communities.connected_components(spark.createDataFrame(edges, "source long, target long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


def test_names_meet_titles(spark):
    titles = [("1:01", "Income Tax"), ("1:02", "Road Traffic"), ("1:03", "Road Traffic"), ("1:04", ""), ("1:05", "Ox"), ("1:06", None)]
    texts = [("a", "under the Income Tax Act"), ("b", "THE Road Traffic Ordinance and the Income Tax Regulations"), ("c", "the Special Road Traffic Act"), ("d", "the Income Act"), ("e", "the Box Act"), ("f", None)]
    got = casework.title_citations(spark.createDataFrame(texts, "case_id string, text string"), spark.createDataFrame(titles, "chapter_number string, title string"))
    assert sorted((r["case_id"], r["target"], r["confidence"]) for r in got.collect()) == [
        ("a", "chapter:1:01", "high"), ("b", "chapter:1:01", "high"), ("b", "chapter:1:02", "low"), ("b", "chapter:1:03", "low"),
        ("c", "chapter:1:02", "low"), ("c", "chapter:1:03", "low"), ("d", "chapter:1:01", "high")]


def test_retrieved_context(spark, data):
    rows = QUERIES["graph_retrieve"](spark, data).orderBy("place").collect()
    seeds = [f"idea:{r[0]}" for r in QUERIES["vector_seed"](spark, data).collect()]
    assert [r["id"] for r in rows[:10]] == seeds and len({r["id"] for r in rows}) == len(rows) <= 40


def test_components_run_their_edges_once(spark, monkeypatch, data):
    from statvine.plans import walks as plans

    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "source long, target long").coalesce(1).mapInArrow(counted, "source long, target long")
    monkeypatch.setattr(plans, "semantic_topk_edges", lambda *_: edges)
    got = sorted(map(tuple, plans.connected_components(spark, data).collect()))
    assert got == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert rows.value == 3
