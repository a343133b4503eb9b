"""Many walks and searches at once against single ones and brute force; communities against pair-by-pair unions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statvine.operators import communities, walks
from statvine.operators.vectorsearch import Cells
from tests.test_walks import EDGES, NODES, law, plain_modularity, weighed  # noqa: F401


@pytest.fixture(scope="module")
def seeds(spark):
    dice = random.Random(1)
    rows = [(q, i, f"n{dice.randrange(62)}" if q % 9 else "gone") for q in range(120) for i in range(dice.randrange(1, 4))]
    rows += [(3, 0, "n5"), (3, 9, "n5"), (200, 0, None)]
    return [r for r in rows if r[2]], spark.createDataFrame([r for r in rows if r[2]], "query long, place int, id string")


def of_query(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query"], r["place"])):
        found.setdefault(r["query"], []).append(r["id"])
    return found


@pytest.mark.parametrize("most", [3, 12, 40])
def test_many_walks_are_the_single_ones(law, seeds, most):  # noqa: F811
    _, _, nodes, edges = law
    wide, deep = of_query(walks.breadth_first_each(nodes, edges, seeds[1], most).collect()), of_query(walks.depth_first_each(nodes, edges, seeds[1], 2, most).collect())
    own = {}
    for q, place, x in sorted(seeds[0]):
        own.setdefault(q, []).append(x)
    assert set(wide) == set(deep) == set(own)
    for q in list(own)[::12]:
        assert wide[q] == walks.breadth_first(nodes, edges, own[q], most) and deep[q] == walks.depth_first(nodes, edges, own[q], 2, most)
    assert all(len(x) <= most for x in [*wide.values(), *deep.values()])


def test_walks_along_a_hub(spark):
    nodes = spark.createDataFrame([("hub", "idea", "", "")] + [(f"i{i:03}", "idea", "", "") for i in range(300)], NODES)
    edges = spark.createDataFrame([("hub", f"i{i:03}", i) for i in range(300)] + [("i299", "i000", 999)], EDGES)
    starts = spark.createDataFrame([(q, 0, f"i{q:03}") for q in range(30)], "query long, place int, id string")
    got = of_query(walks.breadth_first_each(nodes, edges, starts, 10).collect())
    assert got[5] == ["i005", "hub"] + [f"i{i:03}" for i in range(9) if i != 5] and len(got) == 30
    assert walks.context_each(nodes, walks.breadth_first_each(nodes, edges, starts, 2)).count() == 60


@pytest.mark.parametrize("clustered", [True, False])
def test_cells_find_what_a_scan_finds(spark, clustered):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * (6 if clustered else 0)
    rows = [(i, (middles[i % 12] + rng.normal(size=16)).round(2).tolist()) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(5)] + [(700, [0.0] * 16), (701, None), (702, [2 * x for x in rows[0][1]])]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    cells = Cells.build(frame, n_cells=12)
    real = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and any(v)]
    ids, v = np.array([i for i, _ in real]), np.array([x for _, x in real])
    asked = [(0, rows[0][1]), (1, rows[17][1]), (2, (-np.array(rows[3][1])).tolist()), (3, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "query long, embedding array<double>")
    found, read = cells.search(queries, 7)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["id"])
    for q, x in asked[:3]:
        sims = np.round(v @ (np.array(x) / np.linalg.norm(x)), 9)
        assert got[q] == ids[np.lexsort((ids, -sims))][:7].tolist()
    assert 3 not in got
    share = {r["query"]: r["read"] for r in read.collect()}
    assert max(share.values()) <= 1.0 and (not clustered or share[0] < 0.5)
    aims = [(q, x, t) for q, (_, x) in enumerate(asked[:3]) for t in (44,)] + [(9, rows[0][1], 12345)]
    ranks = cells.ranks(spark.createDataFrame(aims, "query long, embedding array<double>, target long")).collect()
    want = {}
    for q, x, t in aims[:3]:
        sims = np.round(v @ (np.array(x) / np.linalg.norm(x)), 9)
        want[q] = ids[np.lexsort((ids, -sims))].tolist().index(t) + 1
    assert {r["query"]: r["rank"] for r in ranks} == want
    assert cells.search(queries, 10_000)[0].where("query = 0").count() == len(ids)


def test_cells_of_nothing(spark):
    cells = Cells.build(spark.createDataFrame([(1, None)], "id long, embedding array<double>"))
    found, _ = cells.search(spark.createDataFrame([(1, [1.0, 2.0])], "query long, embedding array<double>"), 3)
    assert found.count() == 0


def one_by_one(edges, twice):
    """The plainest form: look at all pairs, join the best, again and again."""
    near, degree, label = {}, {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[x] = degree.get(x, 0) + w
            label[x] = x
        if a != b:
            near[a, b] = near.get((a, b), 0) + w
    order = sorted(label)
    near = {(order.index(min(p)), order.index(max(p))): w for p, w in near.items()}
    degree = {order.index(x): d for x, d in degree.items()}
    label = {order.index(x): order.index(x) for x in label}
    while near:
        gain, a, b = min((degree[a] * degree[b] - twice * w, a, b) for (a, b), w in near.items())
        if gain > 0:
            break
        moved = {}
        for (x, y), w in near.items():
            x, y = (b if x == a else x), (b if y == a else y)
            if x != y:
                moved[min(x, y), max(x, y)] = moved.get((min(x, y), max(x, y)), 0) + w
        near = moved
        degree[b] += degree.pop(a)
        label = {x: b if own == a else own for x, own in label.items()}
    least = {}
    for x in sorted(label):
        least.setdefault(label[x], x)
    return {order[x]: order[least[own]] for x, own in label.items()}


@pytest.mark.parametrize("seed", range(4))
def test_small_components_join_pair_by_pair(spark, seed):
    dice = random.Random(seed)
    pairs = {}
    for part in range(6):
        for _ in range(dice.randrange(1, 60)):
            a, b = sorted(dice.sample(range(part * 30, part * 30 + 25), 2))
            pairs[a, b] = dice.choice([1, 1, 1, 5, dice.randrange(1, 9)])
    rows = [(a, b, w) for (a, b), w in pairs.items()] + [(500, 500, 3)]
    want = one_by_one(rows, 2 * sum(w for *_, w in rows))
    nodes = spark.createDataFrame([(x,) for x in [*range(180), 900, None]], "id long")
    got = dict(map(tuple, communities.communities(nodes, weighed(spark, rows)).collect()))
    assert {x: c for x, c in got.items() if x in want} == want
    assert all(got[x] == x for x in range(180) if x not in want) and got[900] == 900 and None not in got
    # all components as large ones: the whole graph's weight counts there too
    large = dict(map(tuple, communities.communities(nodes, weighed(spark, rows), small=0).collect()))
    assert set(large) == set(got) and plain_modularity(rows, large) > 0.6 * plain_modularity(rows, got)


def test_clusters_are_numbered_by_size(spark):
    found = spark.createDataFrame([(i, c) for c, n in ((0, 2), (10, 5), (20, 2), (30, 1), (40, 1)) for i in range(c, c + n)], "id long, community long")
    got = communities.numbered(found).collect()
    assert sorted({(r["cluster"], r["size"], min(x["id"] for x in got if x["cluster"] == r["cluster"])) for r in got}) == [(0, 5, 10), (1, 2, 0), (2, 2, 20), (3, 1, 30), (4, 1, 40)]
    assert len(got) == 11 and communities.numbered(found.where("false")).count() == 0


def test_named_references_outweigh_likeness(spark):
    rows = [("idea:b", "idea:a", "SEMANTIC", 0.61234), ("idea:a", "idea:b", "CROSS_REF", None), ("idea:a", "idea:c", "SEMANTIC", 0.7), ("idea:a", "chapter:1", "CROSS_REF", None), ("idea:a", "idea:a", "CROSS_REF", None), ("idea:c", "idea:d", "PART_OF", 0.9)]
    got = communities.idea_edges(spark.createDataFrame(rows, "source string, target string, type string, weight double"))
    assert sorted(map(tuple, got.collect())) == [("idea:a", "idea:b", 10_000), ("idea:a", "idea:c", 7_000)]
    assert got.where(F.col("weight").isNull()).count() == 0
