"""Connected components and communities of a graph, in rounds of joins."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statvine.sources.shared import stash


#: Edges of a node from which its rows are dealt to ``SALTS`` tasks, and the most such nodes at once.
HUB, SALTS, MOST_HUBS = 1000, 64, 100_000
#: Rows, two numbers each, up to which a key stays in one task however many it has: all of them are few for it.
FEW = 100_000


def _with_least(rows: DataFrame, key: str, value: str, n_rows: int) -> DataFrame:
    """``rows`` with ``m``, the least ``value`` of their ``key``.

    A key of more than ``HUB`` rows is spread over ``SALTS`` tasks. The bar rises with the rows, so that at most ``MOST_HUBS``
    keys pass it, and these are broadcast. Up to ``FEW`` rows in all, none is spread.
    """
    if n_rows <= FEW:
        return rows.join(rows.groupBy(key).agg(F.min(value).alias("m")), key)
    bar = max(HUB, n_rows // MOST_HUBS)
    least = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("d"))
    hubs = F.broadcast(least.where(F.col("d") > bar).select(key, F.lit(True).alias("hub")))  # at most n_rows / bar
    salt = F.when(F.col("hub"), F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("d") > bar, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hubs, key, "left").withColumn("salt", salt).drop("hub")
    return dealt.join(least.select(key, "m", F.explode(salts).alias("salt")), [key, "salt"]).drop("salt")


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id, component (the least id reachable) of every node on an edge (source, target of one orderable type).

    Large and small stars take turns (Kiveris et al., 2014); loops and repeated edges change nothing, no edges give no
    rows. Each round is written to the shared folder; the driver sees two numbers a round. Nodes with many edges, as every
    component's least node in the end, are spread over several tasks.
    """
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct()
    pairs = edges.where("source <> target").select(F.greatest("source", "target").alias("a"), F.least("source", "target").alias("b")).distinct()
    pairs, before = stash(pairs, "components"), None
    for _ in range(most_rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            break
        before = state
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        known = _with_least(both, "u", "v", 2 * state["n"]).where("v > u").select("v", F.least("u", "m").alias("m"))
        large = known.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        joined = _with_least(large, "a", "b", 2 * state["n"])
        small = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = stash(small.distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    return ids.join(pairs.select(F.col("a").alias("id"), "b"), "id", "left").select("id", F.coalesce("b", "id").alias("component"))


#: Edges up to which a component is agglomerated in one task, pair by pair.
SMALL = 200_000


def agglomerated(edges: Iterable[tuple], twice: int) -> dict:
    """Each node's community (its least node) by joining, one after the other, the two whose union raises modularity most.

    edges: source, target, weight (whole numbers), each pair once; twice: twice the weight of the whole graph. Equal gains go to the smaller
    pair of communities, the first of which joins the second and takes its number; a union that changes nothing still counts.
    """
    near: dict = {}
    degree: dict = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
        near.setdefault(a, {})
        near.setdefault(b, {})
        if a != b:
            near[a][b] = near[b][a] = near[a].get(b, 0) + w
    number = {x: i for i, x in enumerate(sorted(near))}
    near = {number[x]: {number[y]: w for y, w in of.items()} for x, of in near.items()}
    degree = {number[x]: d for x, d in degree.items()}
    members = {i: [i] for i in near}
    age = dict.fromkeys(near, 0)
    entry = lambda a, b: (degree[a] * degree[b] - twice * near[a][b], min(a, b), max(a, b), age[min(a, b)], age[max(a, b)])
    heap = [entry(a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    while heap:
        loss, a, b, age_a, age_b = heapq.heappop(heap)
        if a not in near or b not in near or (age[a], age[b]) != (age_a, age_b):
            continue
        if loss > 0:
            break
        for x, w in near.pop(a).items():
            del near[x][a]
            if x != b:
                near[x][b] = near[b][x] = near[b].get(x, 0) + w
        degree[b] += degree[a]
        members[b] += members.pop(a)
        age[b] += 1
        for x in near[b]:
            heapq.heappush(heap, entry(b, x))
    names = sorted(number)
    return {names[i]: names[min(own)] for own in members.values() for i in own}


def communities(nodes: DataFrame, edges: DataFrame, small: int = SMALL) -> DataFrame:
    """id, community (its least id) of every node; edges are source, target and a whole-numbered weight, each pair once.

    Components are apart from each other, whatever joins. Those of at most ``small`` edges are agglomerated pair by pair, many
    one after the other in a task; larger ones by ``greedy_communities``. Nodes without edges are communities of their own, and so are ids that
    only edges name. Edges of no weight are left out.
    """
    known = stash(edges.where("source is not null and target is not null and weight > 0").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), F.col("weight").cast("long").alias("weight")), "communities")
    twice = 2 * (known.agg(F.sum("weight").alias("w")).first()["w"] or 0)
    parts = stash(connected_components(known), "communities")
    of = known.join(parts.select(F.col("id").alias("source"), "component"), "source")
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    placed = stash(of.join(sizes, "component"), "communities")
    few = placed.where(F.col("n") <= small).select("component", "source", "target", "weight").repartition("component").sortWithinPartitions("component")
    of_id = known.schema["source"].dataType.simpleString()
    from statvine.operators.vectorsearch import _arrow

    schema = f"id {of_id}, community {of_id}"
    arrow = _arrow(known.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def found() -> pa.RecordBatch:
            rows = agglomerated(held, twice)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip((rows.keys(), rows.values()), arrow)], schema=arrow)

        for batch in batches:
            for component, *edge in zip(*(batch[c].to_pylist() for c in ("component", "source", "target", "weight"))):
                if component != at:
                    if held:
                        yield found()
                    held, at = [], component
                held.append(edge)
        if held:
            yield found()

    result = few.mapInArrow(run, schema)
    many = placed.where(F.col("n") > small)
    if not many.isEmpty():
        result = result.unionByName(greedy_communities(many.select("source", "target", "weight"), twice=twice))
    result = stash(result, "communities")
    lone = nodes.select("id").where("id is not null").distinct().join(result, "id", "left_anti")
    return result.unionByName(lone.select("id", F.col("id").alias("community")))


def numbered(found: DataFrame) -> DataFrame:
    """cluster (from 0, the largest first, equal ones by least member), size, id of every member.

    Communities are counted within ranges of their order, and a range begins after the communities of those before it: no task sees them all.
    """
    sizes = found.groupBy("community").agg(F.count("*").alias("size")).repartitionByRange(F.desc("size"), "community")
    ranges = stash(sizes.withColumn("part", F.spark_partition_id()), "clusters")
    counts = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = [sum(n for p, n in counts.items() if p < part) for part in range(max(counts, default=0) + 1)]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "community")) - 1
    named = ranges.select("community", "size", (place + F.array(*(F.lit(b).cast("long") for b in before))[F.col("part")]).alias("cluster"))
    return found.join(named, "community").select("cluster", "size", "id")


def idea_edges(edges: DataFrame) -> DataFrame:
    """source, target, weight (ten-thousandths) of edges between ideas, each pair once: SEMANTIC by cosine, CROSS_REF as 1, which counts where both are."""
    inner = edges.where(F.col("source").startswith("idea:") & F.col("target").startswith("idea:") & F.col("type").isin("SEMANTIC", "CROSS_REF"))
    pair = inner.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), (F.col("type") == "CROSS_REF").alias("named"), F.round(F.coalesce("weight", F.lit(1.0)) * 10_000).cast("long").alias("weight"))
    return pair.where("source <> target").groupBy("source", "target").agg(F.max_by("weight", F.struct("named", "weight")).alias("weight"))


def greedy_communities(edges: DataFrame, most_rounds: int = 200, twice: int | None = None) -> DataFrame:
    """id, community (its least id) by greedy modularity; edges are source, target and a whole-numbered weight (long).

    twice: twice the weight of the whole graph, if ``edges`` are some of its components.

    Agglomeration by matching (Riedy et al., 2011): every community looks for the partner whose union raises modularity
    most. Where two choose each other they join, the smaller id as hub, and the hub also takes further suitors, best
    first, as long as each still pays with all suitors before it counted in. Every union raises modularity, and a star
    folds in one round. Repeated edges add up, loops count inside, gains are exact decimals, ties go to the smaller id.
    A round is three shuffles of the shrinking community graph and is written to the shared folder.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    ends = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    graph = edges.where("source is not null and target is not null and weight > 0").select(*ends, F.col("weight").cast("long").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    graph = stash(graph, "communities")
    twice = 2 * (graph.agg(F.sum("w").alias("w")).first()["w"] or 0) if twice is None else twice
    members = stash(graph.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("community", F.col("id")), "communities")
    for _ in range(most_rounds):
        degrees = graph.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("w")), F.struct(F.col("b").alias("c"), F.col("w")))).alias("x")).groupBy("x.c").agg(F.sum("x.w").alias("d"))
        sides = graph.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("p"), F.col("w")), F.struct(F.col("b").alias("c"), F.col("a").alias("p"), F.col("w")))).alias("x")).select("x.*")
        known = sides.join(degrees, "c").join(degrees.select(F.col("c").alias("p"), F.col("d").alias("pd")), "p")
        gain = exact(F.lit(twice)) * exact(F.col("w")) - exact(F.col("d")) * exact(F.col("pd"))
        nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("gain"), F.least("c", "p"), F.greatest("c", "p")))
        best = stash(known.withColumn("gain", gain).where("gain > 0").withColumn("nth", nth).where("nth = 1").drop("nth"), "communities")
        hubs = best.alias("x").join(best.alias("y"), (F.col("x.p") == F.col("y.c")) & (F.col("y.p") == F.col("x.c"))).where("x.c < x.p").select(F.col("x.c").alias("p"))
        before = Window.partitionBy("p").orderBy(F.desc("gain"), "c").rowsBetween(Window.unboundedPreceding, -1)
        paid = exact(F.lit(twice)) * exact(F.col("w")) - exact(F.col("d")) * (exact(F.col("pd")) + exact(F.coalesce(F.sum("d").over(before), F.lit(0))))
        joins = stash(best.join(hubs, "p", "left_semi").withColumn("paid", paid).where("paid > 0").select("c", F.col("p").alias("hub")), "communities")
        if joins.isEmpty():
            break
        moved = lambda df, c: df.join(joins.select(F.col("c").alias(c), "hub"), c, "left").withColumn(c, F.coalesce("hub", c)).drop("hub")
        members = stash(moved(members, "community"), "communities")
        ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        graph = stash(moved(moved(graph, "a"), "b").select(*ends, "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "communities")
    else:
        raise RuntimeError("communities did not settle")
    least = members.groupBy("community").agg(F.min("id").alias("least"))
    return members.join(least, "community").select("id", F.col("least").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, community)."""
    side = lambda c, name: communities.select(F.col("id").alias(c), F.col("community").alias(name))
    rows = edges.where("weight > 0").join(side("source", "s"), "source").join(side("target", "t"), "target").select("s", "t", "weight")
    ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("c"), "weight", (F.col("s") == F.col("t")).alias("inside")), F.struct(F.col("t").alias("c"), "weight", F.lit(False).alias("inside")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("weight").cast("double").alias("d"), F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0)).cast("double").alias("e"))
    total = sums.agg(F.sum("d").alias("two_m"), F.sum("e").alias("e"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return total.select((F.try_divide(2 * F.col("e"), F.col("two_m")) - F.try_divide(F.col("dd"), F.col("two_m") * F.col("two_m"))).alias("modularity"))


def ranked(communities: DataFrame) -> DataFrame:
    """community, size: the largest first, equal sizes by least member; one row a community."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "community")


def listed(communities: DataFrame) -> DataFrame:
    """community, size, id: a row for each member, as communities may be large."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    return communities.join(sizes, "community").select("community", "size", "id")
