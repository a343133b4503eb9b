"""Walks over the graph with a budget of nodes, their context, and the subgraph that is drawn.

A walk visits at most ``most`` nodes, so its order is kept on the driver; the neighbours of a whole level come from one
filtered, limited scan of the edges. Nodes: id, type, label, text. Edges: source, target, ordinal (any orderable column,
the order of edges).
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statvine.sources.shared import stash

#: Node types. Chapters are entered only from the last two. Fixed values.
FREE, TRANSIT, ENTRY = ("idea", "concept", "case"), "chapter", ("case", "concept")
MOST, DEPTH, CONTEXT = 40, 2, 900


def _kinds(nodes: DataFrame, ids: Iterable[str]) -> dict[str, str]:
    return {r["id"]: r["type"] for r in nodes.where(F.col("id").isin(list(ids))).select("id", "type").collect()}


def _near(nodes: DataFrame, edges: DataFrame, sources: list[str], kinds: dict[str, str]) -> DataFrame:
    """source, target, type, ordinal of the neighbours that may be entered, once each."""
    ahead = edges.where(F.col("source").isin(sources)).select("source", "target", "ordinal")
    back = edges.where(F.col("target").isin(sources)).select(F.col("target").alias("source"), F.col("source").alias("target"), "ordinal")
    once = ahead.unionByName(back).groupBy("source", "target").agg(F.min("ordinal").alias("ordinal"))
    opens = [s for s in sources if kinds.get(s) in ENTRY]
    may = F.col("type").isin(*FREE) | ((F.col("type") == TRANSIT) & F.col("source").isin(opens))
    return once.join(nodes.select(F.col("id").alias("target"), "type"), "target").where(may)


def breadth_first(nodes: DataFrame, edges: DataFrame, seeds: list[str], most: int = MOST) -> list[str]:
    """Ids in the order of a first-in, first-out walk; seeds come first, and depth is bounded by the budget alone."""
    found = list(dict.fromkeys(seeds))
    kinds, frontier = _kinds(nodes, found), found
    while frontier and len(found) < most:
        place = F.array_position(F.array(*map(F.lit, frontier)), F.col("source"))
        rows = _near(nodes, edges, frontier, kinds).where(~F.col("target").isin(found)).withColumn("place", place)
        first = F.row_number().over(Window.partitionBy("target").orderBy("place", "ordinal"))
        new = rows.withColumn("nth", first).where("nth = 1").orderBy("place", "ordinal", "target").limit(most - len(found)).select("target", "type").collect()
        kinds |= {r["target"]: r["type"] for r in new}
        frontier = [r["target"] for r in new]
        found = found + frontier
    return found[:most]


def depth_first(nodes: DataFrame, edges: DataFrame, seeds: list[str], depth: int = DEPTH, most: int = MOST) -> list[str]:
    """Ids in preorder, at most ``depth`` steps below a seed; a node seen once is never entered again.

    A node's first ``most`` neighbours suffice: when all of them are seen, the budget is spent. So one scan a level
    brings at most ``most`` rows a node.
    """
    seeds = list(dict.fromkeys(seeds))[:most]
    kinds, below, level = _kinds(nodes, seeds), {}, seeds
    for _ in range(depth):
        level = [x for x in dict.fromkeys(level) if x not in below]
        if not level:
            break
        nth = F.row_number().over(Window.partitionBy("source").orderBy("ordinal", "target"))
        rows = _near(nodes, edges, level, kinds).withColumn("nth", nth).where(F.col("nth") <= most).collect()
        below |= {x: [] for x in level}
        for r in sorted(rows, key=lambda r: r["nth"]):
            below[r["source"]].append(r["target"])
            kinds[r["target"]] = r["type"]
        level = [y for x in level for y in below[x]]
    seen: dict[str, None] = {}
    stack = [(s, 0) for s in reversed(seeds)]
    while stack and len(seen) < most:
        node, steps = stack.pop()
        if node not in seen:
            seen[node] = None
            stack += [(y, steps + 1) for y in reversed(below.get(node, []))] if steps < depth else []
    return list(seen)


def _openings(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """source, target, nth: of each node the first ``most`` neighbours that may be entered from it, in both directions, once each."""
    both = edges.select("source", "target", "ordinal").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "ordinal"))
    once = both.groupBy("source", "target").agg(F.min("ordinal").alias("ordinal"))
    kinds = nodes.select("id", "type")
    typed = once.join(kinds.select(F.col("id").alias("target"), "type"), "target").join(kinds.select(F.col("id").alias("source"), F.col("type").alias("from")), "source", "left")
    may = F.col("type").isin(*FREE) | ((F.col("type") == TRANSIT) & F.coalesce(F.col("from").isin(*ENTRY), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("ordinal", "target"))
    return typed.where(may).withColumn("nth", nth).where(F.col("nth") <= most).select("source", "target", "nth")


def _numbered(seeds: DataFrame, most: int) -> DataFrame:
    """query, id, place of the first ``most`` different seeds of each query."""
    once = seeds.groupBy("query", "id").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("place", "id")) - 1
    return once.withColumn("place", nth).where(F.col("place") < most)


def breadth_first_each(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, most: int = MOST) -> DataFrame:
    """query, id, place: the walk ``breadth_first`` of every query at once; seeds are query, place, id.

    A round moves all frontiers by one step. Each node's first ``2 * most`` openings suffice, as at most ``most`` of them are visited and no
    more are wanted, so they are kept once for all rounds, and no hub brings more. A new node's key is its parent's place and the number of the
    opening; the least key stands for it, and the keys' order continues the query's places. Rounds end when no budget and frontier is left.
    """
    near = stash(_openings(nodes, edges, 2 * most), "openings")
    frontier = stash(_numbered(seeds, most), "walks")
    found = frontier
    for _ in range(most):
        held = found.groupBy("query").agg(F.count("*").alias("held")).where(F.col("held") < most)
        steps = frontier.join(held, "query").join(near, frontier["id"] == near["source"]).select("query", F.col("target").alias("id"), F.struct("place", "nth").alias("key"), "held")
        new = steps.groupBy("query", "id").agg(F.min("key").alias("key"), F.first("held").alias("held")).join(found, ["query", "id"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query").orderBy("key", "id")) - 1 + F.col("held")
        frontier = stash(new.withColumn("place", place.cast("int")).where(F.col("place") < most).select("query", "id", "place"), "walks")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def depth_first_each(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """query, id, place: the walk ``depth_first`` of every query at once.

    Each node's first ``most`` openings suffice; what lies within ``depth`` steps comes from a join a step, and a query's own, at
    most ``most`` to the power ``depth + 1`` rows, is put in order in one task.
    """
    near = stash(_openings(nodes, edges, most), "openings")
    starts = stash(_numbered(seeds, most), "walks")
    level = starts.select("query", F.col("id").alias("source")).distinct()
    below = None
    for _ in range(depth):
        step = stash(level.join(near, "source").select("query", "source", "target", "nth"), "walks")
        below = step if below is None else below.unionByName(step)
        level = step.select("query", F.col("target").alias("source")).distinct()
    rows = starts.select("query", F.lit(None).cast("string").alias("source"), F.col("id").alias("target"), F.col("place").alias("nth"))
    rows = rows if below is None else rows.unionByName(below.distinct())
    of_query = seeds.schema["query"].dataType.simpleString()

    def walk(t: pa.Table) -> pa.Table:
        own: dict[str | None, list[str]] = {}
        for r in t.sort_by("nth").select(["source", "target"]).to_pylist():
            own.setdefault(r["source"], []).append(r["target"])
        seen: dict[str, None] = {}
        stack = [(s, 0) for s in reversed(own.get(None, []))]
        while stack and len(seen) < most:
            node, steps = stack.pop()
            if node not in seen:
                seen[node] = None
                stack += [(y, steps + 1) for y in reversed(own.get(node, []))] if steps < depth else []
        query = t["query"].combine_chunks().take(pa.array([0] * len(seen), pa.int64()))
        return pa.table([query, pa.array(list(seen), pa.string()), pa.array(range(len(seen)), pa.int32())], names=["query", "id", "place"])

    return rows.groupBy("query").applyInArrow(walk, f"query {of_query}, id string, place int")


def context_each(nodes: DataFrame, walks: DataFrame, most: int = CONTEXT) -> DataFrame:
    """query, place, id, type, label and the beginning of the text of visited nodes; ids without a node are left out."""
    text = F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text")
    return walks.join(nodes.select("id", "type", "label", text), "id").select("query", "place", "id", "type", "label", "text")


def context(nodes: DataFrame, visited: list[str], most: int = CONTEXT) -> DataFrame:
    """place, id, type, label and the beginning of the text of visited nodes; ids without a node are left out."""
    walk = nodes.sparkSession.createDataFrame(list(enumerate(visited)), "place long, id string")
    text = F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text")
    return nodes.where(F.col("id").isin(visited)).join(F.broadcast(walk), "id").select("place", "id", "type", "label", text)  # a row a visited node


def drawn_nodes(nodes: DataFrame, edges: DataFrame, concepts: int = 30, most: int = 400) -> DataFrame:
    """The nodes that are drawn: the concepts with most ideas, then the others by degree. Nodes here carry n_ideas."""
    from statvine.operators.graph import degree

    top = nodes.where("type = 'concept'").orderBy(F.desc("n_ideas"), "id").limit(concepts).select("id", F.lit(1).alias("top"))
    ranked = nodes.join(degree(edges), "id", "left").join(top, "id", "left").fillna(0, ["degree", "top"])
    return ranked.orderBy(F.desc("top"), F.desc("degree"), "id").limit(most).drop("top")


def drawn_edges(edges: DataFrame, chosen: DataFrame, most: int = 2500) -> DataFrame:
    """The first edges between drawn nodes, without those that only say which chapter an idea is part of."""
    ids = chosen.select("id")
    kept = edges.where("type <> 'PART_OF'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.orderBy("ordinal").limit(most)
