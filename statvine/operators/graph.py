"""Nodes and edges drawn from chunks of law, and walks over them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statvine.sources.shared import stash

#: Citation and definition forms. Fixed patterns.
CHAPTER = r"(?:Ch(?:ap)?|Cap)\.?\s*([0-9]{1,2}:[0-9]{1,2})"
SECTION = r"(?:section|Section|s\.)\s+([0-9]{1,3}[A-Za-z]?)"
DEFINED = r"[“\"]([A-Z][A-Za-z \-']{2,40})[”\"]\s+means"
LISTED = r"(?:the )?expression(?:s)?[“\"]([A-Za-z \-']{2,40})[”\"]"
#: What may stand before and after a term that a text mentions. Fixed values.
OPENS, CLOSES = "“\" ", "”\" ,.;:"
NO_TERMS = ("the", "this", "that")
CONCEPT_TEXT = 300


def idea_id(section: str = "section_ref"):
    return F.concat(F.lit("idea:"), "chapter_number", F.lit("|"), section)


def ideas(chunks: DataFrame) -> DataFrame:
    """A node for each provision: its newest chunk stands for it; where none is dated, the longest.

    id, label, chapter_number, section_ref, heading, chunk_id, chunk_text, n_versions, newest, dates (all different ones, ascending).
    """
    key = ("chapter_number", "section_ref")
    heading = F.col("heading") if "heading" in chunks.columns else F.lit("")
    order = [F.col("as_at_date").desc_nulls_last(), F.when(F.col("as_at_date").isNull(), F.length("chunk_text")).desc_nulls_last(), "chunk_id"]
    first = chunks.withColumn("heading", F.coalesce(heading, F.lit(""))).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1")
    counts = chunks.groupBy(*key).agg(F.count_distinct("download_id").alias("n_versions"), F.max("as_at_date").alias("newest"), F.array_sort(F.collect_set("as_at_date")).alias("dates"))
    label = F.trim(F.concat_ws(" ", "chapter_number", "section_ref", "heading"))
    return first.select(*key, "heading", "chunk_id", "chunk_text").join(counts, list(key)).withColumns({"id": idea_id(), "label": label})


def defined_terms(ideas: DataFrame) -> DataFrame:
    """id, chapter_number, chunk_text, term: what the text of an idea defines or lists, each once."""
    found = F.concat(*(F.regexp_extract_all("chunk_text", F.lit(p)) for p in (DEFINED, LISTED)))
    rows = ideas.select("id", "chapter_number", "chunk_text", F.explode(F.array_distinct(F.transform(found, F.trim))).alias("term"))
    return rows.where((F.length("term") >= 3) & ~F.lower("term").isin(*NO_TERMS))


def concepts(ideas: DataFrame, least_chapters: int = 2, least_ideas: int = 2) -> DataFrame:
    """id, term, n_chapters, n_ideas, and the beginning of the text of the first idea that has the term."""
    first = F.min_by(F.substring("chunk_text", 1, CONCEPT_TEXT), "id").alias("text")
    counts = defined_terms(ideas).groupBy("term").agg(F.count_distinct("chapter_number").alias("n_chapters"), F.count_distinct("id").alias("n_ideas"), first)
    return counts.where((F.col("n_chapters") >= least_chapters) & (F.col("n_ideas") >= least_ideas)).withColumn("id", F.concat(F.lit("concept:"), "term"))


def _edges(rows: DataFrame, source, target, kind: str, detail, evidence: str = "EXTRACTED", weight=None) -> DataFrame:
    weight = F.lit(None).cast("double") if weight is None else weight
    return rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(evidence).alias("evidence"), weight.alias("weight"), detail.alias("detail"))


def part_of(ideas: DataFrame) -> DataFrame:
    return _edges(ideas, F.concat(F.lit("chapter:"), "chapter_number"), F.col("id"), "PART_OF", F.lit("statute"))


#: Terms up to which all of them are looked for at once; at most 40 letters each.
MOST_TERMS = 200_000


def mentions(ideas: DataFrame, concepts: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """An edge from each idea to every concept that its text names, as a whole and set off on both sides.

    Up to ``most`` terms, which are counted first, go to all tasks, and an automaton finds them in one pass over a text, without a shuffle. More terms meet
    the texts on the hash of their first two words, so no term's first word gathers all texts with ``the``; likely pairs
    are then compared with the text.
    """
    terms = concepts.select("term").distinct()
    if terms.count() <= most:
        rows = _found_at_once(ideas.select("id", "chunk_text"), [r["term"] for r in terms.collect()])
    else:
        begins = F.array_distinct(F.regexp_extract_all("chunk_text", F.lit(rf"(?<=[{OPENS}])(?=([A-Za-z'-]+(?: [A-Za-z'-]*)?))"), F.lit(1)))
        keys = F.array_distinct(F.flatten(F.transform(begins, lambda w: F.array(F.xxhash64(w), F.xxhash64(F.substring_index(w, " ", 1))))))
        two = F.when(F.instr("term", " ") > 0, F.substring_index("term", " ", 2)).otherwise(F.col("term"))
        near = ideas.select("id", F.explode(keys).alias("key")).join(terms.select("term", F.xxhash64(two).alias("key")), "key").select("id", "term")
        rows = near.join(ideas.select("id", "chunk_text"), "id").where(F.expr(f"rlike(chunk_text, concat('[{OPENS}]', term, '[{CLOSES}]'))")).select("id", "term").distinct()
    return _edges(rows, F.col("id"), F.concat(F.lit("concept:"), "term"), "MENTIONS", F.col("term"))


def _found_at_once(texts: DataFrame, terms: list[str]) -> DataFrame:
    """id, term of the terms that stand in a text, set off on both sides."""
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in held.value:
            machine.add_word(term, term)
        machine.make_automaton()
        for batch in batches:
            ids, names = [], []
            for at, text in enumerate(batch["chunk_text"].to_pylist()):
                found = set()
                for end, term in machine.iter(text or "") if len(machine) else ():
                    begin = end - len(term)
                    if begin >= 0 and text[begin] in OPENS and text[end + 1 : end + 2] and text[end + 1] in CLOSES:
                        found.add(term)
                ids += [at] * len(found)
                names += sorted(found)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(ids, pa.int64())), pa.array(names, pa.string())], names=["id", "term"])

    return texts.mapInArrow(run, "id string, term string")


def chapter_references(ideas: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """One edge for each mention of a chapter; of an existing one, where ``chapters`` is given."""
    found = ideas.select("id", F.explode(F.regexp_extract_all("chunk_text", F.lit(CHAPTER), F.lit(0))).alias("detail")).withColumn("chapter", F.regexp_extract("detail", CHAPTER, 1))
    if chapters is not None:
        found = found.join(chapters.select(F.col("chapter_number").alias("chapter")).distinct(), "chapter", "left_semi")
    return _edges(found, F.col("id"), F.concat(F.lit("chapter:"), "chapter"), "CROSS_REF", F.col("detail"))


def section_references(ideas: DataFrame) -> DataFrame:
    """Edges from a provision to others of its chapter that its text names, each once."""
    named = F.explode(F.array_distinct(F.regexp_extract_all("chunk_text", F.lit(SECTION))))
    found = ideas.select("id", "chapter_number", "section_ref", named.alias("other")).where("other <> section_ref")
    keys = ideas.select("chapter_number", F.col("section_ref").alias("other"))
    found = found.join(keys, ["chapter_number", "other"], "left_semi")
    return _edges(found, F.col("id"), idea_id("other"), "CROSS_REF", F.concat(F.lit("section "), "other"))


def semantic(near: DataFrame) -> DataFrame:
    """Edges of similar ideas: source, target, weight."""
    return _edges(near, F.col("source"), F.col("target"), "SEMANTIC", F.lit("embedding cosine"), "INFERRED", F.round("weight", 4))


def audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node, edge, evidence), type, n; edges are read once for both of their counts."""
    of_nodes = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    sets = edges.groupingSets([["type"], ["evidence"]], "type", "evidence").agg(F.count("*").alias("n"), F.grouping("type").alias("by"))
    by_evidence = F.col("by") == 1
    return of_nodes.unionByName(sets.select(F.when(by_evidence, "evidence").otherwise("edge").alias("what"), F.when(by_evidence, F.col("evidence")).otherwise(F.col("type")).alias("type"), "n"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of which an end is no node."""
    ids = nodes.select(F.col("id").alias("known"))
    found = edges.join(ids, F.col("source") == F.col("known"), "left_anti")
    others = edges.join(ids, F.col("source") == F.col("known"), "left_semi").join(ids, F.col("target") == F.col("known"), "left_anti")
    return found.unionByName(others)


def require_whole(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises where an edge dangles: such edges break walks unseen."""
    first = dangling(nodes, edges).first()
    if first is not None:
        raise ValueError(f"an edge leads to no node: {first['source']} - {first['target']}")


def cypher(nodes: DataFrame, edges: DataFrame, most: int = 2000) -> DataFrame:
    """Statements that make the graph anew: kind (node, edge), statement. Fixed formats.

    All chapters and concepts, and ideas in the order of their ids as long as fewer than ``most`` nodes were made; edges
    between nodes that are made.
    """
    room = max(0, most - nodes.where("type = 'chapter'").count())
    made = nodes.where("type in ('chapter', 'concept')").unionByName(nodes.where("type not in ('chapter', 'concept')").orderBy("id").limit(room))
    label = F.substring(F.translate(F.coalesce(F.nullif("label", F.lit("")), "id"), "\\\"", " '"), 1, 80)
    one = F.concat(F.lit("CREATE (n:`"), F.upper("type"), F.lit('` {id:"'), "id", F.lit('", label:"'), label, F.lit('"});'))
    ids = made.select(F.col("id").alias("made"))
    kept = edges.join(ids, F.col("source") == F.col("made"), "left_semi").join(ids, F.col("target") == F.col("made"), "left_semi")
    tie = F.concat(F.lit('MATCH (a {id:"'), "source", F.lit('"}),(b {id:"'), "target", F.lit('"}) CREATE (a)-[:'), "type", F.lit(' {evidence:"'), "evidence", F.lit('"}]->(b);'))
    return made.select(F.lit("node").alias("kind"), one.alias("statement")).unionByName(kept.select(F.lit("edge").alias("kind"), tie.alias("statement")))


def with_case_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (id, type, label, text) and those cases that only edges name: the first title (or else the id) and detail stand for them.

    edges: source, target, type, detail, and title where cases have one.
    """
    title = F.col("title") if "title" in edges.columns else F.lit(None).cast("string")
    cited = edges.where(F.col("source").startswith("case:")).select(F.col("source").alias("id"), title.alias("title"), F.coalesce(F.nullif("detail", F.lit("")), title, F.lit("")).alias("text"))
    first = cited.groupBy("id").agg(F.min(F.struct("title", "text")).alias("x"))
    missing = first.join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "type", "label", "text").unionByName(missing.select("id", F.lit("case").alias("type"), F.coalesce(F.nullif("x.title", F.lit("")), "id").alias("label"), F.col("x.text").alias("text")))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, level of everything within ``depth`` steps; each level is a join of the frontier, less what was seen.

    Edges are written once to the shared folder, as every level reads them, and so is each level.
    """
    near = stash(adjacency(edges).distinct(), "near")
    seen = seeds.select("id", F.lit(0).alias("level")).distinct()
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(near, frontier["id"] == near["source"]).select(F.col("target").alias("id")).distinct()
        frontier = stash(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        seen = seen.unionByName(frontier)
    return seen


#: Words that make a bare number a citation when one stands whole within the 40 characters before it. Fixed values.
CITED = r"(?i)\b(?:Cap(?:ition)?\.|Ch(?:ap)?\.|Chapter)\s*([0-9]{1,2}:[0-9]{1,2})\b"
ACT_WORDS = ("act", "ordinance", "chapter", "cap", "ch")
BEFORE = 40


#: The same in one forward pass, as SQL can say it: each word takes the first number at most 31 characters on, and the next search begins behind
#: that. Words are set off by anything but letters, digits and underscores, numbers by anything but the ASCII ones.
IN_TURN = rf"(?is)(?=[aco])(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(ACT_WORDS)})(?:[^\p{{L}}\p{{N}}_].{{0,30}}?)??(?<![0-9A-Za-z_])([0-9]{{1,2}}:[0-9]{{1,2}})(?![0-9A-Za-z_])"
CITED_IN_TURN = r"(?i)(?<![0-9A-Za-z_])(?:Cap(?:ition)?\.|Ch(?:ap)?\.|Chapter)[\t\n\f\r ]*([0-9]{1,2}:[0-9]{1,2})(?![0-9A-Za-z_])"


def bare_references(texts: DataFrame, chapters: DataFrame, in_turn: bool = False) -> DataFrame:
    """chunk_id, chapter, confidence, method of numbers ``N:N`` shortly after an act-like word, where the chapter exists.

    Confidence is high where the text also cites a chapter in full form.

    A bounded look-behind reads the context, only where a number stands, so neighbouring citations don't swallow each other;
    ``in_turn`` takes them by ``IN_TURN`` instead.
    """
    context = "|".join(rf"\b{w}\b.{{0,{BEFORE - len(w)}}}" for w in ACT_WORDS)
    pattern = IN_TURN if in_turn else rf"(?is)\b(?=[0-9]{{1,2}}:[0-9])(?<={context})([0-9]{{1,2}}:[0-9]{{1,2}})\b"
    sure = F.when(F.col("chunk_text").rlike(CITED_IN_TURN if in_turn else CITED), "high").otherwise("medium")
    found = texts.select("chunk_id", F.explode(F.regexp_extract_all("chunk_text", F.lit(pattern))).alias("chapter"), sure.alias("confidence"))
    known = chapters.select(F.col("chapter_number").alias("chapter")).distinct()
    return found.join(known, "chapter", "left_semi").select("chunk_id", "chapter", "confidence", F.lit("REGEX").alias("method"))
