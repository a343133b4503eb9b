"""Stems, stop words, and the stored index with positions against a scan."""

import math
import random
import re

import pytest

from statvine.functions.english import STOP, beginnings, stem
from statvine.operators import search
from statvine.operators.textindex import TextIndex

PAIRS = "debtors debtor|regulations regul|authorities author|payments payment|agreed agre|feed feed|hopping hop|hoping hope|cries cri|ties tie|dying die|national nation|relational relat|generously generous|communities communiti|ability abil|happiness happi|falling fall|controlling control|say say|by by|yes yes|geology geolog|consolidating consolid|proceed proceed|beds bed|skies sky"


def test_stems():
    for pair in PAIRS.split("|"):
        word, want = pair.split()
        assert stem(word) == want, word
        head, rest = beginnings(want)
        assert word.startswith(head) or word in rest
    assert "the" in STOP and stem("") == "" and stem("1950") == "1950"


@pytest.fixture(scope="module")
def texts(spark):
    dice = random.Random(2)
    words = ["debtor", "Debtors", "the", "of", "pay", "paying", "paid", "widget", "İstanbul", "x1", "straße"] + [f"v{i}" for i in range(30)]
    rows = [(i * 7 - 50, " ".join(dice.choices(words, [9, 9, 30, 20, 5, 5, 5, 3, 2, 2, 2] + [1] * 30, k=dice.randrange(0, 120))) + dice.choice(["", ".", "-the debtor-"])) for i in range(300)]
    rows += [(10_000, None), (10_001, ""), (10_002, "..."), (10_003, "debtor " * 5_000), (2**40, "the debtor pays the widget")]
    return rows, spark.createDataFrame(rows, "chunk_id long, chunk_text string").repartition(4).cache()


def cut(text):
    return [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]


def scores(rows, terms, same=lambda w: w):
    tokens = {i: cut(t) for i, t in rows}
    held = {i: [sum(same(w) == t for w in ws) for t in terms] for i, ws in tokens.items()}
    df = [sum(h[k] > 0 for h in held.values()) for k in range(len(terms))]
    return {i: round(sum(n * math.log(1 + len(rows) / d) for n, d in zip(h, df)) / (1 + math.log(len(tokens[i]))), 6) for i, h in held.items() if all(h)}


@pytest.mark.parametrize("query", ["debtor", "The debtor", "v1 widget pay", "nothing here", "", "İstanbul"])
def test_index_equals_the_scan(texts, query):
    rows, frame = texts
    index = TextIndex.build(frame)
    want = scores(rows, sorted(set(cut(query)))) if cut(query) else {}
    for got in (index.fts(query), search.fts(frame, query)):
        assert dict(map(tuple, got.collect())) == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("query,terms", [("the debtors paying", ["debtor", "pay"]), ("Widgets", ["widget"]), ("the of", [])])
def test_english_finds_other_forms(texts, query, terms):
    rows, frame = texts
    want = scores(rows, terms, stem) if terms else {}
    for got in (search.fts_english(frame, query), TextIndex.build(frame, english=True).fts(query)):
        assert dict(map(tuple, got.collect())) == pytest.approx(want, abs=2e-6)
    assert not terms or want


def test_phrases_equal_a_full_scan(texts):
    rows, frame = texts
    plain, english = TextIndex.build(frame), TextIndex.build(frame, english=True)
    for query in ("the debtor", "debtor debtor", "of the", "the", "the debtor pays the widget", "v1 v2", "gone debtor"):
        words = cut(query)
        want = {i: n for i, t in rows if (n := sum(cut(t)[k : k + len(words)] == words for k in range(len(cut(t)))))}
        assert dict(map(tuple, plain.phrase(query).collect())) == want
    want = {i: n for i, t in rows if (n := sum(stem(a) == "debtor" and stem(b) == "widget" for a, b in zip(cut(t), cut(t)[3:])))}
    assert dict(map(tuple, english.phrase("debtors of the widget").collect())) == want and 2**40 in want
    assert 2**40 in {r[0] for r in english.phrase("debtor pays the widgets").collect()}


def test_no_row_holds_all_of_a_term(texts, spark):
    rows, frame = texts
    index = TextIndex.build(frame)
    blocks = index.rows.where("term = 'the'").collect()
    assert len(blocks) > 1 and sum(r["n"] for r in blocks) == sum("the" in cut(t) for _, t in rows)
    assert TextIndex.build(frame.where("false")).fts("debtor").count() == 0


def test_an_index_outlives_the_scratch_it_was_built_in(texts, spark):
    from statvine.sources.shared import scratch

    with scratch(spark):
        index = TextIndex.build(texts[1])
    assert index.fts("widget").count() > 0
