r"""Operator 3, personal data by weak supervision; DataFrame functions only on the path of the rows.

Regexes propose spans, strict and loose ones, of four kinds. Five labelers vote on each: the strict form (checksums,
ranges), a gazetteer (top-level domains, country codes, issuer prefixes, first octets), the context (a cue word
before), the surroundings (white space or punctuation on both sides) and the layout. Spark counts how often
each pattern of kind, votes, length class and traits occurs: some thousand rows, whatever the corpus. On these counts the driver
estimates the labelers' reliabilities by expectation-maximisation (Dawid and Skene, 1979) and trains a logistic span
classifier on the posteriors. It sees more than the label model: the characters on both sides, the separators, and the
word before (by hash); its weights become a sum of CASE terms. Strict spans always stay; the classifier adds
proposed spans of probability of at least one half that overlap no strict one.

Regexes are written so that each text is scanned in linear time and without recursion: possessive loops, and
starts only where a run of the kind's characters begins or the last match ended.

Null or empty text: no spans. Offsets are code points, end exclusive. Repeated rows give repeated
results; other columns are ignored. A table without any proposed span gives no added spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Proposed spans: kind, whether the strict rule may hold, a cheap test, the regex.
PROPOSED = {
    "email": ("email", True, "contains(text, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("ip", True, r"text rlike '[0-9]\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    # shorter runs of digits can't be cards, so they aren't looked at; the runs are the same
    "card": ("card", True, r"text rlike '[0-9](?:[\\x20-]?[0-9]){12}'", r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    "phone": ("phone", True, r"text rlike '\\+[0-9]'", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_loose": ("email", False, r"text rlike '(?i)[\\[(]at[\\])]'", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,4}"),
    "ip_loose": ("ip", False, "text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]'", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "phone_loose": ("phone", False, "text rlike '[0-9]{4}'", r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
}
#: Domains, country codes (by first digits), and words that announce a kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "it", "nl", "uk", "eu", "us", "ca", "au")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98")
CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": r"\bip\b|host|server|address|adresse|client|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|call|mobile|fax|telefon|tel[eé]fono",
}
LABELERS = ("strict", "gazetteer", "cue", "apart", "layout")
CONTEXT = 40
#: What the classifier sees beside votes and length: the characters on both sides, the separators inside, the word before.
TRAITS = ("before", "after", "inside", "word")
WORDS = 16
EM_ROUNDS, FIT_ROUNDS = 30, 200


def _text(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: Matches that are placed together: appending to an array copies it, so long lists grow by pieces.
PIECE = 256


def _fold(items: str, none: str, state: str, step: str, out: str) -> str:
    """``out`` of an aggregation over the array ``items`` that appends to ``s.out``, by pieces.

    none: an empty ``out``; state: the other fields at first; step: the new state from ``s`` and the item's number ``i``.
    """
    first, fields = f"named_struct({state}, 'out', {none})", [x.strip().strip("'") for x in state.split(",")[::2]]
    handed = ", ".join(f"'{f}', {{}}.{f}" for f in fields)
    piece = f"aggregate(sequence(p * {PIECE} + 1, least(size({items}), (p + 1) * {PIECE})), named_struct({handed.format(*['t'] * len(fields))}, 'out', {none}), (s, i) -> {step})"
    return f"""aggregate(sequence(0, (size({items}) - 1) div {PIECE}), named_struct({state}, 'out', array({none})),
        (t, p) -> transform(array({piece}), x -> named_struct({handed.format(*['x'] * len(fields))}, 'out', concat(t.out, array(x.out))))[0], t -> {out})"""


def _placed(name: str) -> Column:
    """The matches of a regex with their offsets, from the lengths of what lies between them.

    before: at most ``CONTEXT`` characters back to the beginning of the match before this one; after: the next character.
    """
    none = "cast(array() as array<struct<start:int,end:int,hit:string,digits:string,before:string,after:string>>)"
    hit, piece = f"hits_{name}[i - 1]", f"pieces_{name}[i - 1]"
    begin = f"s.at + length({piece})"
    # a substring of the text would be looked for from its beginning
    before, after = f"right(concat(if(i = 1, '', hits_{name}[i - 2]), {piece}), {CONTEXT})", f"left(concat(pieces_{name}[i], coalesce(get(hits_{name}, i), '')), 1)"
    found = f"named_struct('start', {begin}, 'end', {begin} + length({hit}), 'hit', {hit}, 'digits', regexp_replace({hit}, '[^0-9]', ''), 'before', {before}, 'after', {after})"
    step = f"named_struct('at', {begin} + length({hit}), 'out', concat(s.out, array({found})))"
    return F.expr(f"if(size(hits_{name}) = 0, {none}, {_fold(f'hits_{name}', none, chr(39) + 'at' + chr(39) + ', 0', step, 'flatten(t.out)')})")


_DIGITS = "x.digits"
_DIGIT = "cast(substring(x.digits, length(x.digits) + 1 - i, 1) as int)"
_LUHN = f"aggregate(sequence(1, length(x.digits)), 0L, (s, i) -> (s + if(i % 2 = 1, {_DIGIT}, (2 * {_DIGIT}) div 10 + (2 * {_DIGIT}) % 10)) % 10) = 0"
_OCTETS = r"""forall(split(x.hit, '\\.'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and coalesce(try_cast(regexp_replace(p, '^0+', '') as int), 0) <= 255)"""
#: What makes a proposed span strict, by kind; and its gazetteer and layout votes.
STRICT = {"email": "true", "ip": _OCTETS, "card": f"(length({_DIGITS}) between 16 and 19 and {_LUHN})", "phone": f"(length({_DIGITS}) between 8 and 15)"}
#: What a loosely proposed span must satisfy to be looked at.
WORTH = {"card": f"length({_DIGITS}) between 13 and 19"}
GAZETTEER = {
    "email": "array_contains(array({}), lower(regexp_extract(x.hit, '([A-Za-z0-9-]+)$', 1)))".format(", ".join(f"'{d}'" for d in DOMAINS)),
    "ip": "(x.hit like '%:%' or coalesce(try_cast(regexp_extract(x.hit, '^([0-9]+)', 1) as int), 999) between 1 and 223)",
    "card": rf"{_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65)'",
    "phone": "({} rlike '^({})' or x.hit not like '+%')".format(_DIGITS, "|".join(COUNTRIES)),
}
LAYOUT = {
    "email": "x.hit rlike '^[A-Za-z0-9][A-Za-z0-9._+-]*[A-Za-z0-9]@'",
    "ip": r"not x.hit rlike '(^|\\.)0[0-9]'",
    "card": r"x.hit rlike '^([0-9]+|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$'",
    "phone": r"x.hit rlike '^(\\+[0-9]{1,3}[ .-]?)?(\\([0-9]{1,4}\\)|[0-9]{1,4})([ .-]?[0-9]{2,4}){2,4}$'",
}


def _side(character: str) -> str:
    return f"case when {character} = '' then '-' when {character} rlike '[A-Za-z0-9]' then 'a' when {character} rlike '[\\\\s]' then 's' else 'p' end"


_BEFORE = "lower(x.before)"
_INSIDE = "case when x.hit rlike '^[0-9]+$' then '0' when x.hit rlike '@' then '@' when x.hit rlike ':' then ':' when x.hit rlike '[(]' then '(' when x.hit rlike '[ ]' then 's' when x.hit rlike '-' then '-' else '.' end"
_WORD = f"substring('0123456789abcdef', cast(crc32(cast(regexp_extract({_BEFORE}, '([a-z]+)[^a-z]*$', 1) as binary)) % {WORDS} as int) + 1, 1)"
_TRAITS = f"concat({_side('right(x.before, 1)')}, {_side('x.after')}, {_INSIDE}, {_WORD})"


def propose(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, text, and ``proposed``: kind, start, end, strict, votes, length class and traits of each span."""
    found = _text(docs, *keep)
    found = found.withColumns({f"hits_{n}": F.when(F.expr(test), F.regexp_extract_all("text", F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>")) for n, (_, _, test, regex) in PROPOSED.items()})
    found = found.withColumns({f"pieces_{n}": F.when(F.size(f"hits_{n}") > 0, F.split("text", regex, -1)) for n, (_, _, _, regex) in PROPOSED.items()})
    found = found.withColumns({f"at_{n}": _placed(n) for n in PROPOSED}).drop(*(f"{p}_{n}" for p in ("hits", "pieces") for n in PROPOSED))
    voted = []
    for name, (kind, may, _, _) in PROPOSED.items():
        strict = STRICT[kind] if may else "false"
        # what the strict rule drops may still be proposed; a base span that fails is not tried again elsewhere
        voted.append(f"""transform(filter(at_{name}, x -> {WORTH.get(kind, 'true')} or {strict}), x -> named_struct(
            'kind', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'strict', {strict},
            'votes', concat({'if(' + strict + ", '1', '0')" if may else "'-'"}, if({GAZETTEER[kind]}, '1', '0'),
              if({_BEFORE} rlike '{CUES[kind].replace(chr(92), chr(92) * 2)}', '1', '-'),
              if(not right(x.before, 1) rlike '[A-Za-z0-9]' and not x.after rlike '[A-Za-z0-9]', '1', '0'),
              if({LAYOUT[kind]}, '1', '0')),
            'size', cast(least(5, (x.end - x.start) div 6) as int), 'traits', {_TRAITS}))""")
    every = F.expr(f"concat({', '.join(voted)})")
    return found.select("doc_id", *keep, "text", every.alias("proposed"))


Pattern = tuple[int, str, int, str, int]


def patterns(proposed: DataFrame) -> list[Pattern]:
    """kind, votes, length class, traits, spans: few of the possible combinations occur, whatever the corpus."""
    rows = proposed.select(F.explode("proposed").alias("x")).groupBy("x.kind", "x.votes", "x.size", "x.traits").agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], r["votes"], r["size"], r["traits"], r["n"]) for r in rows)


def reliabilities(rows: list[Pattern]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The posterior of each pattern, and by kind each labeler's chance of voting yes on true and on false spans."""
    posterior, rates = np.zeros(len(rows)), {}
    for kind in range(len(KINDS)):
        own = [i for i, r in enumerate(rows) if r[0] == kind]
        if not own:
            continue
        votes = np.array([[{"1": 1.0, "0": 0.0, "-": np.nan}[v] for v in rows[i][1]] for i in own])
        n = np.array([rows[i][-1] for i in own], np.float64)
        cast = ~np.isnan(votes)
        yes = np.where(cast, votes, 0.0)
        # to begin with, the share of yes votes
        p = np.clip(np.where(cast, votes, 0.0).sum(1) / np.maximum(1, cast.sum(1)), 0.05, 0.95)
        for _ in range(EM_ROUNDS):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            true = ((n * p)[:, None] * yes).sum(0) + 4.0  # labelers are taken to be better than chance
            true /= ((n * p)[:, None] * cast).sum(0) + 5.0
            false = ((n * (1 - p))[:, None] * yes).sum(0) + 1.0
            false /= ((n * (1 - p))[:, None] * cast).sum(0) + 5.0
            odds = np.log(prior / (1 - prior)) + np.where(cast, yes * np.log(true / false) + (1 - yes) * np.log((1 - true) / (1 - false)), 0.0).sum(1)
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        posterior[own] = p
        rates[kind] = np.stack([true, false])
    return posterior, rates


def _inputs(kind: int, votes: str, size: int, traits: str) -> list[tuple]:
    return [("kind", kind), ("size", kind, size), *(("vote", kind, j, v) for j, v in enumerate(votes)), *((name, kind, j, v) for j, (name, v) in enumerate(zip(TRAITS, traits)))]


def classifier(rows: list[Pattern], posterior: np.ndarray) -> dict[tuple, float]:
    """Weights of a logistic regression on the posteriors, one for each value of each input."""
    names = sorted({x for *pattern, _ in rows for x in _inputs(*pattern)}, key=repr)
    number = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (*pattern, _) in enumerate(rows):
        x[i, [number[f] for f in _inputs(*pattern)]] = 1
    n = np.array([r[-1] for r in rows], np.float64)
    w = np.zeros(len(names))
    for _ in range(FIT_ROUNDS):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(len(names)), x.T @ (n * (posterior - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(names, w.tolist()))


def _odds(weights: dict[tuple, float]) -> str:
    """The classifier as SQL on a proposed span ``x``."""
    if not weights:
        return "-1D"
    of_kind = {}
    for name, w in weights.items():
        if name[0] == "kind":
            term = f"{w:.9f}D"
        elif name[0] == "size":
            term = f"if(x.size = {name[2]}, {w:.9f}D, 0D)"
        else:
            term = f"if(substring(x.{'votes' if name[0] == 'vote' else 'traits'}, {name[2] + 1}, 1) = '{name[3]}', {w:.9f}D, 0D)"
        of_kind.setdefault(name[1], []).append(term)
    return "case x.kind " + " ".join(f"when {k} then {' + '.join(terms)}" for k, terms in of_kind.items()) + " else -1D end"


def train(docs: DataFrame) -> dict[tuple, float]:
    """The span classifier's weights, from all texts."""
    rows = patterns(propose(docs))
    return classifier(rows, reliabilities(rows)[0]) if rows else {}


def spans(docs: DataFrame, weights: dict[tuple, float], *keep: str) -> DataFrame:
    """doc_id, ``keep``, text, and ``spans``: kind, start, end, strict, by kind as listed, then start."""
    chosen = F.expr(f"""
        array_sort(transform(
          filter(proposed, x -> x.strict or (({_odds(weights)}) >= 0 and not exists(strict, y -> y.start < x.end and x.start < y.end))),
          x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'strict', x.strict)))""")
    return propose(docs, *keep).withColumn("strict", F.expr("filter(proposed, y -> y.strict)")).select("doc_id", *keep, "text", chosen.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the strict spans by kind, their digest, and all spans as one string."""
    names = F.array(*map(F.lit, KINDS))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    strict = F.filter("spans", lambda x: x["strict"])
    kinds = F.transform(strict, lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, -1)).cast("long") - F.size(F.array_remove(kinds, k)) for k in range(len(KINDS))]
    counts = [n.alias(f"n_{name}") for n, name in zip(counts, KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(strict), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, weights: dict[tuple, float]) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their kind, as ``<EMAIL>``; ``n_chars`` follows where it is there.

    Of overlapping spans the first stands for all. Texts without spans, null ones included, stay as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.select(F.col("doc_id"), F.col("text"), F.struct(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *others).alias("__row"))
    found = spans(kept, weights, "__row")
    found = found.withColumn("ordered", F.expr("array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"))
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    x = "ordered[i - 1]"
    step = f"""if({x}.start < s.at, named_struct('at', greatest(s.at, {x}.end), 'out', s.out),
        named_struct('at', {x}.end, 'out', concat(s.out, array(struct({x}.start as start, {x}.end as end, array({names})[{x}.kind] as name)))))"""
    kept = _fold("ordered", "cast(array() as array<struct<start:int,end:int,name:string>>)", "'at', 0", step, "flatten(t.out)")
    found = found.withColumn("placed", F.expr(f"if(size(ordered) = 0, null, {kept})"))
    # what lies before each span, then its name; the end of the text at last
    clean = F.expr("""concat(array_join(transform(placed, (x, i) -> concat(substring(text, if(i = 0, 0, placed[i - 1].end) + 1, x.start - if(i = 0, 0, placed[i - 1].end)), x.name)), ''),
        substring(text, placed[size(placed) - 1].end + 1))""")
    text = F.when(F.size("spans") == 0, F.col("__row.text")).otherwise(clean)
    n_chars = F.when(F.size("spans") == 0, F.col("__row.n_chars")).otherwise(F.length(text)) if "n_chars" in others else None
    return found.select(*(text.alias(c) if c == "text" else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns))
