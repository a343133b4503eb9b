"""English words for full-text search: a stop list and a suffix stemmer, which both see distinct words only."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that searches leave out. Fixed values.
STOP = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just
don should now""".split())

#: Suffixes and words of the English stemmer (Porter, "Snowball", 2001). Fixed values.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
         **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
BEGINNINGS = ("gener", "commun", "arsen")
SECOND = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
          "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VOWEL, DOUBLE = "[aeiouy]", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
REGION = re.compile(rf"{VOWEL}[^aeiouy]")
SHORT = re.compile(rf"(?:^{VOWEL}[^aeiouy]|[^aeiouy]{VOWEL}[^aeiouywxY])$")


def _ending(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word: ``debtors`` and ``debtor`` have one."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub(rf"(?:^|(?<={VOWEL}))y", "Y", word)
    opening = _ending_of_start(word)
    first = opening if opening else (m.end() if (m := REGION.search(word)) else len(word))
    second = m.end() if (m := REGION.search(word, first)) else len(word)
    held = lambda ending, region: len(word) - len(ending) >= region

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in AFTER_PLURAL:
        return word

    if e := _ending(word, ("eedly", "eed")):
        if held(e, first):
            word = word[: -len(e)] + "ee"
    elif (e := _ending(word, ("ingly", "edly", "ing", "ed"))) and re.search(VOWEL, word[: -len(e)]):
        word = word[: -len(e)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLE):
            word = word[:-1]
        elif SHORT.search(word) and len(word) <= first:
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    if (e := _ending(word, SECOND)) and held(e, first):
        before = word[: -len(e)]
        if e == "li":
            word = before if before[-1:] and before[-1] in "cdeghkmnrt" else word
        elif e != "ogi" or before.endswith("l"):
            word = before + SECOND[e]
    if (e := _ending(word, THIRD)) and held(e, second if e == "ative" else first):
        word = word[: -len(e)] + THIRD[e]
    if (e := _ending(word, FOURTH)) and held(e, second) and (e != "ion" or word[: -len(e)].endswith(("s", "t"))):
        word = word[: -len(e)]
    if word.endswith("e") and (held("e", second) or (held("e", first) and not SHORT.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and held("l", second):
        word = word[:-1]
    return word.replace("Y", "y")


def _ending_of_start(word: str) -> int:
    return next((len(b) for b in BEGINNINGS if word.startswith(b)), 0)


def stems(words: Column) -> Column:
    """The stem of each word of a column; meant for distinct words."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda w: None if w is None else stem(w))

    return run(words)


def beginnings(stem_: str) -> tuple[str, list[str]]:
    """What words of a stem begin with, and the words of it that don't: only a stem's last letter may differ from its words."""
    return stem_[: max(1, len(stem_) - 1)], [w for w, s in WHOLE.items() if s == stem_]
