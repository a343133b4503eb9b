"""Structured replies of an assistant, and whether the sources it was shown carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tool rounds before a run ends in an error. Fixed value.
ROUNDS = 8


def parse(reply: Column) -> Column:
    """struct<answer, source_ids> of the JSON object in a reply, whatever stands around it; null without an answer."""
    found = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), "answer string, source_ids array<string>")
    ids = F.coalesce(found["source_ids"], F.array().cast("array<string>"))
    return F.when(found["answer"].isNotNull(), F.struct(found["answer"].alias("answer"), ids.alias("source_ids")))


def grounded(ids: Column, collected: Column) -> Column:
    """Some source is named, and none that wasn't collected."""
    return F.coalesce((F.size(ids) > 0) & (F.size(F.array_except(ids, collected)) == 0), F.lit(False))


def decide(reply: Column, collected: Column, rounds: Column, configured: Column | None = None, failed: Column | None = None) -> Column:
    """unconfigured without a key; error where the model failed or after ``ROUNDS`` tool rounds; ok where no source was collected or
    the reply is grounded; else refused. configured, failed: null means that a key is there and that nothing failed."""
    ids = parse(reply)["source_ids"]
    keyed = F.lit(True) if configured is None else F.coalesce(configured, F.lit(True))
    broken = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    return F.when(~keyed, "unconfigured").when(broken, "error").when(rounds >= ROUNDS, "error").when(F.size(collected) == 0, "ok").when(grounded(ids, collected), "ok").otherwise("refused")


#: What parameters may be. Fixed values.
ALLOWED = {"mode": "fts|hybrid|vector", "chat_mode": "research|precedent", "status": "ok|refused|error|unconfigured"}
LIMITS = {"limit": (1, 100), "offset": (0, None)}


def broken_rules() -> Column:
    """The names of the columns mode, chat_mode, status, limit and offset that break a rule; a missing value does."""
    wrong = {c: ~F.coalesce(F.col(c).rlike(f"^(?:{p})$"), F.lit(False)) for c, p in ALLOWED.items()}
    for c, (least, most) in LIMITS.items():
        good = F.col(c) >= least if most is None else F.col(c).between(least, most)
        wrong[c] = ~F.coalesce(good, F.lit(False))
    return F.array_compact(F.array(*(F.when(bad, F.lit(c)) for c, bad in wrong.items())))
