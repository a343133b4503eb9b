"""Expectations about looked-up texts, checked as a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(expected: DataFrame, texts: DataFrame) -> DataFrame:
    """id and failed, the names of the expectations that don't hold, of every row of ``expected``.

    expected: id, must_contain and must_not_contain (arrays of strings), min_chars, should_exist, and differs_from and
    same_as (arrays of other ids); null means not asked for. texts: id, text; an id without a text was not found.
    """
    found = texts.select("id", F.col("text"))
    rows = expected.join(found, "id", "left")
    text = F.coalesce("text", F.lit(""))
    asks = F.coalesce("should_exist", F.lit(True))
    others = rows.select("id", "text", F.explode(F.concat(
        F.transform(F.coalesce("differs_from", F.array().cast("array<string>")), lambda x: F.struct(x.alias("other"), F.lit(False).alias("same"))),
        F.transform(F.coalesce("same_as", F.array().cast("array<string>")), lambda x: F.struct(x.alias("other"), F.lit(True).alias("same"))))).alias("x"))
    seen = others.select("id", "text", "x.*").join(found.select(F.col("id").alias("other"), F.col("text").alias("other_text")), "other", "left")
    wrong = F.col("text").eqNullSafe(F.col("other_text")) != F.col("same")
    pairs = seen.groupBy("id").agg(F.max(wrong & F.col("same")).alias("not_same"), F.max(wrong & ~F.col("same")).alias("not_different"))
    all_in = F.forall(F.coalesce("must_contain", F.array().cast("array<string>")), lambda x: text.contains(x))
    none_in = ~F.exists(F.coalesce("must_not_contain", F.array().cast("array<string>")), lambda x: text.contains(x))
    failures = {
        "should_exist": F.col("text").isNotNull() != asks,
        "must_contain": asks & ~all_in,
        "must_not_contain": asks & ~none_in,
        "min_chars": asks & (F.length(text) < F.coalesce("min_chars", F.lit(0))),
        "same_as": F.coalesce("not_same", F.lit(False)),
        "differs_from": F.coalesce("not_different", F.lit(False)),
    }
    named = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in failures.items())))
    return rows.join(pairs, "id", "left").select("id", named.alias("failed"))
