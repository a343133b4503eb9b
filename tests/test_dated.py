"""Versions by each request's own date, against a plain loop; hot provisions, undated versions, repeated requests."""

import datetime
import random

import pytest

from statvine.operators import temporal

VERSIONS = "chapter_number string, section_ref string, as_at_date date, download_id long, l_suppkey long, text string, date string, at string"
REQUESTS = "id long, chapter_number string, section_ref string, date date, version string"


def day(n):
    return None if n is None else datetime.date(2000, 1, 1) + datetime.timedelta(n)


@pytest.fixture(scope="module")
def law():
    dice = random.Random(11)
    versions = [("1:01", dice.choice("123"), day(dice.choice([None, *range(20)])), dice.randrange(5), i, dice.choice("xyz"), "d", "a") for i in range(80)]
    versions += [("1:02", "1", day(5), 7, i, "same", "d", "a") for i in range(3)] + [("1:03", "9", None, 1, 1, "undated", "d", "a"), ("1:03", "9", None, 2, 1, "later", "d", "a")]
    requests = [(i, dice.choice(["1:01", "1:01", "1:02", "1:03", "9:99"]), dice.choice("1239"), day(dice.choice([None, *range(-2, 24)])), "v") for i in range(300)]
    return versions, requests + requests[:20]


def best(versions, r):
    rows = [v for v in versions if v[:2] == r[1:3] and (r[3] is None or (v[2] is not None and v[2] <= r[3]))]
    return max(rows, key=lambda v: (v[2] or datetime.date.min, *v[3:]), default=None)


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_each_request_by_its_own_date(spark, law, hot):
    versions, requests = law
    got = temporal.as_of_each(spark.createDataFrame(requests, REQUESTS).withColumnRenamed("version", "asked"), spark.createDataFrame(versions, VERSIONS), hot).collect()
    of = lambda v: None if v is None else (v["as_at_date"], v["download_id"], v["l_suppkey"], v["text"])
    plain = lambda v: None if v is None else (v[2], v[3], v[4], v[5])
    want = [(r[0], plain(best(versions, r)), plain(best(versions, (*r[:3], None)))) for r in requests]
    assert sorted(map(str, [(r["id"], of(r["version"]), of(r["newest"])) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("hot", [1_000_000, 3])
def test_each_request_resolved(spark, law, hot):
    versions, requests = law
    asked = spark.createDataFrame(requests, REQUESTS).drop("version")
    got = temporal.resolve_each(asked, spark.createDataFrame(versions, VERSIONS), "text", hot).collect()

    def status(r):
        v = best(versions, r)
        if v is None:
            return "not_found"
        return "ambiguous" if len({x[5] for x in versions if x[:3] == v[:3]}) > 1 else "found"

    assert sorted((r["id"], r["status"]) for r in got) == sorted((r[0], status(r)) for r in requests)
    back = temporal.with_fallback_each(asked, spark.createDataFrame(versions, VERSIONS), hot).collect()
    assert sorted((r["id"], r["fell_back"]) for r in back) == sorted((r[0], best(versions, r) is None and best(versions, (*r[:3], None)) is not None) for r in requests)


def test_requests_of_nothing(spark, law):
    asked = spark.createDataFrame(law[1], REQUESTS)
    assert temporal.as_of_each(asked.drop("version"), spark.createDataFrame([], VERSIONS)).where("version is null").count() == len(law[1])
    assert temporal.as_of_each(asked.drop("version").where("false"), spark.createDataFrame(law[0], VERSIONS)).count() == 0


def test_nearby_names_the_chapter_alone(spark):
    keys = [("1:01", str(i)) for i in (1, 2, 9, 12)] + [("1:02", "1")]
    got = temporal.nearby(spark.createDataFrame(keys, "chapter_number string, section_ref string"), spark.createDataFrame([("1:01", "10"), ("7:77", "1")], "chapter_number string, section_ref string"), 2)
    assert sorted(map(tuple, got.collect())) == [("1:01", "10", "", 3), ("1:01", "10", "12", 2), ("1:01", "10", "9", 1)]
