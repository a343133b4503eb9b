"""Clustering, collocations and URL rules against brute force, and their SQL on the test tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from statvine.llm import collocations, oracles, queries, url_filters, va_file

VECTORS = "vec_id long, embedding array<float>, label int, k long, cells string, cluster int, v string"


def near(v, centroids):
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in e]) for i, e, *_ in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    v = np.array([x for _, x in kept])
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"1:{'' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    c = v[order[:k]]
    for _ in range(rounds):
        of, _ = near(v, c)
        c = np.array([v[of == j].sum(0) // (of == j).sum() if (of == j).any() else c[j] for j in range(len(c))])
    of, d = near(v, c)
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    return sorted((str(i), int(j), int(x), int(d[of == j].sum()), int(d.sum()), name[j]) for (i, _), j, x in zip(kept, of, d))


@pytest.mark.parametrize("bits,k", [(2, 16), (6, 16), (8, 3)])
def test_clusters(spark, bits, k):
    rng = np.random.default_rng(bits)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (middles[i % 6] + rng.normal(size=64) * 0.7).round(3).tolist()) for i in range(150)]
    rows += [(200, [0.0] * 64), (201, [0.0] * 64), (201, [0.0] * 64), (None, [0.5] * 64), (None, [-0.5] * 64), rows[3], (205, [30.0] + [0.0] * 63)]
    odd = [(300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [None] + [0.1] * 63), (305, [float("nan")] * 64), (306, [float("inf")] + [0.1] * 63)]
    full = [(*r, 1, 5, "c", 2, "v") for r in rows + odd]
    found, report = va_file.cluster(spark.createDataFrame(full, VECTORS).repartition(5), k=k, bits=bits)
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect())
    assert got == plain_clusters(full, k, 3)
    assert report[0][0] == len(rows) and all(several <= wanted for wanted, several in report)
    if bits == 8:
        assert report[2][0] < len(rows) // 2  # what doesn't move and is settled isn't fetched


def test_clusters_of_few_vectors(spark):
    none, report = va_file.cluster(spark.createDataFrame([(1, None, 0, 0, "", 0, "")], VECTORS))
    assert none.count() == 0 and none.columns[:3] == ["vec_id", "cluster", "distance"] and report == []
    two = [(7, [0.25] * 64, 0, 0, "", 0, ""), (8, [0.5] * 64, 0, 0, "", 0, "")]
    assert [r["distance"] for r in va_file.cluster(spark.createDataFrame(two, VECTORS))[0].collect()] == [0, 0]
    with pytest.raises(Exception, match="too large"):
        va_file.cluster(spark.createDataFrame([(1, [3e30] * 64, 0, 0, "", 0, "")], VECTORS))


def test_cells_cover_their_numbers():
    rng = np.random.default_rng(4)
    for bits, values in ((1, [5, 5, 5]), (3, rng.normal(0, 30, 500)), (8, rng.normal(0, 3, 500)), (4, [-(2**26), 0, 2**26])):
        x = np.array(values, np.int64)
        quantiles = np.sort(x)[np.linspace(0, len(x) - 1, 99).astype(int)].tolist()
        n = va_file.DIMENSIONS
        cells = va_file.Cells([int(x.min())] * n, [int(x.max())] * n, [quantiles] * n, bits)
        v = np.tile(x[:, None], (1, n))
        import pyarrow as pa

        at = cells.unpack(pa.array(cells.pack(v)))
        assert at.max() < 2**bits and (cells.low[0][at] <= v).all() and (v <= cells.high[0][at]).all()
        c = rng.integers(-40, 40, (5, n))
        least, most = cells.intervals(at, c)
        exact = ((v[:, None, :] - c[None]) ** 2).sum(2)
        assert (least <= exact).all() and (exact <= most).all()


DOCS = "doc_id long, text string, lang string, phrase string, n long, a long, size int, group int"


def plain_phrases(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {(g, w[i:j]) for (g, w), a in often.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 80 * f[g, w[i:j]]}
    by = collections.defaultdict(list)
    for (g, w), a in often.items():
        if (g, w) not in inside:
            score, k = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k) for k in range(1, len(w)))
            by[g].append((-score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    return sorted((g, i, p.decode(), -a, l, r, n[g], -s) for g, found in by.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("budget,chunk", [(2_000_000, 16 << 20), (300, 2_000)])
def test_phrases(spark, monkeypatch, budget, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    dice = random.Random(5)
    words = ["The", "cat", "sat", "été", "\U0001f600x", "x\x00y", "on", "a", "mat", "İs"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(dice.choices(words, [30, 20, 9, 9, 5, 5, 9, 20, 9, 5] + [1] * 40, k=dice.randrange(1, 300))) for _ in range(60)]
    texts = [re.sub(" ", lambda m: dice.choice([" ", " ", " ", "\t ", ", ", ".\n", "!\x0b"]), t) for t in texts]
    texts += ["same four words here " * 300, "a" * 30_000, "one, " * 5_000, "x y " * 4_000, "", None, " \t ", "...", "once"]
    rows = [(i, t, dice.choice(["en", "en", "de", None, "und"]), "p", 1, 2, 3, 4) for i, t in enumerate(texts)] * 2 + [(None, "null id here", "fr", "p", 1, 2, 3, 4)]
    want = plain_phrases([r[1:3] for r in rows], 30, 2000)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.mine(docs, budget=budget)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want and len(want) > 50
    few = collocations.mine(docs, top=7, budget=budget).collect()
    assert sorted(tuple(r) for r in few) == [x for x in want if x[1] <= 7]


def test_phrases_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, "", 1, 1, 1, 1), (2, "", "en", "", 1, 1, 1, 1)], DOCS)).count() == 0


def test_frequent_prefixes_are_extended():
    counts = {("en", (b"a",)): 900, ("en", (b"a", b"b")): 800, ("en", (b"a", b"c")): 40, ("en", (b"z",)): 60}

    class Frame:  # what plan() reads of a table
        def __init__(self, rows):
            self.rows = rows

        def where(self, _):
            return self

        def agg(self, _):
            return self

        def first(self):
            return {"n": 960}

        def collect(self):
            return [{"lang": g, "phrase": b" ".join(p), "size": len(p), "n": n} for (g, p), n in self.rows.items()]

    how = collocations.plan(Frame(counts), 4, 240)
    assert how.groups == 4 and how.extended["en"][1] == {(b"a",)} and how.extended["en"][2] == {(b"a", b"b")}
    assert set(how.named["en"][1]) == {(b"z",)} and set(how.named["en"][2]) == {(b"a", b"c")}


PAGES = "page_id long, url string, html string, host string, path string, node string, rule string"


def link(url):
    return f'<html><head><LINK href="{url}" rel="canonical"></head>'


def test_urls(spark):
    rows = [
        (1, "http://A.Example.com/en/x", None, "block", "example.com/en/", False),
        (2, "http://www.example.com/en/x", "", "allow", "www.example.com/en/", False),
        (3, "https://m.www.example.com/en/", "", "allow", "www.example.com/en/", False),
        (4, "http://x.net/es/1", "", "block", "net/es/", False),
        (5, "http://x.net/es", "", "allow", None, False),
        (6, "http://x.net/fr", "", "block", None, True),  # /fr/ of the same host is blocked below
        (7, "https://x.net/fr/?utm_source=a&ref#top", "", "block", "net/fr/", False),
        (8, "http://alias.org/a", link("http://x.net/es/1"), "block", None, True),
        (9, "http://alias.org/b", link("/a"), "block", None, True),
        (10, "http://alias.org/c/d", "<meta content='0; URL=../b' http-equiv=refresh>", "allow", None, False),  # dots aren't resolved: another page
        (11, "http://alias.org/c/e", "<meta http-equiv='refresh' content='0; url=//alias.org/b'>", "block", None, True),
        (12, "http://both.org/a", link("http://x.net/es/2"), "block", None, True),
        (13, "http://both.org/b", link("http://both.org/a") + "<meta http-equiv=refresh content='1;url=http://shop.com/'>", "block", None, True),
        (14, "http://shop.com/ok", link("http://x.net/es/1"), "allow", "com/", False),
        (15, None, link("http://x.net/es/1"), "allow", None, False),
        (16, "no scheme", link("http://x.net/es/1"), "allow", None, False),
        (17, "http://com", "", "allow", None, True),  # com/ is allowed, and only the last / differs
        (18, "http://notexample.com/en/", "", "allow", "com/", False),
        (19, "x://y.net/es/é?q://z#://", "", "block", "net/es/", False),
        (20, "http://plain.org/", "<link rel=canonical><link rel=icon href=http://x.net/es/1>", "allow", None, False),
        (21, "http://loop.org/1", link("http://loop.org/2"), "allow", None, False),
        (22, "http://loop.org/2", link("http://loop.org/1"), "allow", None, False),
        (23, "http://far.org/0", "", "block", None, True),
        (24, "http://mail.org/", link("mailto:a@x.net"), "allow", None, False),
    ]
    extra = [(100, "http://com/", "")]
    pages = [(i, u, h, "h", "p", "n", "r") for i, u, h, *_ in rows + extra + [rows[7]]]
    moved = [(f"http://far.org/{i}", f"http://far.org/{i + 1}") for i in range(9)] + [("http://far.org/9", "http://y.net/fr/z"), (None, "http://x.net/es/1"), ("http://plain.org/q", None)]
    got = url_filters.judge(spark.createDataFrame(pages, PAGES), redirects=spark.createDataFrame(moved, "source string, target string")).collect()
    assert sorted((r["page_id"], r["verdict"], r["rule"], r["inherited"]) for r in got if r["page_id"] < 100) == sorted([(i, *rest) for i, _, _, *rest in rows] + [(8, "block", None, True)])
    at = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert at[1] == ("a.example.com", "/en/x") and at[17] == ("com", "") and at[15] == at[16] == ("", "") and at[19] == ("y.net", "/es/é")
    assert url_filters.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_a_blocked_hub_reaches_all_its_aliases(spark):
    pages = [(i, f"http://many.org/{i}", link("http://x.net/es/")) for i in range(3000)]
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert got.where("verdict = 'block' and inherited").count() == 3000


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql_gives_the_same(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, sql = queries.queries()[name](spark, data), con.sql(oracles.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[sql.columns.index(c)] for c in columns]) for r in sql.fetchall())


def test_sql_follows_planted_links():
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for row in [(1, "http://a.org/1", link("http://x.net/es/1")), (2, "http://a.org/2", link("/1")), (3, "http://b.org/", link("http://shop.com/")), (4, "http://shop.com/", link("http://x.net/es/1"))]:
        con.execute("INSERT INTO pages VALUES (?, ?, ?)", row)
    got = con.sql(oracles.URL_FILTERS)
    verdict = got.columns.index("verdict")
    assert sorted((r[0], r[verdict]) for r in got.fetchall()) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow")]
