r"""DuckDB SQL for those queries of this subpackage that it can express."""

from statvine.llm.va_file import CENTROIDS, DIMENSIONS, ROUNDS, SCALE


def _va_file() -> str:
    steps = [f"""kept AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept) WHERE c < {CENTROIDS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i}) GROUP BY k)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i} JOIN kept USING (k)) GROUP BY c, pos),
c{i + 1} AS (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{i} GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (k) JOIN c{ROUNDS} z ON z.c = a.c"""


COLLOCATIONS = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM words),
spans AS (SELECT lang, w, i, unnest([1, 2, 3, 4]) AS size FROM places),
f AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f FROM spans WHERE i + size - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, f AS a, size, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, w, size, unnest(generate_series(1, size - 1)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, size, i, unnest([2, 3]) AS s FROM (SELECT *, unnest(generate_series(1, size - 1)) AS i FROM cand)) WHERE s < size AND i + s - 1 <= size GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k JOIN n ON n.lang = k.lang WHERE rank <= 2000"""

_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)(\\??[^#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)(\\??[^#]*)', 2), '')"
_QUERY = "array_to_string(list_filter(string_split(regexp_replace(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)(\\??[^#]*)', 3), '^\\?', ''), '&'), lambda x: NOT regexp_matches(x, '(?s)^((utm_[^=]*|ref|fbclid|gclid)(=.*)?)?$')), '&')"
URL_FILTERS = rf"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(action, rhost, rpath)),
tags AS (SELECT url AS source, unnest([list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?canonical\b') AND regexp_matches(x, '(?is)\bhref\s*=\s*["'']?[^"''\s>]'))[1],
    list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') AND regexp_matches(x, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?[^"''\s>]'))[1]]) AS tag FROM pages WHERE url IS NOT NULL),
hrefs AS (SELECT source, trim(replace(CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1) END, '&amp;', '&')) AS href FROM tags WHERE tag IS NOT NULL),
links AS (SELECT source, CASE WHEN href = '' OR {_HOST.format('source')} = '' THEN NULL WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(source, '(?s)^(.*?:)//', 1) || href
    WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL WHEN starts_with(href, '/') THEN regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) || {_PATH.format('source')} || href
    WHEN starts_with(href, '#') THEN source ELSE regexp_extract(source, '(?s)^(.*?://[^/?#]*)', 1) || '/' || regexp_replace(regexp_replace({_PATH.format('source')}, '^/', ''), '[^/]*$', '') || href END AS target FROM hrefs),
tied AS (SELECT * FROM links WHERE target IS NOT NULL),
urls AS (SELECT url FROM pages UNION SELECT source FROM tied UNION SELECT target FROM tied),
read AS (SELECT url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_QUERY.format('url')} AS query FROM urls),
noded AS (SELECT r.*, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS node,
    (SELECT arg_max(struct_pack(rule := rhost || rpath, action := action), (length(rhost || rpath), action = 'allow')) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS won FROM read r),
sides AS (SELECT DISTINCT s.node AS a, t.node AS b FROM tied JOIN noded s ON s.url = tied.source JOIN noded t ON t.url = tied.target WHERE s.node <> t.node),
both_ AS (SELECT a, b FROM sides UNION SELECT b, a FROM sides),
reach AS (SELECT DISTINCT node AS a, node AS b FROM noded WHERE node IS NOT NULL UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON both_.a = reach.b),
told AS (SELECT reach.a AS node, bool_or(won.action = 'allow' AND reach.a = reach.b) AS allowed, bool_or(won.action = 'block') AS blocked FROM reach JOIN noded ON noded.node = reach.b GROUP BY reach.a)
SELECT p.page_id, n.host, n.path, n.won.rule AS rule, coalesce(n.won.action, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
n.won IS NULL AND (coalesce(allowed, false) OR coalesce(blocked, false)) AS inherited FROM pages p JOIN noded n ON n.url IS NOT DISTINCT FROM p.url LEFT JOIN told USING (node)"""

SQL = {"op11_va_file": _va_file(), "op12_collocations": COLLOCATIONS, "op13_url_filters": URL_FILTERS}
