"""DuckDB statements of the queries that SQL can express."""

OP8 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), r AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches(host || path, '^([^/]*[.-])?spam-') THEN 'block'
            WHEN regexp_matches(host || path, '^[^/]*/([^/]*/)*(click|track)/') THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: kind, expression, group that counts, least length (a run of hex digits is matched whole, so its least length may stand in the expression)
SPANS = (("assign", rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24),
         ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1), ("forge_token", "gh[pousr]_[A-Za-z0-9]+", 0, 40), ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
         ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 30))


def _spans() -> str:
    """Matches of each kind with their starts: what lies between matches, and the matches, add up to places."""
    def one(nth: int, kind: str, expression: str, group: int, least: int) -> str:
        e = expression.replace("'", "''")
        return f"""SELECT r, {nth} AS nth, '{kind}' AS kind, s, s + length(m[i]) AS e FROM (
  SELECT r, m, g, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, regexp_extract_all(text, '{e}') AS m, regexp_extract_all(text, '{e}', {group}) AS g,
               string_split_regex(text, '{e}') AS gaps, unnest(range(1, len(regexp_extract_all(text, '{e}')) + 1)) AS i FROM d)
  ) WHERE length(g[i]) >= {least}"""

    return "\nUNION ALL\n".join(one(i, *row) for i, row in enumerate(SPANS))


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
{_spans()}
), t AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, nth) FILTER (nth < 3) AS base,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, nth) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""

_USABLE = """SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

OP4 = f"""
WITH RECURSIVE u AS ({_USABLE}),
links AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, least(min(b), a) AS root FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP5 = f"""
WITH u AS ({_USABLE}),
d AS (SELECT q.id AS query_id, c.id AS vec_id, list_distance(q.v, c.v) AS score FROM u q JOIN u c ON q.id <> c.id WHERE q.id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""


def _rounds(n: int) -> str:
    """Assignment and floored means, n times."""
    apart = "CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    out = []
    for i in range(n + 1):
        out.append(f"a{i} AS (SELECT r, min(struct_pack(d := {apart}, c := c.c)) AS best FROM kept k, c{i} c GROUP BY r)")
        if i < n:
            out.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY place) AS v FROM (
  SELECT best.c AS c, place, sum(v[place]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, 65) t(place) GROUP BY best.c, place) GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(out)


OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 2097152)) = 0
), c0 AS (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL) WHERE c < 16),
{_rounds(3)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 ON c3.c = best.c
"""

#: CRC-32 of the digits of an id: a byte at a time, eight halvings each.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT))"""

OP13 = f"""
WITH o AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, length(coalesce(text, '')) AS size, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS at
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, o.at AS depth, o.size, o.said FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.at <= c.h),
taken AS (SELECT c.conv_id, any_value(c.h) AS h, count(b.depth) AS n FROM c LEFT JOIN b USING (conv_id) GROUP BY c.conv_id),
rebuilt AS (SELECT * FROM b UNION ALL SELECT o.conv_id, t.n + o.at - t.h, o.size, o.said FROM o JOIN taken t USING (conv_id) WHERE o.at > t.h),
p AS (
  SELECT conv_id, depth, size, list(said) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM c
), n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM p GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS k FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN kids USING (path)),
sub AS (SELECT a.path, sum((f.n_convs - 1) * f.size) AS saved, count(*) FILTER (f.k = 0) AS leaves FROM f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN last USING (conv_id, depth) GROUP BY path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.k AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM f JOIN sub USING (path) LEFT JOIN f up ON f.depth > 0 AND up.path = f.path[1:f.depth - 1] LEFT JOIN ends ON ends.path = f.path
"""

ORACLES = {"op3_blob_ledger_scan": OP3, "op4_nn_descent_links": OP4, "op5_block_search": OP5, "op8_url_rules": OP8, "op12_va_file_assignment": OP12, "op13_prefix_trie_nodes": OP13}
