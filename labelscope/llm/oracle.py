"""DuckDB SQL of the queries that SQL can express (plain definitions, not the
operators' methods)."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x,
             max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""

OP3 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 19] AS x FROM (
          SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, i FROM (
          SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM again)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP4 = r"""
WITH u AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), ''), '&'),
              lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref)(=|$)'))) AS params FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END ELSE '' END AS canonical FROM u),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
      ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hit AS (SELECT c.*, action, rhost || rpath AS rule, row_number() OVER (
        PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS rn
      FROM c LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
listed AS (SELECT DISTINCT canonical AS l FROM c
      WHERE canonical <> '' AND regexp_matches(host, '(^|[.-])(adult|bets|casino|spam)([.-]|$)'))
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN l IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM hit LEFT JOIN listed ON canonical = l WHERE rn = 1
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, '0') AS s,
        len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS t,
        md5('42|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
e AS (SELECT *, ('0x' || substr(k, 1, 8))::BIGINT % 4096 AS b FROM d),
blocks AS (SELECT s, b, sum(t)::BIGINT AS n FROM e GROUP BY s, b),
tot AS (SELECT s, sum(n)::BIGINT AS tokens FROM blocks GROUP BY s HAVING sum(n) > 0),
sh AS (SELECT s, tokens, tokens / (sum(tokens) OVER ())::DOUBLE AS p FROM tot),
pack AS (SELECT list(struct_pack(lp := ln(p), t := tokens::DOUBLE)) AS z FROM sh),
bis(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN most <= 1.5 * (1 + 1e-12) THEN lo ELSE mid END,
         CASE WHEN most <= 1.5 * (1 + 1e-12) THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               list_max(list_transform(z, lambda q: exp((lo + hi) / 2 * q.lp) / q.t))
             / list_min(list_transform(z, lambda q: exp((lo + hi) / 2 * q.lp) / q.t)) AS most
        FROM bis, pack WHERE i < 30)),
flat AS (SELECT max(1 / tokens::DOUBLE) / min(1 / tokens::DOUBLE) <= 1.5 * (1 + 1e-12) AS ok FROM sh),
a AS (SELECT CASE WHEN ok THEN 0.0 ELSE ceil(hi * 1e6) / 1e6 END AS a FROM bis, flat WHERE i = 30),
w AS (SELECT s, tokens, exp(a * ln(p)) / sum(exp(a * ln(p))) OVER () AS weight FROM sh, a),
q AS (SELECT s, tokens, round(max(tokens / weight) OVER () * weight)::BIGINT AS quota FROM w),
r AS (SELECT s, quota // tokens AS epochs, quota - (quota // tokens) * tokens AS rest FROM q),
o AS (SELECT blocks.s, b, n, epochs, rest - sum(n) OVER (PARTITION BY blocks.s
        ORDER BY md5('42|block|' || b || '|' || epochs), b) + n AS remain FROM blocks JOIN r ON blocks.s = r.s),
inner_ AS (SELECT e.s, e.b, k, sum(t) OVER (PARTITION BY e.s, e.b ORDER BY k) AS upto, remain
        FROM e JOIN o ON e.s = o.s AND e.b = o.b WHERE remain > 0 AND remain < n),
cuts AS (SELECT s, b, max(k) AS cut FROM inner_ WHERE upto <= remain GROUP BY s, b)
SELECT doc_id, source, t AS n_tokens,
       (coalesce(epochs, 1) + CASE WHEN (remain >= n AND remain > 0) OR coalesce(k <= cut, false) THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM e LEFT JOIN o ON e.s = o.s AND e.b = o.b LEFT JOIN cuts ON e.s = cuts.s AND e.b = cuts.b
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
      WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON vec_id = comp.a LEFT JOIN n ON vec_id = n.a
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWERED}, ''), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
      UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM w JOIN comp ON w.doc_id = comp.a LEFT JOIN n ON n.doc_id = w.doc_id
"""

#: All pairs; the forest searches tables of up to its least budget whole, so both agree there.
OP12 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')
    AND list_aggregate(list_transform(embedding, lambda x: x <> 0), 'bool_or')),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Equal words a period apart, as islands; of stretches with several periods the smallest counts.
OP13 = rf"""
WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w0, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
    4294967295::BIGINT) AS h FROM documents),
a AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END AS ws FROM p),
word AS (SELECT doc_id, len(ws) AS n, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM d),
eq AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y USING (doc_id, word) WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isle AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM eq) GROUP BY doc_id, q, k),
run AS (SELECT doc_id, s, len, min(q) AS q FROM isle WHERE len >= 6 AND len >= 4 * q GROUP BY doc_id, s, len),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min({{'s': s, 'len': len, 'q': q}}, {{'x': -len / q, 's': s, 'q': q}}) AS best FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE = {"op1_warc": OP1, "op3_suffix_dedup": OP3, "op4_url_filter": OP4, "op5_mixing": OP5,
          "op7_hnsw": OP7, "op9_jaccard_tree": OP9,
          "op12_rp_forest": OP12, "op13_periodic_runs": OP13}
