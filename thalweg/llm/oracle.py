"""DuckDB SQL for the corpus queries that SQL can express."""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM s),
r AS (SELECT *, source_size * 6 // w AS r FROM w),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS t,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c,
         CAST(sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws
  FROM r),
g AS (SELECT *, 3 * source_size * ws <= w * (t - c) AS is_full FROM f),
h AS (
  SELECT *, CAST(t - coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS rest,
         CAST(sum(CASE WHEN NOT is_full THEN w END) OVER () AS BIGINT) AS free
  FROM g),
x AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target,
         CASE WHEN is_full THEN 3 * source_size ELSE w * rest // free END AS budget
  FROM h),
p AS (
  SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d)
SELECT p.doc_id, p.size, x.source_size, x.target,
       CAST(CASE WHEN x.source_size = 0 THEN 0
            ELSE (x.budget // x.source_size) * p.size + greatest(0, least(p.size, x.budget % x.source_size - p.before)) END AS BIGINT) AS taken
FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.keep IS NOT NULL AND g.keep IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.keep IS DISTINCT FROM p.page_id THEN g.keep END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""

OP8 = r"""
WITH r(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                           ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM u),
m AS (SELECT page_id, host, path,
             (SELECT max({'n': length(h || q), 'rule': h || q, 'verdict': v}) FROM r
              WHERE (s.host = h OR ends_with(s.host, '.' || h)) AND starts_with(s.path, q)) AS best
      FROM s)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM m
"""

OP1 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
r AS (SELECT rid, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
n AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM n),
s AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY rid, run),
l AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM s),
c AS (SELECT l.rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM l JOIN d USING (rid) GROUP BY l.rid),
k AS (SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
             CASE WHEN c.rid IS NULL THEN h ELSE head || substr(h, 2 * tail + 1) END AS kept
      FROM d LEFT JOIN c USING (rid))
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, CAST(n_bytes AS BIGINT) AS n_bytes,
       sha256(unhex(kept)) AS kept_sha256, TRY(decode(unhex(kept))) AS kept_text
FROM k
"""

OP7 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
x AS (SELECT rid, n, unnest(sh) AS t FROM (SELECT rid, len(sh) AS n, sh FROM s)),
p AS (SELECT a.rid AS a, b.rid AS b FROM x a JOIN x b ON a.t = b.t AND a.rid < b.rid
      GROUP BY a.rid, b.rid HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(rid, other) AS (SELECT rid, rid FROM s UNION SELECT c.rid, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT c.rid, min(s.doc_id) AS component_id FROM c JOIN s ON s.rid = c.other GROUP BY c.rid),
n AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id
FROM s JOIN m USING (rid) LEFT JOIN n USING (rid)
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, row_number() OVER () AS rid, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid < b.rid AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(rid, other) AS (SELECT rid, rid FROM v UNION SELECT c.rid, e.b FROM c JOIN e ON e.a = c.other),
m AS (SELECT c.rid, min(v.vec_id) AS component_id FROM c JOIN v ON v.rid = c.other GROUP BY c.rid),
n AS (SELECT a AS rid, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, m.component_id, coalesce(v.vec_id = m.component_id, false) AS kept
FROM v JOIN m USING (rid) LEFT JOIN n USING (rid)
"""

ORACLES = {"op1_suffix": OP1, "op3_mixing": OP3, "op4_warc": OP4, "op7_ngramjoin": OP7, "op8_urlfilter": OP8, "op9_vectors": OP9}
