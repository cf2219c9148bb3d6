"""SQL for the operators that SQL can express."""

from __future__ import annotations

import string

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP7 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
m AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m)),
r AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, s, e FROM (
        SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM r
        UNION ALL SELECT d.doc_id, coalesce(x.e, 0), d.n FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) AS x ON x.doc_id = d.doc_id) WHERE e > s),
h AS (SELECT k.doc_id, string_agg(hex(array_slice(d.b, k.s + 1, k.e)), '' ORDER BY k.s) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
c AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans, sha256(unhex(coalesce(h.kept, ''))) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id"""

OP9 = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n AS na ON na.doc_id = c.a JOIN n AS nb ON nb.doc_id = c.b WHERE 100 * c.c >= 80 * (na.n + nb.n - c.c)),
reach AS (SELECT doc_id, doc_id AS r FROM t UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, x.component_id, x.doc_id = x.component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) AS x LEFT JOIN n ON n.doc_id = x.doc_id"""

_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

OP10 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORDS}) AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i + 1, i + 10), ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
v AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p + 1, p + n), ' ') AS k FROM (SELECT d.doc_id, d.w, z.n, unnest(range(0, len(d.w) - z.n + 1)) AS p FROM d JOIN (SELECT DISTINCT n FROM q) AS z ON len(d.w) >= z.n)),
h AS (SELECT DISTINCT v.doc_id, v.p, v.n, q.item_id FROM v JOIN q ON q.k = v.k AND q.n = v.n),
c AS (SELECT doc_id, count(DISTINCT at_) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS at_ FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, '<P>' || substr(t, 1, a) AS pre, '<M>' || substr(t, a + 1, b - a) AS mid, '<S>' || substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(t) AS restored_sha256,
  CASE WHEN form <> 'plain' THEN a > 0 AND a < n AND NOT regexp_matches(substr(t, a, 2), '[\x09-\x0D\x20]') END AS prefix_splits_word,
  CASE WHEN form <> 'plain' THEN b > 0 AND b < n AND NOT regexp_matches(substr(t, b, 2), '[\x09-\x0D\x20]') END AS middle_splits_word
FROM p"""

_TERMS = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

OP11 = f"""
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all({_LOW}, {_TERMS}) AS w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
i AS (SELECT p.r, p.doc_id, p.term, (1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.n) // c.l)) AS impact FROM p, c),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOW}, {_TERMS})) AS term FROM benchmark),
s AS (SELECT q.item_id, i.r, i.doc_id, sum(f.w * i.impact)::BIGINT AS score FROM q JOIN f ON f.term = q.term JOIN i ON i.term = q.term GROUP BY ALL HAVING sum(f.w * i.impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 50"""
