"""The views of the test tables once more, in SQL for the oracle."""

from __future__ import annotations

from ..functions.text import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def terms(column: str) -> str:
    return f"list_slice(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP})), 1, 8)"


def label(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({column})), '[ _-]+', '-', 'g'), '^-+|-+$', '', 'g')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


RECORDS = """
records AS (
  SELECT d.doc_id AS id, d.text AS content, substring(d.text, 1, 200) AS context_summary, 'p' || (d.doc_id % 3) AS agent_type, d.doc_id % 2 AS user_id,
    CASE WHEN d.lang = 'en' THEN 'en' ELSE 'other' END AS project_id, 'c0' AS customer_id, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
    CASE WHEN d.doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(d.doc_id) - to_days((d.doc_id % 30)::INTEGER) END AS occurred_at,
    d.doc_id % 5 AS hit_count, d.doc_id % 13 <> 0 AS is_active, e.embedding::DOUBLE[] AS embedding,
    list_sort(list_distinct(list_concat(list_slice(list_filter(regexp_extract_all(lower(d.text), '[a-z0-9]+'), lambda w: length(w) >= 6), 1, 8),
      ['by:u' || (d.doc_id % 2)], CASE WHEN l.quality = 1 AND d.doc_id % 17 = 0 THEN ['pinned'] ELSE []::VARCHAR[] END))) AS tags
  FROM documents AS d LEFT JOIN embeddings AS e ON e.vec_id = d.doc_id LEFT JOIN labels AS l ON l.doc_id = d.doc_id)"""

QUESTIONS = """
questions AS (
  SELECT b.item_id AS qid, b.text AS query, e.embedding::DOUBLE[] AS vector, CASE WHEN b.item_id % 2 = 1 THEN TIMESTAMP '2024-01-10' END AS as_of
  FROM benchmark AS b LEFT JOIN embeddings AS e ON e.vec_id = b.item_id)"""

TURNS = """
turns AS (
  SELECT conv_id, turn AS turn_pos, 'D' || conv_id || ':' || turn AS turn_id, role AS speaker, text, TIMESTAMP '2024-01-01' + to_days(conv_id::INTEGER) + to_minutes(turn) AS occurred_at
  FROM conversations)"""

OWN = "user_id = 0 AND agent_type = 'p0' AND project_id = 'en' AND is_active"
TEAM = "customer_id = 'c0' AND project_id = 'en' AND NOT (user_id = 0 AND agent_type = 'p0') AND is_active"
NOW = "TIMESTAMP '2024-03-01'"


def legs(name: str, scope: str, limit: int, lexical_any: bool = True) -> str:
    """CTEs ``<name>_scoped``, the legs ``_recent _lex _tag _vec`` and the ranked candidates ``<name>_ranked`` of one scope."""
    bound = "(q.as_of IS NULL OR r.occurred_at <= q.as_of)"
    all_terms = "" if lexical_any else " AND overlap = len(terms)"
    return f"""
{name}_scoped AS (SELECT *, lower(concat_ws(' ', content, context_summary)) AS hay FROM records WHERE {scope}),
{name}_asked AS (SELECT *, {terms("query")} AS terms FROM questions),
{name}_recent AS (SELECT q.qid, r.id, row_number() OVER (PARTITION BY q.qid ORDER BY r.created_at DESC, r.id) - 1 AS rank FROM {name}_scoped AS r JOIN {name}_asked AS q ON {bound} QUALIFY rank < {limit}),
{name}_hits AS (SELECT q.qid, q.terms, r.id, r.created_at, coalesce(list_sum(list_transform(q.terms, lambda t: CASE WHEN contains(r.hay, t) THEN 1 ELSE 0 END)), 0) AS overlap FROM {name}_scoped AS r JOIN {name}_asked AS q ON {bound}),
{name}_lex AS (SELECT qid, id, overlap, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, created_at DESC, id) - 1 AS rank FROM {name}_hits WHERE overlap > 0{all_terms} QUALIFY rank < {limit}),
{name}_labels AS (SELECT DISTINCT qid, as_of, label FROM (SELECT qid, as_of, unnest(list_concat(list_transform(terms, lambda t: {label("t")}), [{label("query")}])) AS label FROM {name}_asked) WHERE label <> ''),
{name}_met AS (SELECT q.qid, r.id, r.created_at, count(*) AS labels FROM (SELECT id, created_at, occurred_at, unnest(tags) AS label FROM {name}_scoped) AS r JOIN {name}_labels AS q ON q.label = r.label AND {bound} GROUP BY q.qid, r.id, r.created_at),
{name}_tag AS (SELECT qid, id, labels, row_number() OVER (PARTITION BY qid ORDER BY labels DESC, created_at DESC, id) - 1 AS rank FROM {name}_met QUALIFY rank < {limit}),
{name}_close AS (SELECT q.qid, r.id, round(list_cosine_similarity(r.embedding, q.vector), 9) AS cosine FROM {name}_scoped AS r JOIN {name}_asked AS q ON {bound} WHERE r.embedding IS NOT NULL AND q.vector IS NOT NULL),
{name}_vec AS (SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) - 1 AS rank FROM {name}_close QUALIFY rank < {limit}),
{name}_ids AS (SELECT qid, id FROM {name}_recent UNION SELECT qid, id FROM {name}_lex UNION SELECT qid, id FROM {name}_tag UNION SELECT qid, id FROM {name}_vec),
{name}_scored AS (
  SELECT i.qid, i.id, coalesce(1.0::DOUBLE / (60 + l.rank), 0.0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0.0) + coalesce(2.0::DOUBLE / (60 + v.rank), 0.0) AS rrf,
    r.hit_count, r.created_at, r.occurred_at, pow(2.0, -greatest(epoch_us({NOW}) - epoch_us(r.created_at), 0) / 86400000000.0 / 7.0) AS decay
  FROM {name}_ids AS i JOIN {name}_scoped AS r ON r.id = i.id LEFT JOIN {name}_lex AS l ON l.qid = i.qid AND l.id = i.id
    LEFT JOIN {name}_tag AS t ON t.qid = i.qid AND t.id = i.id LEFT JOIN {name}_vec AS v ON v.qid = i.qid AND v.id = i.id),
{name}_ranked AS (SELECT *, CASE WHEN rrf > 0 THEN 1000.0 ELSE 0.0 END + 100 * rrf + 10 * ln(1 + hit_count) + decay AS salience,
    row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, hit_count DESC, decay DESC, created_at DESC, id) AS rank FROM {name}_scored)"""


def chosen(name: str, source: str, k: str, fresh: str = "coalesce(occurred_at, created_at)") -> str:
    """CTE ``<name>``: the top and reserved places of ``source`` for a (column or literal) k."""
    r = f"least(3, greatest({k}, 0))"
    return f"""
{name}_flag AS (SELECT *, greatest({k}, 0) - {r} AS head, {r} AS r, rank <= greatest({k}, 0) - {r} AS is_top, rrf > 0 AS matched FROM {source}),
{name}_fresh AS (SELECT *, row_number() OVER (PARTITION BY qid, is_top ORDER BY matched DESC, CASE WHEN matched THEN {fresh} END DESC NULLS LAST, CASE WHEN NOT matched THEN created_at END DESC NULLS LAST, rank) AS fresh_rank FROM {name}_flag),
{name} AS (SELECT *, CASE WHEN is_top THEN rank ELSE head + fresh_rank END AS position FROM {name}_fresh WHERE is_top OR fresh_rank <= r)"""


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{select}"
