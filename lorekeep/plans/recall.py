"""Queries of the recall core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..operators import lexicon, proximity
from ..operators import recall as R
from ..operators.scope import Caller, between, browsing, own, team
from ..operators.sizes import small
from ..sources import tables as T
from ..sources.shared import new_path
from . import prelude as P

CALLER = Caller(0, "p0", "en", "c0")
#: The defaults: what a caller gets who sets nothing.
CONFIG = Config()
LIMIT, K = CONFIG.candidate_limit, str(CONFIG.k)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    return R.prepared(T.records(spark, d).where(own(CALLER)))


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


_BASE = (P.RECORDS, P.QUESTIONS)
_LEGS = (*_BASE, P.legs("own", P.OWN, LIMIT))


@_add("scope_scan", P.query(P.RECORDS, select=f"SELECT id, {P.stamp('created_at')} AS created_at FROM records WHERE {P.OWN}"))
def scope_scan(spark, d):
    return T.records(spark, d).where(own(CALLER)).select("id", _stamp("created_at"))


@_add("scope_own", P.query(P.RECORDS, select="SELECT user_id, agent_type, project_id, count(*) AS n, sum(hit_count)::BIGINT AS hits FROM records WHERE is_active GROUP BY ALL"))
def scope_own(spark, d):
    """All callers at once: the scope as a key."""
    return T.records(spark, d).where("is_active").groupBy("user_id", "agent_type", "project_id").agg(F.count("*").alias("n"), F.sum("hit_count").alias("hits"))


@_add("scope_team", P.query(P.RECORDS, select=f"SELECT id, user_id, agent_type FROM records WHERE {P.TEAM}"))
def scope_team(spark, d):
    return T.records(spark, d).where(team(CALLER)).select("id", "user_id", "agent_type")


@_add("asof_filter", P.query(*_BASE, select=f"SELECT q.qid, r.id FROM records AS r JOIN questions AS q ON q.as_of IS NULL OR r.occurred_at <= q.as_of WHERE {P.OWN}"))
def asof_filter(spark, d):
    from ..operators.scope import as_of

    return T.records(spark, d).where(own(CALLER)).select("id", "occurred_at").join(small(T.questions(spark, d).select("qid", "as_of"), CONFIG.max_broadcast_bytes), as_of()).select("qid", "id")


@_add("time_range", P.query(P.RECORDS, select=f"SELECT id, {P.stamp('occurred_at')} AS occurred_at FROM records WHERE occurred_at >= TIMESTAMP '2023-12-25' AND occurred_at <= TIMESTAMP '2024-01-10'"))
def time_range(spark, d):
    return T.records(spark, d).where(between("2023-12-25 00:00:00", "2024-01-10 00:00:00")).select("id", _stamp("occurred_at"))


@_add("asof_end_of_day", P.query(P.RECORDS, select="SELECT id FROM records WHERE occurred_at <= date_trunc('day', TIMESTAMP '2024-01-10 13:30:00') + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"))
def asof_end_of_day(spark, d):
    from ..functions.dates import end_of_day

    return T.records(spark, d).where(F.col("occurred_at") <= end_of_day(F.lit("2024-01-10 13:30:00").cast("timestamp"))).select("id")


@_add("current_facts", P.query(P.RECORDS, select="SELECT id FROM records WHERE is_active AND id % 7 <> 0"))
def current_facts(spark, d):
    from ..operators.scope import current

    ended = T.records(spark, d).withColumn("valid_to", F.when(F.col("id") % 7 == 0, F.col("created_at")))
    return ended.where(current() & F.col("is_active")).select("id")


@_add("never_merge", P.query(P.RECORDS, select="SELECT id FROM records WHERE NOT list_contains(tags, 'pinned') AND NOT list_contains(tags, 'confidential')"))
def never_merge(spark, d):
    from ..operators.scope import never_merge as mergeable

    return mergeable(T.records(spark, d), CONFIG.never_merge).select("id")


@_add("query_terms", P.query(P.QUESTIONS, select=f"SELECT qid, array_to_string({P.terms('query')}, ' ') AS terms FROM questions"))
def query_terms(spark, d):
    return T.questions(spark, d).select("qid", F.array_join(text.query_terms(F.col("query")), " ").alias("terms"))


@_add("query_labels", P.query(P.QUESTIONS, select=f"SELECT qid, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM (SELECT qid, unnest(list_concat(list_transform({P.terms('query')}, lambda t: {P.label('t')}), [{P.label('query')}])) AS label FROM questions) WHERE label <> '' GROUP BY qid"))
def query_labels(spark, d):
    return T.questions(spark, d).select("qid", F.array_join(F.array_sort(text.query_labels(F.col("query"))), "|").alias("labels"))


@_add("term_overlap", P.query(*_LEGS, select="SELECT qid, id, overlap::BIGINT AS overlap FROM own_hits WHERE overlap > 0"))
def term_overlap(spark, d):
    return R.term_hits(_scoped(spark, d), T.questions(spark, d), CONFIG).drop("created_at")


@_add("recent_leg", P.query(*_LEGS, select="SELECT qid, id, rank FROM own_recent"))
def recent_leg(spark, d, config=CONFIG):
    return R.recent_leg(_scoped(spark, d), T.questions(spark, d), config)


@_add("lexical_leg", P.query(*_LEGS, select="SELECT qid, id, rank, overlap::BIGINT AS overlap FROM own_lex"))
def lexical_leg(spark, d, config=CONFIG):
    return R.lexical_leg(_scoped(spark, d), T.questions(spark, d), config)


@_add("lexical_or_vs_and", P.query(*_BASE, P.legs("own", P.OWN, LIMIT), P.legs("every", P.OWN, LIMIT, False), select="SELECT o.qid, count(*) AS n_or, coalesce(any_value(a.n), 0) AS n_and FROM own_lex AS o LEFT JOIN (SELECT qid, count(*) AS n FROM every_lex GROUP BY qid) AS a ON a.qid = o.qid GROUP BY o.qid"))
def lexical_or_vs_and(spark, d, config=CONFIG):
    rows, asked = _scoped(spark, d), T.questions(spark, d)
    either = R.lexical_leg(rows, asked, config).groupBy("qid").agg(F.count("*").alias("n_or"))
    every = R.lexical_leg(rows, asked, config.but(lexical_any=False)).groupBy("qid").agg(F.count("*").alias("n"))
    return either.join(every, "qid", "left").select("qid", "n_or", F.coalesce("n", F.lit(0)).alias("n_and"))


@_add(
    "lexical_tf_leg",
    P.query(
        *_LEGS,
        "held AS (SELECT id, occurred_at, created_at, token, count(*) AS tf FROM (SELECT id, occurred_at, created_at, unnest(regexp_extract_all(hay, '[a-z0-9]+')) AS token FROM own_scoped) GROUP BY ALL)",
        "asked AS (SELECT DISTINCT qid, as_of, unnest(terms) AS token FROM own_asked)",
        "scored AS (SELECT q.qid, h.id, h.created_at, sum(tf)::BIGINT AS score FROM held AS h JOIN asked AS q ON q.token = h.token AND (q.as_of IS NULL OR h.occurred_at <= q.as_of) GROUP BY ALL)",
        select=f"SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created_at DESC, id) - 1 AS rank, score FROM scored QUALIFY rank < {LIMIT}",
    ),
)
def lexical_tf_leg(spark, d, config=CONFIG):
    return R.token_leg(_scoped(spark, d), T.questions(spark, d), config)


@_add("tag_leg", P.query(*_LEGS, select="SELECT qid, id, rank, labels FROM own_tag"))
def tag_leg(spark, d, config=CONFIG):
    return R.tag_leg(_scoped(spark, d), T.questions(spark, d), config)


@_add("vector_leg", P.query(*_LEGS, select="SELECT qid, id, rank, cosine FROM own_vec"))
def vector_leg(spark, d, config=CONFIG):
    return R.vector_leg(_scoped(spark, d), T.questions(spark, d), config)


@_add("vector_index_leg", P.query(*_LEGS, select="SELECT qid, id, rank, cosine FROM own_vec"))
def vector_index_leg(spark, d):
    """The vector leg by the stored index, its lists opened again where they may hold a nearer record: the exact rows."""
    index = proximity.build(T.records(spark, d), new_path(spark, "proximity"), lists=16)
    return proximity.index_leg(index, _scoped(spark, d), T.questions(spark, d), own(CALLER), CONFIG)


@_add("lexical_index_leg", P.query(*_LEGS, select="SELECT qid, id, rank, overlap::BIGINT AS overlap FROM own_lex"))
def lexical_index_leg(spark, d):
    """The lexical leg by the stored dictionary and postings; the records come in two parts."""
    rows = T.records(spark, d)
    index = lexicon.build(rows.where("id % 3 > 0"), new_path(spark, "lexicon"))
    return lexicon.index_leg(lexicon.append(index, rows.where("id % 3 = 0")), T.questions(spark, d), own(CALLER), CONFIG)


@_add("lexical_stem_leg")
def lexical_stem_leg(spark, d):
    """Records by stems that they share with a question; SQL has no stemmer, so this and the next are tested against loops."""
    return R.stem_leg(_scoped(spark, d), T.questions(spark, d), CONFIG)


@_add("lexical_stem_density")
def lexical_stem_density(spark, d):
    """Records with all stems of a question's first three terms, by the density of the shortest windows that hold them."""
    asked = T.questions(spark, d).withColumn("query", F.array_join(text.query_terms(F.col("query"), 3), " "))
    return R.stem_leg(R.prepared(T.records(spark, d).where("is_active")), asked, CONFIG.but(lexical_any=False))


@_add("rrf_fuse", P.query(*_LEGS, select="SELECT qid, id, round(rrf, 9) AS rrf FROM own_scored WHERE rrf > 0"))
def rrf_fuse(spark, d, config=CONFIG):
    rows, asked = _scoped(spark, d), T.questions(spark, d)
    legs = {"lexical": (R.lexical_leg(rows, asked, config), 1.0), "tag": (R.tag_leg(rows, asked, config), 1.0), "vector": (R.vector_leg(rows, asked, config), 2.0)}
    return R.fuse(legs, config).select("qid", "id", F.round("rrf", 9).alias("rrf"))


def _candidates(spark, d, config=CONFIG):
    return R.candidates(_scoped(spark, d), T.questions(spark, d), T.now(), config)


@_add("rank_final", P.query(*_LEGS, select="SELECT qid, id, rank FROM own_ranked"))
def rank_final(spark, d, config=CONFIG):
    return _candidates(spark, d, config).select("qid", "id", "rank")


@_add("salience", P.query(*_LEGS, select="SELECT qid, id, round(salience, 6) AS salience FROM own_ranked"))
def salience(spark, d, config=CONFIG):
    return _candidates(spark, d, config).select("qid", "id", F.round("salience", 6).alias("salience"))


@_add("reserve_event", P.query(*_LEGS, P.chosen("own", "own_ranked", K), select="SELECT qid, position, id, matched FROM own"))
def reserve_event(spark, d, config=CONFIG):
    return R.chosen(_candidates(spark, d, config), F.lit(config.k), config).select("qid", "position", "id", "matched")


@_add("reserve_created", P.query(*_LEGS, P.chosen("own", "own_ranked", K, "created_at"), select="SELECT qid, position, id, matched FROM own"))
def reserve_created(spark, d, config=CONFIG):
    return R.chosen(_candidates(spark, d, config), F.lit(config.k), config.but(event_reserve=False)).select("qid", "position", "id", "matched")


@_add("recall_own", P.query(*_LEGS, P.chosen("own", "own_ranked", K), select="SELECT qid, position, id, round(rrf, 9) AS rrf, round(salience, 6) AS salience, matched FROM own"))
def recall_own(spark, d, config=CONFIG):
    out = R.own_recall(T.records(spark, d), T.questions(spark, d), CALLER, T.now(), config)
    return out.select("qid", "position", "id", F.round("rrf", 9).alias("rrf"), F.round("salience", 6).alias("salience"), "matched")


_TWO = (
    *_BASE, P.legs("mine", P.OWN, LIMIT), P.legs("team", P.TEAM, LIMIT), P.chosen("theirs", "team_ranked", "8"),
    f"mine_k AS (SELECT m.*, {K} - coalesce(t.n, 0) AS own_k FROM mine_ranked AS m LEFT JOIN (SELECT qid, count(*)::INTEGER AS n FROM theirs GROUP BY qid) AS t ON t.qid = m.qid)",
    P.chosen("own", "mine_k", "own_k"),
    "both_sections AS (SELECT qid, position, id, hit_count, salience, matched, 'own' AS section FROM own UNION ALL SELECT qid, position, id, hit_count, salience, matched, 'team' FROM theirs)",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY section, position) AS place FROM both_sections)",
)


def _two(spark, d, config=CONFIG):
    return R.two_sections(T.records(spark, d), T.questions(spark, d), CALLER, T.now(), config)


@_add("two_section", P.query(*_TWO, select="SELECT qid, place, section, id, matched FROM placed"))
def two_section(spark, d, config=CONFIG):
    return _two(spark, d, config).select("qid", "place", "section", "id", "matched")


@_add("two_section_disjoint", P.query(P.RECORDS, select=f"SELECT (SELECT count(*) FROM records WHERE {P.OWN}) AS n_own, (SELECT count(*) FROM records WHERE {P.TEAM}) AS n_team, (SELECT count(*) FROM records WHERE ({P.OWN}) AND ({P.TEAM})) AS n_both"))
def two_section_disjoint(spark, d):
    return T.records(spark, d).agg(F.count_if(own(CALLER)).alias("n_own"), F.count_if(team(CALLER)).alias("n_team"), F.count_if(own(CALLER) & team(CALLER)).alias("n_both"))


_BY = "array_to_string(list_sort(list_transform(list_filter(tags, lambda t: starts_with(t, 'by:')), lambda t: substring(t, 4))), ', ')"
_SUMMARY = "trim(coalesce(nullif(context_summary, ''), content))"


@_add("recall_full", P.query(*_TWO, select=f"SELECT p.qid, p.place, p.section, p.id, p.hit_count, round(p.salience, 6) AS salience, p.matched, {_SUMMARY} AS summary, strftime(r.occurred_at, '%Y-%m-%d') AS occurred_on, {_BY} AS by FROM placed AS p JOIN records AS r ON r.id = p.id"))
def recall_full(spark, d, config=CONFIG):
    """The flagship: two-section hybrid recall with payload, for all questions in one plan."""
    out = R.recall(T.records(spark, d), T.questions(spark, d), CALLER, T.now(), config)
    return out.withColumn("salience", F.round("salience", 6))


@_add("recall_debug", P.query(*_LEGS, P.chosen("own", "own_ranked", K), select="SELECT o.qid, o.position, r.id, round(o.rrf, 9) AS score, o.matched, r.agent_type AS persona FROM own AS o LEFT JOIN records AS r ON r.id = o.id"))
def recall_debug(spark, d, config=CONFIG):
    rows = T.records(spark, d)
    plan = R.own_recall(rows, T.questions(spark, d), CALLER, T.now(), config)
    return plan.select("qid", "position", "id", F.round("rrf", 9).alias("score"), "matched").join(rows.select("id", F.col("agent_type").alias("persona")), "id", "left")


@_add("recall_payload", P.query(P.RECORDS, select=f"SELECT id, {_SUMMARY} AS summary, strftime(occurred_at, '%Y-%m-%d') AS occurred_on, hit_count AS hits, {_BY} AS by FROM records"))
def recall_payload(spark, d):
    return T.records(spark, d).select("id", R.recalled_summary().alias("summary"), F.date_format("occurred_at", "yyyy-MM-dd").alias("occurred_on"), F.col("hit_count").alias("hits"), R.contributors(F.col("tags")).alias("by"))


@_add("contributors", P.query(P.RECORDS, select=f"SELECT {_BY} AS by, count(*) AS n FROM records GROUP BY 1"))
def contributors(spark, d):
    return T.records(spark, d).groupBy(R.contributors(F.col("tags")).alias("by")).agg(F.count("*").alias("n"))


@_add(
    "hit_writeback",
    P.query(
        *_LEGS, P.chosen("own", "own_ranked", K), "used AS (SELECT id, max(salience) AS salience, bool_or(matched) AS matched FROM own GROUP BY id)",
        select=f"SELECT r.id, r.hit_count + CASE WHEN u.matched THEN 1 ELSE 0 END AS hit_count, round(u.salience, 6) AS salience, CASE WHEN u.id IS NOT NULL THEN '2024-03-01 00:00:00' END AS last_used_at, CASE WHEN u.matched THEN 'p0' END AS last_hit_by FROM records AS r LEFT JOIN used AS u ON u.id = r.id",
    ),
)
def hit_writeback(spark, d, config=CONFIG):
    rows = T.records(spark, d)
    plan = R.own_recall(rows, T.questions(spark, d), CALLER, T.now(), config)
    return R.with_hits(rows, plan, CALLER.agent_type, T.now()).select("id", "hit_count", F.round("salience", 6).alias("salience"), _stamp("last_used_at"), "last_hit_by")


@_add("http_search", P.query(*_LEGS, P.chosen("own", "own_ranked", K), select="SELECT o.qid, o.position, CASE WHEN r.occurred_at IS NOT NULL THEN '[' || strftime(r.occurred_at, '%Y-%m-%dT%H:%M:%S+00:00') || '] ' || r.content ELSE r.content END AS evidence FROM own AS o JOIN records AS r ON r.id = o.id"))
def http_search(spark, d, config=CONFIG):
    rows = T.records(spark, d)
    plan = R.own_recall(rows, T.questions(spark, d), CALLER, T.now(), config).select("qid", "position", "id")
    dated = F.concat(F.lit("["), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("] "), F.col("content"))
    return plan.join(rows.select("id", "occurred_at", "content"), "id").select("qid", "position", F.coalesce(dated, "content").alias("evidence"))


@_add("foreign_evidence", P.query(*_LEGS, P.chosen("own", "own_ranked", K), select=f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE o.id NOT IN (SELECT id FROM records WHERE {P.OWN})) AS n_foreign FROM own AS o"))
def foreign_evidence(spark, d, config=CONFIG):
    rows = T.records(spark, d)
    plan = R.own_recall(rows, T.questions(spark, d), CALLER, T.now(), config)
    foreign = plan.join(rows.where(own(CALLER)).select("id", F.lit(1).alias("mine")), "id", "left")
    return foreign.agg(F.count("*").alias("n_rows"), F.count_if(F.col("mine").isNull()).alias("n_foreign"))


@_add("count_facts", P.query(P.RECORDS, select=f"SELECT count(*) AS n FROM records WHERE {P.OWN}"))
def count_facts(spark, d):
    return T.records(spark, d).where(own(CALLER)).agg(F.count("*").alias("n"))


@_add("active_count", P.query(P.RECORDS, select="SELECT project_id, agent_type, count(*) AS n FROM records WHERE is_active GROUP BY ALL"))
def active_count(spark, d):
    return T.records(spark, d).where("is_active").groupBy("project_id", "agent_type").agg(F.count("*").alias("n"))


@_add("personas", P.query(P.RECORDS, select="SELECT DISTINCT agent_type FROM records WHERE is_active ORDER BY 1"))
def personas(spark, d):
    return T.records(spark, d).where("is_active").select("agent_type").distinct().orderBy("agent_type")


# browsing

_B_OWN = "customer_id = 'c0' AND project_id = 'en' AND is_active AND agent_type = 'p0'"


@_add("browse_scope", P.query(P.RECORDS, select=f"SELECT id, CASE WHEN user_id = 0 THEN 'own' ELSE 'team' END AS scope FROM records WHERE {_B_OWN}"))
def browse_scope(spark, d):
    rows = T.records(spark, d)
    one = rows.where(browsing(CALLER, "own")).select("id", F.lit("own").alias("scope"))
    return one.unionByName(rows.where(browsing(CALLER, "team")).select("id", F.lit("team").alias("scope")))


@_add("browse_min_hits", P.query(P.RECORDS, select=f"SELECT id, hit_count FROM records WHERE {_B_OWN} AND hit_count >= 3"))
def browse_min_hits(spark, d):
    return T.records(spark, d).where(browsing(CALLER, "all") & (F.col("hit_count") >= 3)).select("id", "hit_count")


_ASKED = "the thond and ing retion"
_TERMS = P.terms(f"'{_ASKED}'")


@_add("lexical_any", P.query(P.RECORDS, select=f"SELECT id FROM records WHERE {_B_OWN} AND list_sum(list_transform({_TERMS}, lambda t: CASE WHEN contains(lower(concat_ws(' ', content, context_summary)), t) THEN 1 ELSE 0 END)) > 0"))
def lexical_any(spark, d):
    from ..operators.browse import any_term

    return T.records(spark, d).where(browsing(CALLER, "all") & any_term(_ASKED)).select("id")


@_add("lexical_and", P.query(P.RECORDS, select=f"SELECT id FROM records WHERE list_has_all(regexp_extract_all(lower(concat_ws(' ', content, context_summary)), '[a-z0-9]+'), {P.terms(repr('ing tion'))})"))
def lexical_and(spark, d):
    from ..operators.browse import all_tokens

    return T.records(spark, d).where(all_tokens("ing tion")).select("id")


@_add("browse_tags", P.query(P.RECORDS, select="SELECT id FROM records WHERE list_has_any(tags, ['pinned', 'thereof', 'entire'])"))
def browse_tags(spark, d):
    from ..operators.browse import any_tag

    return T.records(spark, d).where(any_tag([" Pinned ", "thereof", "entire", " "])).select("id")


_STAMPS = ", ".join(f"strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00') AS {c}" for c in ("created_at", "occurred_at", "valid_from"))
_TEXTS = ", ".join(f"{c}::VARCHAR AS {c}" for c in ("id", "user_id"))
_NONE = ", ".join(f"NULL AS {c}" for c in ("agent_summary", "session_id", "memory_tier", "discipline", "authority", "parent_id", "last_hit_by", "source_message_id", "last_used_at", "salience"))


@_add(
    "browse_cells",
    P.query(
        P.RECORDS,
        "lived AS (SELECT *, coalesce(occurred_at, created_at) AS valid_from, CASE WHEN id % 7 = 0 THEN created_at END AS ends FROM records)",
        select=f"SELECT {_TEXTS}, {_STAMPS}, {_NONE}, strftime(ends, '%Y-%m-%dT%H:%M:%S+00:00') AS valid_to, CASE WHEN id % 7 = 0 THEN (id + 1)::VARCHAR END AS superseded_by_id, content, context_summary, agent_type, project_id, customer_id, CASE WHEN user_id = 0 THEN 'own' ELSE 'team' END AS scope, trim(CASE WHEN length(regexp_replace(context_summary, '\\s+', '', 'g')) > 0 THEN context_summary WHEN length(regexp_replace(content, '\\s+', '', 'g')) > 0 THEN content ELSE '' END) AS summary, array_to_string(list_sort(list_filter(tags, lambda t: NOT starts_with(t, 'by:'))), ',') AS tags, {_BY} AS by, is_active, hit_count, embedding IS NOT NULL AS has_embedding, len(embedding)::INTEGER AS embedding_dim, true AS has_tsv FROM lived WHERE {_B_OWN}",
    ),
)
def browse_cells(spark, d):
    """All 31 keys; what the test tables have no column for is null."""
    from ..operators.browse import cells

    rows = T.records(spark, d)
    ended = F.col("id") % 7 == 0
    rows = rows.withColumns({"valid_from": F.coalesce("occurred_at", "created_at"), "valid_to": F.when(ended, F.col("created_at")), "superseded_by_id": F.when(ended, (F.col("id") + 1).cast("string")), "content_tokens": text.tokens(F.col("content"))})
    return cells(rows.where(browsing(CALLER, "all")), CALLER)


def _page(order: str, offset: int = 0):
    def run(spark, d):
        from ..operators.browse import page

        return page(T.records(spark, d).where(browsing(CALLER, "all")), order, offset, 25).select("id")

    return run


for _order, _by in (("recency", ""), ("hits", "hit_count DESC, "), ("occurred", "occurred_at DESC NULLS LAST, ")):
    _add(f"browse_{_order}", P.query(P.RECORDS, select=f"SELECT id FROM records WHERE {_B_OWN} ORDER BY {_by}created_at DESC, id LIMIT 25"))(_page(_order))
_add("browse_page", P.query(P.RECORDS, select=f"SELECT id FROM records WHERE {_B_OWN} ORDER BY created_at DESC, id LIMIT 25 OFFSET 10"))(_page("recency", 10))


@_add("browse_semantic", P.query(P.RECORDS, P.QUESTIONS, select=f"SELECT id, round(list_cosine_similarity(embedding, (SELECT vector FROM questions WHERE qid = 3)), 9) AS cosine FROM records WHERE {_B_OWN} AND embedding IS NOT NULL ORDER BY cosine DESC, id LIMIT 25"))
def browse_semantic(spark, d):
    from ..operators.browse import nearest

    asked = T.questions(spark, d).where("qid = 3").select("vector")
    rows = T.records(spark, d).where(browsing(CALLER, "all")).crossJoin(F.broadcast(asked))  # one row
    return nearest(rows, F.col("vector"), 25).select("id", "cosine")


@_add("get_memory", P.query(P.RECORDS, select="SELECT id, agent_type, is_active FROM records WHERE id = 13"))
def get_memory(spark, d):
    from ..operators.browse import by_id

    return by_id(T.records(spark, d), 13).select("id", "agent_type", "is_active")
