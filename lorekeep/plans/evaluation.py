"""Queries of text functions, metrics and the evaluation loop, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation as E
from ..operators import recall as R
from ..sources import tables as T
from . import prelude as P
from .recall import CALLER, CONFIG, LIMIT, K

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


_PUNCT = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def normal(column: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce({column}, '')), '{_PUNCT}', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def tokens(column: str) -> str:
    return f"list_filter(string_split({normal(column)}, ' '), lambda w: w <> '')"


# texts



@_add("first_nonblank", r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN lang ELSE '' END AS value FROM documents")
def first_nonblank(spark, d):
    docs = T.table(spark, d, "documents")
    one = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" \t\n")
    two = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return docs.select("doc_id", text.first_nonblank(one, two).alias("value"))


@_add("normalize_label", f"SELECT doc_id, {P.label(chr(39).join(['', ' _', ' || text || ', '- ', '']))} AS label FROM documents")
def normalize_label(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.normalize_label(F.concat(F.lit(" _"), F.col("text"), F.lit("- "))).alias("label"))


@_add("normalize_text", f"SELECT doc_id, {normal('text')} AS normal FROM documents")
def normalize_text(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


_RENDER = "'[' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S+00:00') || '] ' || speaker || ': ' || text"


@_add("render_turn", P.query(P.TURNS, select=f"SELECT turn_id, {_RENDER} AS rendered FROM turns"))
def render_turn(spark, d):
    return T.turns(spark, d).select("turn_id", text.render_turn(F.col("occurred_at"), F.col("speaker"), F.col("text")).alias("rendered"))


@_add("build_context", "SELECT conv_id, string_agg((n || '. ' || text), chr(10) ORDER BY turn) AS context FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def build_context(spark, d):
    said = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    return said.select("conv_id", text.numbered_context(F.transform("said", lambda x: x["text"])).alias("context"))


@_add("context_block", P.query(P.RECORDS, select="SELECT id, '- ' || CASE WHEN id % 4 = 0 AND occurred_at IS NULL THEN '' WHEN id % 4 = 0 THEN '[' || strftime(occurred_at, '%Y-%m-%d') || '] ' WHEN occurred_at IS NULL THEN '[own] ' ELSE '[' || strftime(occurred_at, '%Y-%m-%d') || ' · own] ' END || context_summary AS line FROM records"))
def context_block(spark, d):
    scope = F.when(F.col("id") % 4 != 0, "own")
    return T.records(spark, d).select("id", text.context_line(F.col("context_summary"), F.date_format("occurred_at", "yyyy-MM-dd"), scope).alias("line"))


@_add(
    "chunk_document",
    r"WITH q AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS paras FROM documents), p AS (SELECT doc_id, n, para, string_split_regex(para, '\s+') AS words FROM (SELECT doc_id, unnest(paras) AS para, generate_subscripts(paras, 1) AS n FROM q)), w AS (SELECT doc_id, n, i, CASE WHEN len(words) <= 200 THEN para ELSE array_to_string(list_slice(words, i * 200 + 1, i * 200 + 200), ' ') END AS chunk FROM (SELECT doc_id, n, para, words, unnest(range(0, greatest(1, ceil(len(words) / 200.0))::BIGINT)) AS i FROM p)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) - 1 AS pos, length(chunk) AS size, md5(chunk) AS digest FROM w QUALIFY pos < 200",
)
def chunk_document(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.posexplode(text.word_windows(F.col("text"))).alias("pos", "chunk"))
    return docs.select("doc_id", "pos", F.length("chunk").alias("size"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


@_add("wrap_prompt", "SELECT page_id, '<memory>' || replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') || '</memory>' AS prompt FROM pages")
def wrap_prompt(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.concat(F.lit("<memory>"), text.escape_markup(F.col("html")), F.lit("</memory>")).alias("prompt"))


@_add("answer_prompt", P.query(P.QUESTIONS, select="SELECT qid, 'Use the memories.' || chr(10) || CASE WHEN as_of IS NOT NULL THEN 'Current Date: ' || strftime(as_of, '%Y-%m-%d') || chr(10) ELSE '' END || 'Question: ' || query AS prompt FROM questions"))
def answer_prompt(spark, d):
    asked = T.questions(spark, d)
    plain = F.concat(F.lit("Use the memories.\nQuestion: "), F.col("query"))
    return asked.select("qid", text.splice_date(plain, F.date_format("as_of", "yyyy-MM-dd"), "Question:").alias("prompt"))


@_add("jaccard_pairs", r"WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9.]+')) AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 9) AS jaccard FROM t AS a JOIN t AS b ON b.item_id = a.item_id + 1")
def jaccard_pairs(spark, d):
    items = T.table(spark, d, "benchmark").select("item_id", text.decimal_tokens(F.col("text")).alias("s"))
    two = items.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("item_id"), F.col("s").alias("t"))
    return items.join(two, "item_id").select(F.col("item_id").alias("a"), "b", F.round(text.jaccard(F.col("s"), F.col("t")), 9).alias("jaccard"))


# retrieval metrics: the gold of an item are the documents that hold its whole text

_GOLD = "gold AS (SELECT b.item_id AS qid, list(d.doc_id ORDER BY d.doc_id) AS gold FROM benchmark AS b JOIN documents AS d ON contains(d.text, b.text) GROUP BY 1)"
_FOUND = "found AS (SELECT qid, list(id ORDER BY position) AS found FROM own GROUP BY qid)"
_EVERY = P.legs("own", "is_active", LIMIT)
_SCORED = (P.RECORDS, P.QUESTIONS, _EVERY, P.chosen("own", "own_ranked", K), _GOLD, _FOUND, "judged AS (SELECT f.qid, f.found, coalesce(g.gold, []) AS gold FROM found AS f LEFT JOIN gold AS g ON g.qid = f.qid)")


def _judged(spark, d, config=CONFIG):
    """(qid, found, gold) of a recall over all active records."""
    rows = T.records(spark, d).where("is_active")
    plan = R.chosen(R.candidates(R.kept(rows), T.questions(spark, d), T.now(), config), F.lit(config.k), config)
    found = plan.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("found"))
    items = T.questions(spark, d).select("qid", "query")
    gold = E.holders(T.table(spark, d, "documents"), items, config.max_broadcast_bytes).groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))
    return found.join(gold, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))


_RECALL = "CASE WHEN len(gold) > 0 THEN len(list_intersect(gold, list_slice(found, 1, 10)))::DOUBLE / len(gold) END"
_MRR = "coalesce(1.0 / list_min(list_filter(list_transform(gold, lambda g: list_position(found, g)), lambda p: p IS NOT NULL AND p > 0)), 0.0)::DOUBLE"
_NDCG = "CASE WHEN len(gold) > 0 THEN coalesce(list_sum(list_transform(list_filter(list_transform(gold, lambda g: list_position(found, g)), lambda p: p IS NOT NULL AND p BETWEEN 1 AND 10), lambda p: 1 / log2(p + 1))), 0) / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END"


@_add("metric_recall", P.query(*_SCORED, select=f"SELECT qid, round({_RECALL}, 9) AS recall FROM judged"))
def metric_recall(spark, d, config=CONFIG):
    return _judged(spark, d, config).select("qid", F.round(E.recall_at(F.col("gold"), F.col("found"), 10), 9).alias("recall"))


@_add("metric_mrr", P.query(*_SCORED, select=f"SELECT qid, round({_MRR}, 9) AS mrr FROM judged"))
def metric_mrr(spark, d, config=CONFIG):
    return _judged(spark, d, config).select("qid", F.round(E.reciprocal_rank(F.col("gold"), F.col("found")), 9).alias("mrr"))


@_add("metric_ndcg", P.query(*_SCORED, select=f"SELECT qid, round({_NDCG}, 9) AS ndcg FROM judged"))
def metric_ndcg(spark, d, config=CONFIG):
    return _judged(spark, d, config).select("qid", F.round(E.ndcg_at(F.col("gold"), F.col("found"), 10), 9).alias("ndcg"))


@_add("eval_retrieval", P.query(*_SCORED, select=f"SELECT count(*) AS n, count({_RECALL}) AS with_gold, round(avg({_RECALL}), 4) AS recall, round(avg({_MRR}) FILTER (WHERE len(gold) > 0), 4) AS mrr, round(avg({_NDCG}) FILTER (WHERE len(gold) > 0), 4) AS ndcg FROM judged"))
def eval_retrieval(spark, d, config=CONFIG):
    gold, found = F.col("gold"), F.col("found")
    scored = _judged(spark, d, config).select(E.recall_at(gold, found, 10).alias("r"), F.when(F.size(gold) > 0, E.reciprocal_rank(gold, found)).alias("m"), F.when(F.size(gold) > 0, E.ndcg_at(gold, found, 10)).alias("g"))
    return scored.agg(F.count("*").alias("n"), F.count("r").alias("with_gold"), F.round(F.avg("r"), 4).alias("recall"), F.round(F.avg("m"), 4).alias("mrr"), F.round(F.avg("g"), 4).alias("ndcg"))


# answer metrics: a document's second line against its first

_LINES = "pairs AS (SELECT doc_id, string_split(text, chr(10))[2] AS p, string_split(text, chr(10))[1] AS g FROM documents WHERE contains(text, chr(10)))"
_BAGS = (
    _LINES,
    f"toks AS (SELECT doc_id, {tokens('p')} AS tp, {tokens('g')} AS tg FROM pairs)",
    "cp AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(tp) AS t FROM toks) GROUP BY ALL)",
    "cg AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(tg) AS t FROM toks) GROUP BY ALL)",
    "same AS (SELECT cp.doc_id, sum(least(cp.n, cg.n)) AS same FROM cp JOIN cg ON cg.doc_id = cp.doc_id AND cg.t = cp.t GROUP BY 1)",
    "sized AS (SELECT t.doc_id, len(tp) AS np, len(tg) AS ng, coalesce(s.same, 0)::DOUBLE AS same FROM toks AS t LEFT JOIN same AS s ON s.doc_id = t.doc_id)",
)
_F1 = "CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE 2 * same / (np + ng) END"
_BLEU = "CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE CASE WHEN np >= ng THEN 1.0 ELSE exp(1 - ng / np::DOUBLE) END * same / np END"


def _pairs(spark, d):
    lines = F.split("text", "\n", 3)  # what follows the second line stays whole
    return T.table(spark, d, "documents").where(F.contains(F.col("text"), F.lit("\n"))).select("doc_id", lines[1].alias("p"), lines[0].alias("g"))


@_add("metric_f1", P.query(*_BAGS, select=f"SELECT doc_id, round({_F1}, 9) AS f1 FROM sized"))
def metric_f1(spark, d):
    return _pairs(spark, d).select("doc_id", F.round(E.token_f1(F.col("p"), F.col("g")), 9).alias("f1"))


@_add("metric_bleu1", P.query(*_BAGS, select=f"SELECT doc_id, round({_BLEU}, 9) AS bleu FROM sized"))
def metric_bleu1(spark, d):
    return _pairs(spark, d).select("doc_id", F.round(E.bleu1(F.col("p"), F.col("g")), 9).alias("bleu"))


@_add("metric_em", P.query(_LINES, select=f"SELECT doc_id, CASE WHEN {normal('p')} = {normal('g')} THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM pairs"))
def metric_em(spark, d):
    return _pairs(spark, d).select("doc_id", E.exact_match(F.col("p"), F.col("g")).alias("em"))


@_add("metric_best_gold", P.query(_LINES, select=f"SELECT doc_id, greatest(CASE WHEN {normal('p')} = {normal('g')} THEN 1.0 ELSE 0.0 END, CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS best FROM pairs"))
def metric_best_gold(spark, d):
    golds = F.when(F.col("doc_id") % 5 == 0, F.array("g", F.concat("p", F.lit(" the!")))).otherwise(F.array("g"))
    rows = _pairs(spark, d).withColumn("golds", golds).where("p IS NOT NULL")
    return rows.select("doc_id", E.best_over(E.exact_match, F.col("p"), F.col("golds")).alias("best"))


@_add("judge_accuracy", "SELECT coalesce(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 0)::DOUBLE AS accuracy, count(*) AS n FROM labels")
def judge_accuracy(spark, d):
    from ..functions.parsing import judge_label

    reply = F.concat(F.lit('Here: {"label": "'), F.when(F.col("quality") == 1, "CORRECT").otherwise("WRONG"), F.lit('"}'))
    return T.table(spark, d, "labels").select(judge_label(reply).cast("int").alias("ok")).agg(F.coalesce(F.avg("ok"), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


# a run: of each question the answer is the first record's summary, its gold the question itself; every fifth is not judged

_ANSWERS = (
    *_SCORED,
    "pairs AS (SELECT j.qid AS doc_id, r.context_summary AS p, q.query AS g, j.gold, j.found, CASE WHEN q.as_of IS NULL THEN 'open' ELSE 'dated' END AS category, e.value AS latency FROM judged AS j JOIN questions AS q ON q.qid = j.qid LEFT JOIN records AS r ON r.id = j.found[1] LEFT JOIN events AS e ON e.event_id = j.qid)",
    *_BAGS[1:],
    f"results AS (SELECT category, len(gold) > 0 AS has_gold, {_RECALL} AS recall, {_MRR} AS mrr, {_NDCG} AS ndcg, {_F1} AS f1, CASE WHEN {normal('p')} = {normal('g')} THEN 1.0 ELSE 0.0 END AS em, {_BLEU} AS bleu, CASE WHEN a.doc_id % 5 <> 0 THEN {_F1} >= 0.1 END AS judged, latency, len(regexp_extract_all(lower(g), '[a-z0-9]+')) AS input_tokens, len(regexp_extract_all(lower(p), '[a-z0-9]+')) AS output_tokens, CASE WHEN a.doc_id % 4 <> 0 THEN len(regexp_extract_all(lower(p), '[a-z0-9]+')) END AS context_tokens FROM pairs AS a JOIN sized AS s ON s.doc_id = a.doc_id)",
)
_SUMMED = "count(*) AS n, round(avg(recall), 4) AS recall_at_k, round(avg(mrr) FILTER (WHERE has_gold), 4) AS mrr, round(avg(ndcg) FILTER (WHERE has_gold), 4) AS ndcg_at_k, round(avg(f1), 4) AS token_f1, round(avg(em), 4) AS exact_match, round(avg(bleu), 4) AS bleu1, round(avg(judged::INTEGER), 4) AS judge_accuracy, round(avg(latency), 4) AS mean_latency, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(avg(context_tokens), 1) AS memory_tokens, count(context_tokens) AS memory_tokens_counted, round((sum(input_tokens) * 1.0 + sum(output_tokens) * 5.0) / 1e6, 6)::DOUBLE AS est_cost_usd"


def _results(spark, d, config=CONFIG):
    from ..functions.parsing import judge_label

    first = T.records(spark, d).select(F.col("id").alias("first"), F.col("context_summary").alias("p"))
    asked = T.questions(spark, d).select("qid", F.col("query").alias("g"), F.when(F.col("as_of").isNull(), "open").otherwise("dated").alias("category"))
    took = T.table(spark, d, "events").select(F.col("event_id").alias("qid"), F.col("value").alias("latency"))
    rows = _judged(spark, d, config).withColumn("first", F.get("found", F.lit(0))).join(first, "first", "left").join(asked, "qid").join(took, "qid", "left")
    p, g, gold, found = F.col("p"), F.col("g"), F.col("gold"), F.col("found")
    reply = F.concat(F.lit('{"label": "'), F.when(E.token_f1(p, g) >= 0.1, "CORRECT").otherwise("WRONG"), F.lit('"}'))
    return rows.select(
        "category",
        (F.size(gold) > 0).alias("has_gold"),
        E.recall_at(gold, found, 10).alias("recall"),
        E.reciprocal_rank(gold, found).alias("mrr"),
        E.ndcg_at(gold, found, 10).alias("ndcg"),
        E.token_f1(p, g).alias("f1"),
        E.exact_match(p, g).alias("em"),
        E.bleu1(p, g).alias("bleu"),
        F.when(F.col("qid") % 5 != 0, judge_label(reply)).cast("int").alias("judged"),
        "latency",
        F.size(text.tokens(g)).alias("input_tokens"),
        F.size(text.tokens(p)).alias("output_tokens"),
        F.when(F.col("qid") % 4 != 0, F.size(text.tokens(p))).alias("context_tokens"),
    )


@_add("eval_summary", P.query(*_ANSWERS, select=f"SELECT {_SUMMED} FROM results"))
def eval_summary(spark, d):
    return E.summarised(_results(spark, d))


@_add("eval_by_category", P.query(*_ANSWERS, select=f"SELECT category, {_SUMMED} FROM results GROUP BY category"))
def eval_by_category(spark, d):
    return E.summarised(_results(spark, d), "category")


@_add("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_percentiles(spark, d):
    return E.percentiles(T.table(spark, d, "events"), "value", 0.5, 0.95).select(F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@_add("run_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(value) AS n FROM events GROUP BY 1")
def run_stats(spark, d):
    return E.run_statistics(T.table(spark, d, "events"), "value", "event_type").select("event_type", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "n")


@_add("storage_bytes", "SELECT sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents")
def storage_bytes(spark, d):
    return T.table(spark, d, "documents").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@_add("token_cost", "SELECT conv_id, round((sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) * 1.0 + sum(CASE WHEN role <> 'user' THEN length(text) ELSE 0 END) * 5.0) / 1e6, 9) AS usd FROM conversations GROUP BY 1")
def token_cost(spark, d):
    size = F.length("text")
    sums = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "user", size).otherwise(0)).alias("i"), F.sum(F.when(F.col("role") != "user", size).otherwise(0)).alias("o"))
    return sums.select("conv_id", F.round(E.token_cost(F.col("i"), F.col("o")), 9).alias("usd"))


@_add("retention", "WITH b AS (SELECT doc_id AS qid, (doc_id % 4) / 4.0 AS r FROM documents), a AS (SELECT doc_id AS qid, (doc_id % 3) / 3.0 AS r FROM documents WHERE doc_id % 5 <> 0) SELECT round(avg(a.r) / avg(b.r), 9) AS retention, count(*) FILTER (WHERE a.r < b.r) AS lost, count(*) FILTER (WHERE b.r > 0 AND a.r = 0) AS dropped FROM b JOIN a ON a.qid = b.qid")
def retention(spark, d):
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    before = docs.withColumn("recall", (F.col("qid") % 4) / 4.0)
    after = docs.where("qid % 5 <> 0").withColumn("recall", (F.col("qid") % 3) / 3.0)
    return E.retention(before, after).withColumn("retention", F.round("retention", 9))


@_add("reduction_pct", "SELECT source, round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 6) AS reduction FROM documents GROUP BY 1")
def reduction_pct(spark, d):
    counts = T.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("b"), F.count_distinct("text").alias("a"))
    return counts.select("source", F.round(E.reduction(F.col("b"), F.col("a")), 6).alias("reduction"))


@_add("needle_recall", P.query(P.RECORDS, select="SELECT agent_type, count(*) FILTER (WHERE contains(lower(context_summary), 'tion')) AS hits, round(avg(CASE WHEN contains(lower(context_summary), 'tion') THEN 1.0 ELSE 0.0 END), 6) AS recall FROM records GROUP BY 1"))
def needle_recall(spark, d):
    found = F.contains(F.lower("context_summary"), F.lower(F.lit("TION")))
    return T.records(spark, d).groupBy("agent_type").agg(F.count_if(found).alias("hits"), F.round(F.avg(found.cast("double")), 6).alias("recall"))


@_add(
    "jaccard_recall",
    P.query(
        "q AS (SELECT item_id AS qid, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) GROUP BY ALL)",
        "m AS (SELECT id, t, count(*) AS n FROM (SELECT conv_id * 100 + turn AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations) GROUP BY ALL)",
        "sq AS (SELECT qid, sum(n) AS n FROM q GROUP BY 1)", "sm AS (SELECT id, sum(n) AS n FROM m GROUP BY 1)",
        "c AS (SELECT q.qid, m.id, sum(least(q.n, m.n)) AS common FROM q JOIN m ON m.t = q.t GROUP BY ALL)",
        "s AS (SELECT c.qid, c.id, common::DOUBLE / (sq.n + sm.n - common) AS score FROM c JOIN sq ON sq.qid = c.qid JOIN sm ON sm.id = c.id)",
        select="SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, round(score, 9) AS score FROM s QUALIFY rank <= 10",
    ),
)
def jaccard_recall(spark, d):
    asked = T.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    held = T.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    return E.stub_recall(asked, held, 10).withColumn("score", F.round("score", 9))


@_add(
    "map_recall_to_turns",
    P.query(
        P.TURNS,
        f"shown AS (SELECT *, {_RENDER} AS rendered FROM turns)",
        "recalled AS (SELECT conv_id AS qid, conv_id, turn_pos AS rank, CASE WHEN turn_pos % 2 = 0 THEN rendered ELSE substring(text, 1, 40) END AS summary FROM shown)",
        "equal_ AS (SELECT r.qid, r.rank, s.turn_id FROM recalled AS r JOIN shown AS s ON s.rendered = r.summary QUALIFY row_number() OVER (PARTITION BY r.qid, r.rank ORDER BY s.turn_pos, s.turn_id) = 1)",
        "loose AS (SELECT r.qid, r.rank, s.turn_id FROM recalled AS r JOIN shown AS s ON s.conv_id = r.conv_id AND (contains(r.summary, s.text) OR contains(s.text, r.summary)) WHERE NOT EXISTS (SELECT 1 FROM equal_ AS e WHERE e.qid = r.qid AND e.rank = r.rank) QUALIFY row_number() OVER (PARTITION BY r.qid, r.rank ORDER BY s.turn_pos, s.turn_id) = 1)",
        "firsts AS (SELECT qid, turn_id, min(rank) AS first_rank FROM (SELECT * FROM equal_ UNION ALL SELECT * FROM loose) GROUP BY 1, 2)",
        select="SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY first_rank, turn_id) AS rank, turn_id FROM firsts",
    ),
)
def map_recall_to_turns(spark, d):
    shown = T.turns(spark, d).withColumn("rendered", text.render_turn(F.col("occurred_at"), F.col("speaker"), F.col("text")))
    summary = F.when(F.col("turn_pos") % 2 == 0, F.col("rendered")).otherwise(F.substring("text", 1, 40))
    recalled = shown.select(F.col("conv_id").alias("qid"), "conv_id", F.col("turn_pos").alias("rank"), summary.alias("summary"))
    return E.turns_recalled(recalled, shown)


@_add("exclude_abstention", "WITH qa AS (SELECT conv_id, turn, conv_id % 4 = 0 OR turn % 2 = 1 AS abstention FROM conversations WHERE role = 'user'), kept AS (SELECT * FROM qa WHERE NOT abstention) SELECT (SELECT count(*) FROM kept) AS questions, (SELECT count(*) FROM qa WHERE abstention) AS excluded, (SELECT count(DISTINCT conv_id) FROM kept) AS conversations FROM (SELECT 1)")
def exclude_abstention(spark, d):
    qa = T.table(spark, d, "conversations").where("role = 'user'").select("conv_id", F.expr("conv_id % 4 = 0 OR turn % 2 = 1").alias("abstention"))
    return qa.agg(F.count_if(~F.col("abstention")).alias("questions"), F.count_if("abstention").alias("excluded"), F.count_distinct(F.when(~F.col("abstention"), F.col("conv_id"))).alias("conversations"))


@_add("qa_fraction", "SELECT item_id FROM benchmark QUALIFY row_number() OVER (ORDER BY sha256(item_id::VARCHAR), item_id) <= ceil(count(*) OVER () * 0.25)")
def qa_fraction(spark, d):
    """A repeatable quarter of the questions."""
    return E.share_of(T.table(spark, d, "benchmark"), "item_id", 0.25).select("item_id")
