"""Retrieval and answer metrics over DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import written
from .sizes import small


def recall_at(gold: Column, found: Column, k: int) -> Column:
    """The share of gold ids among the first k found; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(gold, F.slice(found, 1, k))) / F.size(gold))


def reciprocal_rank(gold: Column, found: Column) -> Column:
    ranks = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def ndcg_at(gold: Column, found: Column, k: int) -> Column:
    """Binary gains, ideal over the smaller of k and the number of gold ids; 0 without gold."""
    gain = F.aggregate(F.transform(F.slice(found, 1, max(k, 0) or 1), lambda x, i: F.when(F.array_contains(gold, x), 1 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1))), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(gold) > 0) & F.lit(k > 0), gain / ideal).otherwise(F.lit(0.0))


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays, by one pass over both in order: equal tokens of ``b`` stand first, and each of ``a`` takes one."""
    marked = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("token"), F.lit(side).alias("side")))
    state = F.struct(F.lit("").alias("token"), F.lit(0).alias("left"), F.lit(0).alias("same"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["token"] == x["token"], s["left"]).otherwise(0)
        taken = (x["side"] == 1) & (left > 0)
        return F.struct(x["token"].alias("token"), F.when(x["side"] == 0, left + 1).when(taken, left - 1).otherwise(0).alias("left"), (s["same"] + taken.cast("int")).alias("same"))

    return F.aggregate(F.sort_array(F.concat(marked(b, 0), marked(a, 1))), state, step, lambda s: s["same"])


def _of_tokens(predicted: Column, gold: Column, score: Callable[[Column, Column], Column]) -> Column:
    """``score`` of the token arrays of both texts: 1 if neither has tokens, 0 if one has none. Texts are cut once, however often ``score`` names them."""
    both = F.array(F.struct(text.answer_tokens(predicted).alias("p"), text.answer_tokens(gold).alias("g")))

    def scored(x: Column) -> Column:
        p, g = x["p"], x["g"]
        return F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0)).when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0)).otherwise(score(p, g))

    return F.transform(both, scored)[0]


def token_f1(predicted: Column, gold: Column) -> Column:
    return _of_tokens(predicted, gold, lambda p, g: 2.0 * _overlap(p, g) / (F.size(p) + F.size(g)))


def bleu1(predicted: Column, gold: Column) -> Column:
    """Clipped unigram precision with brevity penalty."""
    penalty = lambda p, g: F.when(F.size(p) >= F.size(g), F.lit(1.0)).otherwise(F.exp(1 - F.size(g) / F.size(p)))
    return _of_tokens(predicted, gold, lambda p, g: penalty(p, g) * _overlap(p, g) / F.size(p))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (text.normalize_text(predicted) == text.normalize_text(gold)).cast("double")


def best_over(metric, predicted: Column, golds: Column) -> Column:
    """The best of a metric over several gold answers; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: metric(predicted, g))), F.lit(0.0))


def percentiles(rows: DataFrame, value: str, *shares: float) -> DataFrame:
    """Exact percentiles with linear interpolation; nulls are left out."""
    return rows.agg(*(F.percentile(value, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares))


def holders(docs: DataFrame, items: DataFrame, most_bytes: int) -> DataFrame:
    """(qid, doc_id): the documents (doc_id, text) that hold an item's whole text (qid, query).

    The words of an item but its first and last stand in such a document as they are. A document is compared with an item
    only if it has the item's rarest of them; items without such a word, of two words at most, are compared with all.
    """
    inner = F.array_distinct(F.slice(text.tokens(F.col("query")), 2, F.greatest(F.size(text.tokens(F.col("query"))) - 2, F.lit(0))))
    cut = items.where("query IS NOT NULL").select("qid", "query", inner.alias("inner"))
    words = cut.select("qid", F.explode("inner").alias("token"))
    postings = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).join(small(words.select("token").distinct(), most_bytes), "token")
    postings = written(postings, "postings")
    often = words.join(postings.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    rarest = often.groupBy("qid").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    near = written(postings.join(small(written(rarest, "rarest"), most_bytes), "token").select("qid", "doc_id"), "near")
    near = docs.select("doc_id", "text").join(small(near, most_bytes), "doc_id").join(small(cut.select("qid", "query"), most_bytes), "qid")
    short = small(cut.where(F.size("inner") == 0).select("qid", "query"), most_bytes)
    held = F.contains(F.col("text"), F.col("query"))
    return near.where(held).select("qid", "doc_id").unionByName(docs.join(short, held).select("qid", "doc_id"))


def run_statistics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, population deviation and number of runs."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(value).alias("n"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = 1.0, price_out: float = 5.0) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean recall after over mean recall before, of questions scored in both; questions that lost some and all."""
    both = before.select("qid", F.col("recall").alias("b")).join(after.select("qid", F.col("recall").alias("a")), "qid").where("b IS NOT NULL AND a IS NOT NULL")
    mean_b, mean_a = F.avg("b"), F.avg("a")
    return both.agg(F.when(mean_b > 0, mean_a / mean_b).otherwise(F.lit(1.0)).alias("retention"), F.count_if(F.col("a") < F.col("b")).alias("lost"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("dropped"))


def reduction(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) * 100.0 / before).otherwise(F.lit(0.0))


def summarised(results: DataFrame, *by: str) -> DataFrame:
    """What a run has reached, of all its questions or of each of ``by``.

    Figures are averages over the questions that have them: recall where there are gold ids, ranks where ``has_gold``,
    answers' scores and judgements where they are not null.
    """
    gold = F.col("has_gold")
    mean = lambda value, name: F.round(F.avg(value), 4).alias(name)
    tokens_in, tokens_out = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        mean("recall", "recall_at_k"),
        mean(F.when(gold, F.col("mrr")), "mrr"),
        mean(F.when(gold, F.col("ndcg")), "ndcg_at_k"),
        mean("f1", "token_f1"),
        mean("em", "exact_match"),
        mean("bleu", "bleu1"),
        mean(F.col("judged").cast("double"), "judge_accuracy"),
        mean("latency", "mean_latency"),
        F.round(F.percentile("latency", F.lit(0.5)), 4).alias("p50"),
        F.round(F.percentile("latency", F.lit(0.95)), 4).alias("p95"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        F.round(F.avg("context_tokens"), 1).alias("memory_tokens"),
        F.count("context_tokens").alias("memory_tokens_counted"),
        F.round(token_cost(tokens_in, tokens_out), 6).alias("est_cost_usd"),
    )


def share_of(items: DataFrame, key: str, share: float) -> DataFrame:
    """A repeatable share of the rows, rounded up: those with the smallest digests of their keys.

    Rows are counted by the first four digits of their digests (65,536 numbers at most reach the driver). What lies below the
    digits at which the share is reached is taken by a filter, and only rows with those digits are put in order.
    """
    if not 0 < share <= 1:
        raise ValueError(f"a share must be above 0 and at most 1, not {share}")
    dealt = items.withColumn("_at", F.sha2(F.encode(F.col(key).cast("string"), "UTF-8"), 256))
    head = F.substring("_at", 1, 4)
    counts = dealt.groupBy(head.alias("head")).agg(F.count("*").alias("n")).orderBy("head").collect()
    left = math.ceil(share * sum(r.n for r in counts))
    for r in counts:
        if left <= r.n:
            edge = dealt.where(head == r.head).orderBy("_at", key).limit(left)
            return dealt.where(head < r.head).unionByName(edge).drop("_at")
        left -= r.n
    return items


def turns_recalled(recalled: DataFrame, turns: DataFrame, rendered: str = "rendered") -> DataFrame:
    """Recalled summaries (qid, rank, summary) as turn ids in rank order, each once.

    An equal rendered turn, else the first turn (by position) of which either contains the other.
    """
    equal = recalled.join(turns.select(F.col(rendered).alias("summary"), "turn_id", "turn_pos"), "summary")
    found = equal.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "rank").orderBy("turn_pos", "turn_id"))).where("_n = 1").select("qid", "rank", "turn_id")
    rest = recalled.join(found.select("qid", "rank"), ["qid", "rank"], "left_anti")
    near = rest.join(turns.select("turn_id", "turn_pos", "conv_id", F.col("text").alias("said")), "conv_id") if "conv_id" in rest.columns else rest.crossJoin(turns.select("turn_id", "turn_pos", F.col("text").alias("said")))
    near = near.where(F.contains(F.col("summary"), F.col("said")) | F.contains(F.col("said"), F.col("summary")))
    loose = near.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "rank").orderBy("turn_pos", "turn_id"))).where("_n = 1").select("qid", "rank", "turn_id")
    firsts = found.unionByName(loose).groupBy("qid", "turn_id").agg(F.min("rank").alias("at"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at", "turn_id"))).select("qid", "rank", "turn_id")


#: Pairs of a question and a memory, and bytes of text, that one task of ``stub_recall`` is dealt, or about so.
_TASK_PAIRS, _TASK_BYTES = 1 << 20, 4 << 20


def stub_recall(questions: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """The k memories with the largest multiset Jaccard similarity of tokens, above 0.

    Memories are dealt by their ids to as many tasks as their pairs and texts ask for, so a task's memory does not grow with the table. Counts and
    scores of a memory are then made where it is, and only a task's best k of each question go on.
    """
    bag = lambda df, key: df.select(key, F.explode(text.tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    held = memories.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    tasks = max(int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.n * questions.count() // _TASK_PAIRS, held.bytes // _TASK_BYTES)
    dealt = memories.repartition(tasks, "id")
    q, m = written(bag(questions, "qid"), "bags"), bag(dealt, "id")
    sizes_q = q.groupBy("qid").agg(F.sum("n").alias("nq"))
    sizes_m = dealt.groupBy("id").agg(F.sum(F.size(text.tokens(F.col("text")))).alias("nm"))
    asked = written(q.withColumnRenamed("n", "a").join(sizes_q, "qid"), "asked")
    shared = m.withColumnRenamed("n", "b").join(small(asked, 32 << 20), "token").groupBy("id", "qid", "nq").agg(F.sum(F.least("a", "b")).alias("common"))
    scored = shared.join(sizes_m.hint("shuffle_hash"), "id").withColumn("score", F.col("common") / (F.col("nq") + F.col("nm") - F.col("common")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "score")
