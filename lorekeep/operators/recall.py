"""Batched hybrid recall: many questions against many records in one plan.

Each leg ranks at most ``candidate_limit`` records for each question; the ranks
are fused by weighted reciprocal ranks and ordered, and the last places are kept for the
freshest evidence. Every window ends in the record id, so results do not
depend on how rows are partitioned. Scores are added in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, stem, text, vectors
from ..sources.shared import written
from .scope import Caller, as_of, own, team
from .sizes import bytes_held, paired, small, tasks_for

#: What a record needs for ranking; contents are joined to the chosen rows only.
_KEYS = ("id", "created_at", "occurred_at", "hit_count")


def prepared(records: DataFrame, *more: Column) -> DataFrame:
    """Scoped records with what the legs look at; ``_tokens`` are the different words of content and summary."""
    hay = F.lower(text.haystack(F.col("content"), F.col("context_summary")))
    return records.select(*_KEYS, hay.alias("_hay"), F.array_distinct(text.tokens(hay)).alias("_tokens"), "tags", "embedding", vectors.norm(F.col("embedding")).alias("_norm"), *more)


def kept(records: DataFrame, *more: Column) -> DataFrame:
    """Prepared records, with ``more`` of them, as a written table, so that texts are cut into words once and not for each leg, by all tasks alike."""
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(prepared(records.repartition(tasks, "id"), *more).drop("_hay"), "records")


def _top(pairs: DataFrame, limit: int, *order: Column) -> DataFrame:
    # the bound on the bare row number lets each task drop what it need not send
    ranked = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(*order, F.col("id"))))
    return ranked.where(F.col("_n") <= limit).withColumn("rank", F.col("_n") - 1).drop("_n")


def recent_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """The newest records, ranked once for each distinct bound and handed to its questions."""
    pairs = paired(records.select("id", "created_at", "occurred_at"), questions.select("as_of").distinct(), as_of(), config.max_broadcast_bytes)
    order = Window.partitionBy("as_of").orderBy(F.desc("created_at"), "id")
    newest = pairs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= config.candidate_limit).select(F.col("as_of").alias("bound"), "id", (F.col("_n") - 1).alias("rank"))
    return questions.select("qid", "as_of").join(newest, F.col("as_of").eqNullSafe(F.col("bound"))).select("qid", "id", "rank")


def matching_words(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, term): the words of the records that hold a term. They meet by the term's first three letters, so no word is held against every term."""
    vocabulary = records.select(F.explode("_tokens").alias("token")).distinct().where(F.length("token") >= 3)
    parts = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substring(F.col("token"), i, F.lit(3)))
    heads = vocabulary.select("token", F.explode(F.array_distinct(parts)).alias("head"))
    return heads.join(terms.select("term", F.substring("term", 1, 3).alias("head")), "head").where(F.contains("token", "term")).select("token", "term")


def term_hits(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """(qid, id, created_at, overlap): how many of a question's terms are substrings of a record, repeated terms again.

    A term has letters and digits only, so it lies inside one word of a text: terms are looked for in the vocabulary, and records
    found by their words.
    """
    asked = questions.select("qid", "as_of", F.explode(text.query_terms(F.col("query"))).alias("term"))
    counted = asked.groupBy("qid", "as_of", "term").agg(F.count("*").alias("times"))
    tasks = tasks_for(records, questions)
    words = matching_words(records, counted.select("term").distinct()).repartition(tasks, "token")
    words = written(words.groupBy("token").agg(F.collect_set("term").alias("terms")), "words")
    held = records.select("id", "created_at", "occurred_at", "_tokens")

    def met(rows: DataFrame, few: DataFrame) -> DataFrame:
        postings = rows.select("id", "created_at", "occurred_at", F.explode("_tokens").alias("token")).join(few, "token")
        return postings.select("id", "created_at", "occurred_at", F.explode("terms").alias("term"))

    # records are dealt by their ids to as many tasks as the pairs ask for: their different terms, and the counts of their questions, are then made there
    if bytes_held(words) <= config.max_broadcast_bytes:
        found = met(held.repartition(tasks, "id"), F.broadcast(words)).distinct()
    else:  # words are hashed, not sorted: postings, of which a common word has one for each record, stream past them
        found = met(held, words.hint("shuffle_hash")).repartition(tasks, "id").distinct()
    each = found.join(small(counted, config.max_broadcast_bytes), "term")
    return each.where(as_of()).groupBy("qid", "id", "created_at", "occurred_at").agg(F.sum("times").alias("overlap")).drop("occurred_at")


def lexical_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Records that have any (or, conjunctive, all) of a question's terms as substrings; by overlap, then newest."""
    hits = term_hits(records, questions, config)
    if not config.lexical_any:
        need = questions.select("qid", F.size(text.query_terms(F.col("query"))).alias("need"))
        hits = hits.join(need, "qid").where("overlap = need")
    return _top(hits, config.candidate_limit, F.desc("overlap"), F.desc("created_at")).select("qid", "id", "rank", "overlap")


def token_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Records by how many of their token positions hold a term of the question."""
    asked = questions.select("qid", "as_of", F.explode(F.array_distinct(text.query_terms(F.col("query")))).alias("term"))
    held = records.select("id", "occurred_at", F.explode(text.tokens(F.col("_hay"))).alias("term")).groupBy("id", "occurred_at", "term").agg(F.count("*").alias("tf"))
    scored = held.join(asked, "term").where(as_of()).groupBy("qid", "id").agg(F.sum("tf").alias("score"))
    return _top(scored.join(records.select("id", "created_at"), "id"), config.candidate_limit, F.desc("score"), F.desc("created_at")).select("qid", "id", "rank", "score")


def tag_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Records with a tag that the question names; most matching labels first, then newest; one row a record."""
    asked = questions.select("qid", "as_of", F.explode(text.query_labels(F.col("query"))).alias("label"))
    links = records.select("id", "created_at", "occurred_at", F.explode(F.array_distinct("tags")).alias("label"))
    met = links.join(asked, "label").where(as_of()).groupBy("qid", "id", "created_at").agg(F.count("*").alias("labels"))
    return _top(met, config.candidate_limit, F.desc("labels"), F.desc("created_at")).select("qid", "id", "rank", "labels")


def vector_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Records with a vector, by exact cosine (rounded to nine digits before it ranks); vectors of another length don't count, a question's that is zero or not finite is an error."""
    length = vectors.norm(F.col("vector"))
    known = F.when((length > 0) & (length < F.lit(float("inf"))), length).otherwise(F.raise_error(F.lit("a question's vector is zero or not finite")).cast("double"))
    asked = questions.where("vector IS NOT NULL").select("qid", "as_of", "vector", known.alias("_asked"))
    held = records.where("embedding IS NOT NULL").select("id", "occurred_at", "embedding", "_norm")
    close = F.round(vectors.cosine(F.col("embedding"), F.col("vector"), F.col("_norm"), F.col("_asked")), 9)
    pairs = paired(held, asked, as_of() & (F.size("embedding") == F.size("vector")), config.max_broadcast_bytes)
    return _top(pairs.select("qid", "id", close.alias("cosine")), config.candidate_limit, F.desc("cosine")).select("qid", "id", "rank", "cosine")


def fuse(legs: dict[str, tuple[DataFrame, float]], config: Config) -> DataFrame:
    """(qid, id, rrf) of ranked legs; a leg of weight 0 is not built into the plan."""
    parts = [leg.select("qid", "id", F.lit(name).alias("leg"), "rank") for name, (leg, weight) in legs.items() if weight]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    ranks = every.groupBy("qid", "id").agg(*(F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(name) for name, (_, weight) in legs.items() if weight))
    total = F.lit(0.0)
    for name, (_, weight) in legs.items():
        if weight:
            total = total + F.coalesce(F.lit(weight) / (F.col(name) + config.rrf_k), F.lit(0.0))
    return ranks.select("qid", "id", total.alias("rrf"))


def salience(rrf: Column, hits: Column, decay: Column, config: Config) -> Column:
    return F.when(rrf > 0, F.lit(config.match_band)).otherwise(0.0) + 100 * rrf + 10 * F.log1p(hits) + decay


def candidates(records: DataFrame, questions: DataFrame, now: Column, config: Config) -> DataFrame:
    """All candidates of each question: qid, id, rrf, rank (1: first), salience, and what their order hangs on."""
    fused = fuse(
        {
            "lexical": (lexical_leg(records, questions, config), config.weight_lexical),
            "tag": (tag_leg(records, questions, config), config.weight_tag),
            "vector": (vector_leg(records, questions, config), config.weight_vector),
        },
        config,
    )
    recent = recent_leg(records, questions, config).select("qid", "id", F.lit(0.0).alias("rrf"))
    pool = fused.unionByName(recent).groupBy("qid", "id").agg(F.max("rrf").alias("rrf"))
    rows = pool.join(records.select(*_KEYS), "id").withColumn("decay", dates.recency(F.col("created_at"), now, config.half_life_days))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), F.desc("hit_count"), F.desc("decay"), F.desc("created_at"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("salience", salience(F.col("rrf"), F.col("hit_count"), F.col("decay"), config))


def chosen(ranked: DataFrame, k: Column, config: Config) -> DataFrame:
    """The best ``k`` of each question, the last ``reserve`` of them for the freshest of the rest; with their position.

    ``k`` may be a column. Of the rest matched ones come first, by event time (or, without ``event_reserve``, by
    time of writing), then others by time of writing.
    """
    k = F.greatest(k, F.lit(0))
    reserve = F.least(F.lit(config.reserve), k)
    top = F.col("rank") <= k - reserve
    matched = F.col("rrf") > 0
    fresh = F.coalesce("occurred_at", "created_at") if config.event_reserve else F.col("created_at")
    order = Window.partitionBy("qid", "_top").orderBy(F.desc("_matched"), F.desc(F.when(matched, fresh)), F.desc(F.when(~matched, F.col("created_at"))), "rank")
    out = ranked.withColumns({"_top": top, "_matched": matched}).withColumn("_fresh", F.row_number().over(order))
    out = out.where(F.col("_top") | (F.col("_fresh") <= reserve))
    return out.withColumn("position", F.when(F.col("_top"), F.col("rank")).otherwise(k - reserve + F.col("_fresh"))).drop("_top", "_fresh").withColumnRenamed("_matched", "matched")


def own_recall(records: DataFrame, questions: DataFrame, caller: Caller, now: Column, config: Config) -> DataFrame:
    """(qid, position, id, rrf, salience, matched) from the caller's own records."""
    return _own_recall(kept(records.where(own(caller))), questions, now, config)


def _own_recall(mine: DataFrame, questions: DataFrame, now: Column, config: Config) -> DataFrame:
    return chosen(candidates(mine, questions, now, config), F.lit(config.k), config)


def two_sections(records: DataFrame, questions: DataFrame, caller: Caller, now: Column, config: Config) -> DataFrame:
    """Own records, then those of the team: the team has up to ``team_cap`` places, own records what is left of ``k``."""
    return _two_sections(kept(records.where(own(caller))), kept(records.where(team(caller))), questions, now, config)


def _two_sections(own_records: DataFrame, team_records: DataFrame, questions: DataFrame, now: Column, config: Config) -> DataFrame:
    cap = min(config.team_cap, max(config.k, 0))
    theirs = chosen(candidates(team_records, questions, now, config), F.lit(cap), config).withColumn("section", F.lit("team"))
    theirs = written(theirs, "team")  # it is read twice: for the places it leaves, and for its rows
    taken = F.lit(cap) if config.strict_split else F.coalesce("n_team", F.lit(0))
    ranked = candidates(own_records, questions, now, config).join(theirs.groupBy("qid").agg(F.count("*").cast("int").alias("n_team")), "qid", "left")
    mine = chosen(ranked.withColumn("own_k", F.lit(config.k) - taken), F.col("own_k"), config).drop("n_team", "own_k").withColumn("section", F.lit("own"))
    both = mine.unionByName(theirs)
    place = Window.partitionBy("qid").orderBy("section", "position")  # own before team
    return both.withColumn("place", F.row_number().over(place))


def payload(plan: DataFrame, records: DataFrame, most_bytes: int) -> DataFrame:
    """What a caller gets of each chosen record of ``records`` (id, summary, occurred_at, tags)."""
    plan = written(plan, "plan")
    chosen_ids = small(plan.select("id").distinct(), most_bytes)
    rows = records.join(chosen_ids, "id", "left_semi").select("id", "summary", F.date_format("occurred_at", "yyyy-MM-dd").alias("occurred_on"), contributors(F.col("tags")).alias("by"))
    return plan.select("qid", "place", "section", "id", "hit_count", "salience", "matched").join(rows, "id")


def recalled_summary() -> Column:
    return F.trim(F.coalesce(F.nullif(F.col("context_summary"), F.lit("")), F.col("content")))


def contributors(tags: Column) -> Column:
    named = F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit("by:"))), lambda t: F.substring(t, F.lit(4), F.length(t)))
    return F.array_join(F.array_sort(named), ", ")


def recall(records: DataFrame, questions: DataFrame, caller: Caller, now: Column, config: Config) -> DataFrame:
    """The public recall: sections, order and payload. What the payload needs is kept beside what the legs look at: texts are read once for each section."""
    summary = recalled_summary().alias("summary")
    rows = kept(records.where(own(caller)), summary)
    if config.two_section:
        theirs = kept(records.where(team(caller)), summary)
        plan, rows = _two_sections(rows, theirs, questions, now, config), rows.unionByName(theirs)
    else:
        plan = _own_recall(rows, questions, now, config).withColumn("section", F.lit("own")).withColumn("place", F.col("position"))
    return payload(plan, rows, config.max_broadcast_bytes)


def with_hits(records: DataFrame, plan: DataFrame, caller_agent: str, now: Column) -> DataFrame:
    """``records`` after a recall: returned rows get their salience and time of use, matched ones a hit."""
    used = plan.groupBy("id").agg(F.max("salience").alias("_salience"), F.max("matched").alias("_matched"))
    out = records.join(used, "id", "left")
    hit = F.coalesce("_matched", F.lit(False))
    return out.select(
        *(F.col(c) for c in records.columns if c not in ("hit_count", "salience", "last_used_at", "last_hit_by")),
        (F.col("hit_count") + hit.cast("long")).alias("hit_count"),
        F.col("_salience").alias("salience"),
        F.when(F.col("_salience").isNotNull(), now).alias("last_used_at"),
        F.when(hit, F.lit(caller_agent)).alias("last_hit_by"),
    )


def _stems(rows: DataFrame, wanted: DataFrame, most_bytes: int, key: str, texts: Column, *more: str) -> DataFrame:
    """(``key``, ``more``..., stem, positions): where each of the ``wanted`` stems stands in a row's text, counted in words of any kind.
    Only words of such a stem go on from the tasks that cut the texts."""
    words = rows.select(key, *more, F.posexplode(text.tokens(texts)).alias("pos", "token"))
    # a vocabulary has few bytes but much work: it is dealt to all tasks, and stemmed once
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = written(stem.with_stems(words.select("token").distinct().repartition(tasks, "token")), "stems")
    known = known.join(small(wanted.select("stem").distinct(), most_bytes), "stem", "left_semi")
    return words.join(small(known, most_bytes), "token").groupBy(key, *more, "stem").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def cover_density(entries: Column, terms: Column) -> Column:
    """The sum over the shortest windows with all terms of 0.1 / (1 + words in the window that are no terms).

    ``entries`` are (pos, term) by position, a term being a number from 0 below ``terms``. A window ends where the earliest of the
    terms' last places moves on; the next shortest one begins behind its beginning.
    """
    none = F.lit(-1).cast("long")
    state = F.struct(F.array_repeat(F.struct(none.alias("pos"), none.alias("at")), terms).alias("last"), none.alias("begin"), none.alias("at"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        last = F.transform(s["last"], lambda y, i: F.when(i == x["term"], F.struct(x["pos"].cast("long").alias("pos"), at.alias("at"))).otherwise(y))

        def moved(y: Column) -> Column:
            first = y["first"]
            new = (first["pos"] >= 0) & (first["pos"] > s["begin"])
            noise = (x["pos"] - first["pos"]) - (at - first["at"])
            return F.struct(y["last"].alias("last"), F.when(new, first["pos"]).otherwise(s["begin"]).alias("begin"), at.alias("at"), (s["sum"] + F.when(new, 0.1 / (1 + noise)).otherwise(0.0)).alias("sum"))

        # each is computed once, however often it is used
        both = F.transform(F.array(last), lambda z: F.struct(z.alias("last"), F.array_min(z).alias("first")))
        return F.transform(both, moved)[0]

    return F.aggregate(entries, state, step, lambda s: s["sum"])


def stem_leg(records: DataFrame, questions: DataFrame, config: Config) -> DataFrame:
    """Records by the stems they share with the question: with any of them, by how many of their words are such (0.1 each, the density of windows of
    one word); or, conjunctive, with all of them, by the density of the shortest windows that hold all. Equal ones by time."""
    asked = questions.select("qid", "as_of", F.explode(F.array_distinct(text.query_terms(F.col("query")))).alias("token"))
    known = stem.with_stems(asked.select("token").distinct())
    wanted = asked.join(known, "token").select("qid", "as_of", "stem").distinct()
    wanted = wanted.withColumn("term", F.row_number().over(Window.partitionBy("qid").orderBy("stem")) - 1)
    wanted = written(wanted, "wanted")
    held = _stems(records, wanted, config.max_broadcast_bytes, "id", F.col("_hay"), "created_at", "occurred_at")
    met = held.join(small(wanted, config.max_broadcast_bytes), "stem").where(as_of())
    if config.lexical_any:
        scored = met.groupBy("qid", "id", "created_at").agg(F.round(F.sum(F.size("positions")) * 0.1, 9).alias("score"))
        return _top(scored, config.candidate_limit, F.desc("score"), F.desc("created_at")).select("qid", "id", "rank", "score")
    sizes = wanted.groupBy("qid").agg(F.count("*").alias("terms"))
    term = F.col("term")
    entries = F.sort_array(F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), term.alias("term"))))))
    every = met.groupBy("qid", "id", "created_at").agg(entries.alias("entries"), F.count("*").alias("n")).join(sizes, "qid").where("n = terms")
    scored = every.select("qid", "id", "created_at", F.round(cover_density(F.col("entries"), F.col("terms").cast("int")), 9).alias("score"))
    return _top(scored, config.candidate_limit, F.desc("score"), F.desc("created_at")).select("qid", "id", "rank", "score")
