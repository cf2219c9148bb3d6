"""Readers of conversation benchmarks into the common turns and questions tables.

Each reader gives (turns, questions) with the schemas TURN and QA. Files are read
by Spark with fixed schemas; values whose JSON type varies are taken as JSON text
and parsed in both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..functions.parsing import step_ids

#: Categories of the multi-session dialogues, and the gold answer of unanswerable questions.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}
UNANSWERABLE = "This question is not answerable from the conversation."

_TURN = ["conversation_id", "turn_pos", "turn_id", "speaker", "text", "occurred_at"]
_QA = ["conversation_id", "qa_id", "question", "gold_answers", "category", "gold_turn_ids", "abstention", "question_date"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _empty() -> Column:
    return F.array().cast("array<string>")


#: What a turn gets for a picture with a query and a caption, with a query, with a caption.
PHOTO_TAGS = ("[Sharing image - query: %s. The image shows: %s]", "[Sharing image - query for: %s]", "[Sharing image that shows: %s]")


def photo_tag(caption: Column, query: Column) -> Column:
    """What a shared picture adds to a turn."""
    caption, query = F.nullif(caption, F.lit("")), F.nullif(query, F.lit(""))
    both, asked, shown = PHOTO_TAGS
    tag = F.when(query.isNotNull() & caption.isNotNull(), F.format_string(both, query, caption))
    return tag.when(query.isNotNull(), F.format_string(asked, query)).when(caption.isNotNull(), F.format_string(shown, caption)).otherwise("")


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Multi-session dialogues: numbered sessions with dates, questions with evidence turns."""
    qa_type = "array<struct<question: string, answer: string, adversarial_answer: string, category: int, evidence: array<string>>>"
    root = _whole(spark, path).select(F.posexplode(F.from_json("value", f"array<struct<conversation: map<string, string>, qa: {qa_type}>>")).alias("idx", "x"))
    base = root.select("idx", F.concat(F.lit("dialogue_"), "idx").alias("conversation_id"), "x.*")
    entries = base.select("conversation_id", "conversation", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    cells = entries.where(number != "").select(
        "conversation_id",
        number.cast("int").alias("session"),
        "key",
        dates.dialogue_time(F.element_at("conversation", F.concat("key", F.lit("_date_time")))).alias("occurred_at"),
        F.posexplode(F.from_json("value", "array<struct<dia_id: string, speaker: string, text: string, blip_caption: string, query: string>>")).alias("n", "c"),
    )
    order = Window.partitionBy("conversation_id").orderBy("session", "n")
    said, tag = text.stripped(F.coalesce("c.text", F.lit(""))), photo_tag(F.col("c.blip_caption"), F.col("c.query"))
    placed = cells.withColumn("turn_pos", (F.row_number().over(order) - 1).cast("long"))
    turns = placed.select(
        "conversation_id",
        "turn_pos",
        F.coalesce(F.expr("nullif(c.dia_id, '')"), F.concat_ws(":", "key", "turn_pos")).alias("turn_id"),
        F.coalesce("c.speaker", F.lit("?")).alias("speaker"),
        F.concat_ws(" ", F.when(said != "", said), F.when(tag != "", tag)).alias("text"),
        "occurred_at",
    )
    asked = base.select("idx", "conversation_id", F.posexplode("qa").alias("j", "q"))
    names = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    category = F.coalesce(F.element_at(names, F.col("q.category")), F.col("q.category").cast("string"), F.lit("None"))
    abstention = (category == "adversarial") | F.col("q.adversarial_answer").isNotNull()
    qa = asked.select(
        "conversation_id",
        F.concat(F.lit("conv"), "idx", F.lit(":q"), "j").alias("qa_id"),
        F.coalesce("q.question", F.lit("")).alias("question"),
        F.array(F.when(abstention, UNANSWERABLE).otherwise(F.coalesce("q.answer", F.lit("")))).alias("gold_answers"),
        category.alias("category"),
        F.array_distinct(F.flatten(F.transform(F.coalesce("q.evidence", _empty()), text.evidence_ids))).alias("gold_turn_ids"),
        abstention.alias("abstention"),
        F.lit(None).cast("timestamp").alias("question_date"),
    )
    return turns.select(_TURN), qa.select(_QA)


_HISTORY = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>, "
    "haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>"
)


def histories(spark: SparkSession, path: str, question_ids: list[str] | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """One question for each chat history, from JSON arrays or (``lines``) JSON lines; ``question_ids`` keeps some of them, by a semi join."""
    rows = spark.read.schema(_HISTORY).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    if question_ids is not None:
        rows = rows.join(spark.createDataFrame([(q,) for q in question_ids], "question_id string"), "question_id", "left_semi")
    rows = rows.withColumn("conversation_id", F.concat(F.lit("history_"), "question_id"))
    # as many sessions as all three lists have
    most = F.least(*(F.size(F.coalesce(c, F.array())) for c in ("haystack_sessions", "haystack_session_ids", "haystack_dates")))
    each = rows.select("conversation_id", "answer_session_ids", most.alias("most"), F.posexplode(F.arrays_zip("haystack_sessions", "haystack_session_ids", "haystack_dates")).alias("s", "x")).where("s < most")
    flagged = F.exists("x.haystack_sessions", lambda t: F.coalesce(t["has_answer"], F.lit(False)))
    said = each.select(
        "conversation_id",
        "s",
        F.col("x.haystack_session_ids").alias("sid"),
        dates.history_time(F.col("x.haystack_dates")).alias("occurred_at"),
        F.coalesce(F.array_contains("answer_session_ids", F.col("x.haystack_session_ids")), F.lit(False)).alias("answers"),
        flagged.alias("flagged"),
        F.posexplode("x.haystack_sessions").alias("t", "m"),
    )
    said = said.withColumn("text", text.stripped(F.coalesce("m.content", F.lit("")))).where("text <> ''").withColumn("turn_id", F.concat_ws(":", "sid", "t"))
    turns = said.select("conversation_id", (F.col("s") * 1_000_000 + F.col("t")).cast("long").alias("turn_pos"), "turn_id", F.coalesce("m.role", F.lit("?")).alias("speaker"), "text", "occurred_at")
    gold = said.where(F.col("answers") & (F.coalesce("m.has_answer", F.lit(False)) | ~F.col("flagged"))).groupBy("conversation_id").agg(F.array_sort(F.collect_set("turn_id")).alias("gold_turn_ids"))
    qa = rows.join(gold, "conversation_id", "left").select(
        "conversation_id",
        F.col("question_id").alias("qa_id"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.array(F.coalesce("answer", F.lit(""))).alias("gold_answers"),
        F.replace(F.coalesce("question_type", F.lit("unknown")), F.lit("-"), F.lit("_")).alias("category"),
        F.coalesce("gold_turn_ids", _empty()).alias("gold_turn_ids"),
        F.endswith("question_id", F.lit("_abs")).alias("abstention"),
        dates.history_time(F.col("question_date")).alias("question_date"),
    )
    return turns.select(_TURN), qa.select(_QA)


def long_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Long documents with a question each, one JSON-lines file for each category."""
    rows = spark.read.schema("input string, question string, context string, answers array<string>, answer string, _id string").json(folder)
    rows = rows.withColumn("category", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1)).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("category").orderBy("_at")) - 1).withColumn("conversation_id", F.concat_ws("_", F.lit("document"), "category", "idx"))
    chunks = rows.select("conversation_id", "category", "idx", F.posexplode(text.word_windows(F.coalesce("context", F.lit("")))).alias("c", "text"))
    turns = chunks.select("conversation_id", F.col("c").cast("long").alias("turn_pos"), F.concat(F.col("category"), F.lit(":"), F.col("idx"), F.lit(":c"), F.col("c")).alias("turn_id"), F.lit("document").alias("speaker"), "text", F.lit(None).cast("timestamp").alias("occurred_at"))
    some = F.size(F.coalesce("answers", _empty())) > 0
    qa = rows.select(
        "conversation_id",
        F.concat_ws(":", "category", "idx").alias("qa_id"),
        F.coalesce("input", "question", F.lit("")).alias("question"),
        F.when(some, F.col("answers")).when(F.col("answer").isNotNull(), F.array("answer")).otherwise(_empty()).alias("gold_answers"),
        "category",
        _empty().alias("gold_turn_ids"),
        F.lit(False).alias("abstention"),
        F.lit(None).cast("timestamp").alias("question_date"),
    )
    return turns.select(_TURN), qa.select(_QA)


_MESSAGE = "struct<mid: string, message: string, user: string, user_message: string, assistant: string, assistant_message: string, time: string, place: string>"


def _choice(value: Column) -> Column:
    """A choice is a text or a list of texts."""
    return F.coalesce(F.when(value.rlike(r"^\s*\["), F.array_join(F.from_json(value, "array<string>"), "; ")), value, F.lit(""))


def stepwise(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories of messages, flat or nested, each with a multiple-choice question."""
    schema = "map<string, array<struct<tid: string, message_list: string, QA: struct<qid: string, question: string, answer: string, choices: map<string, string>, ground_truth: string, target_step_id: string>>>>"
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).withColumn("category", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    rows = files.select("category", F.explode(F.from_json("value", schema)).alias("kind", "list")).select("category", "kind", F.posexplode("list").alias("n", "x"))
    rows = rows.select("category", F.concat_ws("_", F.lit("steps"), "category", "kind", "n").alias("conversation_id"), "x.*")
    nested = F.col("message_list").rlike(r"^\s*\[\s*\[")
    flat = F.when(nested, F.flatten(F.from_json("message_list", f"array<array<{_MESSAGE}>>"))).otherwise(F.from_json("message_list", f"array<{_MESSAGE}>"))
    said = rows.select("conversation_id", F.posexplode(flat).alias("p", "m"))
    user, assistant = F.coalesce("m.user", "m.user_message", F.lit("")), F.coalesce("m.assistant", "m.assistant_message", F.lit(""))
    exchange = F.concat(F.lit("User: "), text.stripped(user), F.lit("\nAssistant: "), text.stripped(assistant))
    turns = said.select(
        "conversation_id",
        F.col("p").cast("long").alias("turn_pos"),
        F.col("m.mid").alias("turn_id"),
        F.when(F.col("m.message").isNotNull(), "user").otherwise("dialogue").alias("speaker"),
        F.coalesce(text.stripped(F.col("m.message")), exchange).alias("text"),
        dates.time_in_text(F.col("m.time")).alias("occurred_at"),
    )
    letter = text.stripped(F.coalesce("QA.ground_truth", F.lit("")))
    chosen = _choice(F.element_at("QA.choices", letter))
    labelled = F.when((letter != "") & (chosen != ""), F.concat_ws(". ", letter, chosen)).when(chosen != "", chosen).otherwise(letter)
    golds = F.array_distinct(F.filter(F.array(labelled, chosen, _choice(F.col("QA.answer")), letter), lambda g: g != ""))
    options = F.transform(F.map_entries("QA.choices"), lambda e: F.concat(e["key"], F.lit(". "), _choice(e["value"])))
    lines = F.concat(F.array(F.coalesce("QA.question", F.lit("")), F.lit(""), F.lit("Options:")), F.coalesce(options, _empty()), F.array(F.lit(""), F.lit("Answer with the text of the single best option.")))
    qa = rows.select(
        "conversation_id",
        F.concat("conversation_id", F.lit(":q"), F.coalesce("QA.qid", F.lit("0"))).alias("qa_id"),
        F.array_join(lines, "\n").alias("question"),
        F.when(F.size(golds) > 0, golds).otherwise(F.array(letter)).alias("gold_answers"),
        "category",
        F.array_distinct(F.coalesce(step_ids(F.col("QA.target_step_id")).cast("array<string>"), _empty())).alias("gold_turn_ids"),
        F.lit(False).alias("abstention"),
        F.lit(None).cast("timestamp").alias("question_date"),
    )
    return turns.select(_TURN), qa.select(_QA)
