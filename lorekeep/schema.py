"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _table(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_S, _T = StringType(), TimestampType()

RECORD = _table(
    ("id", _S), ("created_at", _T), ("last_used_at", _T), ("occurred_at", _T), ("hit_count", IntegerType()), ("last_hit_by", _S), ("memory_tier", _S), ("user_id", _S), ("customer_id", _S), ("project_id", _S),
    ("session_id", _S), ("agent_type", _S), ("discipline", _S), ("authority", _S), ("is_active", BooleanType()), ("valid_from", _T), ("valid_to", _T), ("superseded_by_id", _S), ("content", _S), ("context_summary", _S),
    ("agent_summary", _S), ("content_tokens", ArrayType(_S)), ("embedding", ArrayType(FloatType())), ("salience", DoubleType()), ("source_message_id", _S), ("parent_id", _S), ("tags", ArrayType(_S)),
)
TAG = _table(("id", _S), ("scope_key", _S), ("label", _S))
TAG_LINK = _table(("memory_id", _S), ("tag_id", _S))
RECEIPT = _table(("id", _S), ("payload_sha256", _S), ("created_at", _T))
RUN = _table(("id", _S), ("scope_key", _S), ("last_run_at", _T), ("groups_merged", IntegerType()), ("rows_archived", IntegerType()), ("cost_calls", IntegerType()))
FACT = _table(("summary", _S), ("tags", ArrayType(_S)), ("occurred_at", _S))
TURN = _table(("conversation_id", _S), ("turn_pos", LongType()), ("turn_id", _S), ("speaker", _S), ("text", _S), ("occurred_at", _T))
QA = _table(("conversation_id", _S), ("qa_id", _S), ("question", _S), ("gold_answers", ArrayType(_S)), ("category", _S), ("gold_turn_ids", ArrayType(_S)), ("abstention", BooleanType()), ("question_date", _T))
