"""A thin service over a store of records: validated adds that are taken once, and searches; one batch a call."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from . import recall as R
from .ingest import NAMESPACE
from .scope import Caller

_NS = uuid.UUID(NAMESPACE)


class Refused(ValueError):
    """A request that breaks the rules; ``status`` as in HTTP."""

    def __init__(self, status: int, reason: str) -> None:
        super().__init__(reason)
        self.status = status


def world(user: str) -> Caller:
    """The scope of an outer user id: its own user and project."""
    return Caller(str(uuid.uuid5(_NS, json.dumps(["user", user]))), "service", str(uuid.uuid5(_NS, json.dumps(["project", user]))), None)


_ROW = "id string, user_id string, agent_type string, project_id string, customer_id string, content string, context_summary string, created_at timestamp, occurred_at timestamp, hit_count long, is_active boolean, embedding array<float>, tags array<string>"
_RECEIPT = "id string, payload_sha256 string"


@dataclass
class Service:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    records: DataFrame | None = None
    receipts: DataFrame | None = None

    def __post_init__(self) -> None:
        self.records = self.records if self.records is not None else self.spark.createDataFrame([], _ROW)
        self.receipts = self.receipts if self.receipts is not None else self.spark.createDataFrame([], _RECEIPT)

    def add(self, request: dict) -> dict:
        """Store the messages of a request; the same request again does nothing, another payload under its id is refused."""
        if set(request) != {"request_id", "user_id", "session_id", "messages"} or not request["messages"]:
            raise Refused(422, "fields")
        for m in request["messages"]:
            if not set(m) <= {"role", "content", "timestamp"} or m.get("role") not in ("user", "assistant") or not str(m.get("content", "")).strip():
                raise Refused(422, "message")
            if m.get("timestamp") is not None and not -62135596800000 <= m["timestamp"] <= 253402300799999:
                raise Refused(422, "timestamp")
        caller = world(request["user_id"])
        digest = payload_digest(request)
        receipt = str(uuid.uuid5(_NS, json.dumps(["request", request["user_id"], request["request_id"]])))
        known = self.receipts.where(F.col("id") == receipt).first()
        if known and known.payload_sha256 != digest:
            raise Refused(409, "request id of another payload")
        if known:
            return {"written": 0}
        now = datetime.now(UTC)
        rows = [
            (str(uuid.uuid5(_NS, json.dumps([receipt, i]))), caller.user_id, caller.agent_type, caller.project_id, None, m["content"], m["content"].strip(), now, datetime.fromtimestamp(m["timestamp"] / 1000, UTC) if m.get("timestamp") is not None else None, 0, True, None, [])
            for i, m in enumerate(request["messages"])
        ]
        # rows and receipt become visible together
        self.records, self.receipts = self.records.unionByName(self.spark.createDataFrame(rows, _ROW)), self.receipts.unionByName(self.spark.createDataFrame([(receipt, digest)], _RECEIPT))
        return {"written": len(rows)}

    def search(self, request: dict) -> list[str]:
        """The evidence for a query, best first, dated where it has a date; own records only."""
        if not str(request.get("query", "")).strip() or not 1 <= request.get("top_k", 10) <= 100:
            raise Refused(422, "query")
        asked = self.spark.createDataFrame([(0, request["query"], None, None)], "qid long, query string, vector array<float>, as_of timestamp")
        found = R.own_recall(self.records, asked, world(request["user_id"]), F.current_timestamp(), self.config.but(k=request.get("top_k", 10)))
        dated = F.concat(F.lit("["), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("] "), F.col("content"))
        rows = found.select("id", "position").join(self.records, "id").select("position", F.coalesce(dated, "content").alias("evidence"))
        return [r.evidence for r in rows.orderBy("position").collect()]

    def prompt(self, request: dict) -> str:
        """A prompt with the found evidence, escaped, in front."""
        found = self.search(request)
        block = self.spark.createDataFrame([(found,)], "found array<string>").select(F.array_join(F.transform("found", text.escape_markup), "\n")).first()[0]
        return f"<memory>\n{block}\n</memory>\n{request['query']}"


def payload_digest(request: dict) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
