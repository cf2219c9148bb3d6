"""Storing what a model finds in messages: extraction by mode as a table function, facts as rows to append, an outcome for each message.

Modes: ``atomic``, each fact a row; without a model that answers, the message's plain summary, marked degraded. ``gated``, one summary if
the model finds the message worth it, with the agent's side in two-section settings; ``summary``, one summary always. In the last two a message is not
stored, visibly, while the model does not answer. ``auto`` is what the settings say.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.shared import bounded_batches, written
from .ingest import as_records, new_facts

MODES = ("auto", "atomic", "gated", "summary")


class ExtractionUnavailable(Exception):
    """The model gave no answer, or none that can be read."""


class Fact(NamedTuple):
    summary: str
    tags: list[str] = []
    occurred_at: str | None = None


class Extractor(Protocol):
    """What a model does; any of these but ``plain`` may raise ``ExtractionUnavailable``."""

    def atomic(self, content: str) -> list[Fact]: ...

    def summary(self, content: str, gate: bool) -> Fact: ...

    def two_section(self, content: str) -> tuple[Fact, str | None]: ...

    def plain(self, content: str) -> Fact: ...


_FOUND = "fact_pos int, summary string, tags array<string>, fact_occurred_at string, agent_summary string, degraded boolean, reason string"


def extraction(make: Callable[[], Extractor], mode: str, two_section: bool):
    """The table function of a mode: rows of facts, or one row with the reason why there is none. The model is made once in each worker."""

    class Extract:
        def __init__(self) -> None:
            self.model = make()

        def eval(self, content: str):
            if not content or not content.strip():
                yield None, None, None, None, None, False, "empty"
                return
            agent, reason = None, None
            try:
                if mode == "atomic":
                    facts = self.model.atomic(content)
                elif mode == "gated" and two_section:
                    fact, agent = self.model.two_section(content)
                    facts = [fact]
                else:
                    facts = [self.model.summary(content, mode == "gated")]
            except ExtractionUnavailable as e:
                reason = f"extraction unavailable ({e}); " + ("plain summary" if mode == "atomic" else "not stored")
                facts = [self.model.plain(content)] if mode == "atomic" else []
            facts = [x for x in facts if x.summary and x.summary.strip()]
            for i, fact in enumerate(facts):
                yield i, fact.summary, list(fact.tags), fact.occurred_at, agent, reason is not None, reason
            if not facts:
                yield None, None, None, None, None, reason is not None, reason or "nothing worth storing"

    return F.udtf(Extract, returnType=_FOUND, useArrow=True)


def resolved(mode: str, config: Config) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return ("atomic" if config.atomic_facts else "gated") if mode == "auto" else mode


def store_facts(messages: DataFrame, existing: DataFrame, make: Callable[[], Extractor], now: Column, config: Config, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows to append, outcomes) of messages (message_id, scope, customer_id, contributor, content).

    A fact whose summary is stored and active in its scope, or comes from an earlier message (by id) or earlier in its own, is
    not stored again. An outcome has message_id, mode, written, written_chars, degraded, reason. The model runs once: what it found is a written table.
    """
    bounded_batches(messages.sparkSession)
    mode = resolved(mode, config)
    find = extraction(make, mode, config.two_section)
    found = written(messages.lateralJoin(find(F.col("content").outer())), "facts")
    facts = found.where("fact_pos IS NOT NULL").withColumns(
        {
            "pos": F.struct("message_id", "fact_pos"),
            "occurred_at": F.to_timestamp("fact_occurred_at"),
            "tags": F.array_append("tags", F.concat(F.lit("by:"), "contributor")),
        }
    )
    fresh = new_facts(facts, existing)
    counts = fresh.groupBy("message_id").agg(F.count("*").alias("written"), F.sum(F.length("summary")).alias("written_chars"))
    said = found.groupBy("message_id").agg(F.bool_or("degraded").alias("degraded"), F.any_value("reason").alias("reason"))
    outcomes = said.join(counts, "message_id", "left").select(
        "message_id", F.lit(mode).alias("mode"), F.coalesce("written", F.lit(0)).alias("written"), F.coalesce("written_chars", F.lit(0)).alias("written_chars"), "degraded", "reason"
    )
    return as_records(fresh, now), outcomes
