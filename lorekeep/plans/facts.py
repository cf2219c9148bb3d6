"""Queries of fact storing in each mode, with their SQL: the extractor is a rule, so that SQL can say what it finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import MOST_FACTS, SUMMARY
from ..operators.facts import ExtractionUnavailable, Fact, store_facts
from ..sources import tables as T
from . import prelude as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_BLANK = " \t\n\r\x0b\x0c"


class Sentences:
    """Sentences as facts; a text whose length is a multiple of 7 has no answer, one of 5 is not worth a summary."""

    def _answer(self, content: str) -> None:
        if len(content) % 7 == 0:
            raise ExtractionUnavailable("no answer")

    def atomic(self, content):
        self._answer(content)
        return [Fact(x.strip(_BLANK), ["fact"]) for x in content.split(". ")[:MOST_FACTS]]

    def summary(self, content, gate):
        self._answer(content)
        return Fact("") if gate and len(content) % 5 == 0 else self.plain(content)

    def two_section(self, content):
        return self.summary(content, True), content[-40:].strip(_BLANK)

    def plain(self, content):
        return Fact(content[:SUMMARY].strip(_BLANK))


def _messages(spark, d):
    rows = T.records(spark, d)
    return rows.select(F.col("id").alias("message_id"), "user_id", "agent_type", "project_id", "customer_id", F.concat(F.lit("u"), "user_id").alias("contributor"), "content")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PLAIN = _STRIP.format(f"substring(content, 1, {SUMMARY})")
_OUT = "length(content) % 7 = 0"
_BARE = r"length(regexp_replace(coalesce(content, ''), '\s+', '', 'g')) = 0"


def _sql(mode: str) -> str:
    if mode == "atomic":
        found = f"CASE WHEN {_OUT} THEN [{_PLAIN}] ELSE list_transform(list_slice(string_split(content, '. '), 1, {MOST_FACTS}), lambda x: {_STRIP.format('x')}) END"
    else:
        found = f"CASE WHEN {_OUT}{' OR length(content) % 5 = 0' if mode == 'gated' else ''} THEN []::VARCHAR[] ELSE [{_PLAIN}] END"
    after = "plain summary" if mode == "atomic" else "not stored"
    return P.query(
        P.RECORDS,
        f"m AS (SELECT id, user_id, agent_type, project_id, content, {_BARE} AS bare FROM records)",
        f"f AS (SELECT *, list_filter(CASE WHEN bare THEN []::VARCHAR[] ELSE {found} END, lambda x: x <> '') AS facts FROM m)",
        "e AS (SELECT id, user_id, agent_type, project_id, generate_subscripts(facts, 1) AS n, trim(unnest(facts)) AS summary FROM f)",
        "o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, agent_type, project_id, summary ORDER BY id, n) = 1)",
        "w AS (SELECT id, count(*) AS written, sum(length(summary))::BIGINT AS chars FROM o WHERE NOT EXISTS (SELECT 1 FROM records AS r WHERE r.is_active AND r.user_id = o.user_id AND r.agent_type = o.agent_type AND r.project_id = o.project_id AND r.context_summary = o.summary) GROUP BY id)",
        select=f"SELECT f.id AS message_id, '{mode}' AS mode, coalesce(w.written, 0) AS written, coalesce(w.chars, 0) AS written_chars, NOT bare AND {_OUT} AS degraded, CASE WHEN bare THEN 'empty' WHEN {_OUT} THEN 'extraction unavailable (no answer); {after}' WHEN len(facts) = 0 THEN 'nothing worth storing' END AS reason FROM f LEFT JOIN w ON w.id = f.id",
    )


def _outcomes(mode: str, config: Config = Config()):
    def run(spark, d):
        return store_facts(_messages(spark, d), T.records(spark, d), Sentences, T.now(), config, mode)[1]

    return run


for _mode in ("atomic", "gated", "summary"):
    QUERIES[f"store_facts_{_mode}"], ORACLE[f"store_facts_{_mode}"] = _outcomes(_mode), _sql(_mode)
QUERIES["store_facts_auto"], ORACLE["store_facts_auto"] = _outcomes("auto", Config(atomic_facts=True)), _sql("atomic")
