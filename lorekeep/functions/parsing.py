"""Parsers for model replies and union-typed JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AGENT_SUMMARY, MOST_FACTS, MOST_TAGS, SUMMARY


def unfenced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def extraction(text: Column) -> Column:
    """(worth, summary, agent_summary, tags, occurred_at) of the first object of a reply; null without one."""
    body = F.regexp_extract(unfenced(text), r"(?s)\{.*\}", 0)
    parsed = _json(F.when(body != "", body), "worth_remembering boolean, summary string, agent_summary string, tags array<string>, occurred_at string")
    return F.when(
        parsed["summary"].isNotNull() & (F.trim(parsed["summary"]) != ""),
        F.struct(
            F.coalesce(parsed["worth_remembering"], F.lit(True)).alias("worth"),
            F.substring(F.trim(parsed["summary"]), 1, SUMMARY).alias("summary"),
            F.substring(parsed["agent_summary"], 1, AGENT_SUMMARY).alias("agent_summary"),
            F.slice(F.filter(F.coalesce(parsed["tags"], F.array().cast("array<string>")), lambda t: F.trim(t) != ""), 1, MOST_TAGS).alias("tags"),
            parsed["occurred_at"].alias("occurred_at"),
        ),
    )


_FACT = "array<struct<summary: string, tags: array<string>, occurred_at: string>>"


def atomic_facts(text: Column) -> Column:
    """The facts of a reply: an array, the first array in prose, or one object; entries without a summary are left out."""
    bare = unfenced(text)
    array = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    object_ = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    one = F.concat(F.lit("["), object_, F.lit("]"))
    starts_object = bare.rlike(r"^\s*\{")
    parsed = F.coalesce(F.when(~starts_object & (array != ""), _json(array, _FACT)), F.when(object_ != "", _json(one, _FACT)), F.array().cast(_FACT))
    return F.slice(F.filter(parsed, lambda x: x["summary"].isNotNull() & (F.trim(x["summary"]) != "")), 1, MOST_FACTS)


def judge_label(text: Column) -> Column:
    """Whether a reply's label is CORRECT: from its JSON, else from the text; anything else is not."""
    label = F.coalesce(F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.label"), F.regexp_extract(text, r'(?i)"?label"?\s*[:=]\s*"?(CORRECT|WRONG|INCORRECT)', 1))
    return F.coalesce(F.upper(F.trim(label)) == "CORRECT", F.lit(False))


def verdict(text: Column) -> Column:
    """INCORRECT is looked for before CORRECT; else a ``yes``."""
    return F.when(text.rlike(r"(?i)\bINCORRECT\b"), False).when(text.rlike(r"(?i)\bCORRECT\b"), True).otherwise(F.coalesce(F.contains(F.lower(text), F.lit("yes")), F.lit(False)))


RELATIONS = ("conflict", "restatement", "distinct_facts")


def relation(text: Column) -> Column:
    found = F.lower(F.trim(text))
    return F.when(found.isin(*RELATIONS), found).otherwise("distinct_facts")


def step_ids(target: Column) -> Column:
    """``[1, 2]`` or ``[[1, 0], [2, 0]]`` (JSON): the first number of each entry."""
    flat = F.from_json(target, "array<int>")
    nested = F.from_json(target, "array<array<int>>")
    return F.when(target.rlike(r"^\s*\[\s*\["), F.transform(nested, lambda x: x[0])).otherwise(flat)
