"""Scopes as predicates that stay below every ranking, so that they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caller:
    user_id: object
    agent_type: str
    project_id: object = None
    customer_id: object = None


def own(caller: Caller) -> Column:
    """Active records of the caller's user and persona in the caller's project; no project means records without one."""
    return (F.col("user_id") == F.lit(caller.user_id)) & (F.col("agent_type") == F.lit(caller.agent_type)) & F.col("project_id").eqNullSafe(F.lit(caller.project_id)) & F.col("is_active")


def team(caller: Caller) -> Column:
    """Active records of the same customer and project that are not the caller's own."""
    mine = (F.col("user_id") == F.lit(caller.user_id)) & (F.col("agent_type") == F.lit(caller.agent_type))
    return (F.col("customer_id") == F.lit(caller.customer_id)) & (F.col("project_id") == F.lit(caller.project_id)) & ~mine & F.col("is_active")


def browsing(caller: Caller, scope: str) -> Column:
    """``own`` is the caller's user, ``team`` everyone else of the project, ``all`` both; of the caller's persona."""
    pool = (F.col("customer_id") == F.lit(caller.customer_id)) & F.col("project_id").eqNullSafe(F.lit(caller.project_id)) & F.col("is_active") & (F.col("agent_type") == F.lit(caller.agent_type))
    mine = F.col("user_id") == F.lit(caller.user_id)
    return pool & {"own": mine, "team": ~mine, "all": F.lit(True)}[scope]


def in_scope(records: DataFrame, caller: Caller, record_id: object) -> DataFrame:
    """The record of an id, of any persona of the caller's project and customer; an unknown or foreign id is an error."""
    found = records.where(F.col("id") == F.lit(record_id)).limit(1)
    allowed = F.col("project_id").eqNullSafe(F.lit(caller.project_id)) & F.col("customer_id").eqNullSafe(F.lit(caller.customer_id))
    row = found.select(allowed.alias("allowed")).first()
    if row is None:
        raise ValueError(f"record {record_id} not found")
    if not row.allowed:
        raise ValueError(f"record {record_id} is out of scope")
    return found


def row_scope(caller: Caller) -> Column:
    return F.when(F.col("user_id") == F.lit(caller.user_id), "own").otherwise("team")


def between(after: str | datetime | None = None, before: str | datetime | None = None) -> Column:
    """Event-time bounds, both inclusive; an undated record fails either."""
    out = F.lit(True)
    if after is not None:
        out = out & (F.col("occurred_at") >= F.lit(after).cast("timestamp"))
    if before is not None:
        out = out & (F.col("occurred_at") <= F.lit(before).cast("timestamp"))
    return out


def as_of(bound: str = "as_of") -> Column:
    """The bound of each question; none means any record."""
    return F.col(bound).isNull() | (F.col("occurred_at") <= F.col(bound))


def never_merge(records: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Records that no tag protects from merging."""
    return records.where(~F.coalesce(F.arrays_overlap("tags", F.array(*(F.lit(x) for x in labels))), F.lit(False)))


def current() -> Column:
    return F.col("valid_to").isNull()


def with_tags(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records with any of the labels in ``wanted`` (label)."""
    links = records.select("id", F.explode("tags").alias("label"))
    return records.join(links.join(wanted, "label").select("id").distinct(), "id", "left_semi")
