"""Date and time functions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EXCERPT

#: Date formats of the conversation benchmarks.
DIALOGUE_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMMM yyyy", "h:mm a 'on' MMMM d, yyyy", "H:mm 'on' d MMMM, yyyy", "d MMMM, yyyy", "d MMMM yyyy", "MMMM d, yyyy")
HISTORY_FORMATS = ("yyyy/MM/dd HH:mm", "yyyy/MM/dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def as_utc(value: Column) -> Column:
    """A timestamp without zone, read as UTC."""
    return value.cast("timestamp")


def first_format(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def iso_instant(text: Column) -> Column:
    """An ISO date (midnight) or date-time with or without an offset; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text))


def iso_instant_strict(text: Column) -> Column:
    """As ``iso_instant``; blank texts are null, anything else that is no ISO date or time is an error."""
    said = F.trim(text)
    return F.when(F.coalesce(said, F.lit("")) != "", F.coalesce(iso_instant(said), F.raise_error(F.concat(F.lit("no ISO date: "), said)).cast("timestamp")))


def dialogue_time(text: Column) -> Column:
    return first_format(F.trim(F.regexp_replace(text, r"\s+", " ")), DIALOGUE_FORMATS)


def history_time(text: Column) -> Column:
    """Formats like ``2023/05/07 (Sun) 13:56``; the weekday is ignored."""
    return first_format(F.trim(F.regexp_replace(F.regexp_replace(text, r"\([A-Za-z]+\)", " "), r"\s+", " ")), HISTORY_FORMATS)


def time_in_text(text: Column) -> Column:
    """The first ``yyyy-mm-dd hh:mm`` in a text."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm"))


def end_of_day(moment: Column) -> Column:
    return F.date_trunc("day", moment) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def age_days(created_at: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(created_at)) / F.lit(86_400_000_000.0), F.lit(0.0))


def recency(created_at: Column, now: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(2.0), -age_days(created_at, now) / half_life_days)


#: Fixed value: what names a date in a text, a year or the name of a month.
EXPLICIT_DATE = r"(?i)\b(19|20)\d{2}\b|\b(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)\b"


def has_explicit_date(text: Column) -> Column:
    """A year or the name of a month stands in the part of the text that a model reads."""
    return F.substring(text, 1, EXCERPT).rlike(EXPLICIT_DATE)


def guarded_date(occurred_at: Column, text: Column, reference: Column) -> Column:
    """A date that was read out of a text counts only with a reference date or if the text names one."""
    return F.when(reference.isNotNull() | has_explicit_date(text), occurred_at)


def anchor_line(reference: Column) -> Column:
    return F.concat(F.lit("Reference date: "), F.date_format(reference, "yyyy-MM-dd (EEEE)"))
