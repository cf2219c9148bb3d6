"""Identifiers and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based (SHA-1) UUID of a text in a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def payload_digest(payload: Column) -> Column:
    return F.sha2(F.encode(payload, "UTF-8"), 256)


def card_id(summary: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.trim(summary), "UTF-8")), 1, 12)


def canonical_json(*columns: str) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def hash_embedding(text: Column, dimensions: int = 384) -> Column:
    """A repeatable unit vector of a text from the bytes of its SHA-256; null for blank texts."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    value = lambda i: (F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), value)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.trim(text) != "", F.transform(raw, lambda x: x / norm))
