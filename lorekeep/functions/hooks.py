"""Pluggable models: embedders, extractors and judges are plain Python callables, run in batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embedding(make: Callable[[], Embedder], batch: int = 64) -> Callable[[Column], Column]:
    """A column function that embeds texts; the model is made once in each worker, batches are sorted by length, blank texts have no vector."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            some = texts[texts.fillna("").str.strip() != ""]
            some = some.loc[some.str.len().sort_values(kind="stable").index]
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for at in range(0, len(some), batch):
                chunk = some.iloc[at : at + batch]
                for i, vector in zip(chunk.index, model.embed(chunk.tolist()), strict=True):
                    out[i] = vector
            yield out

    return embed


def extracted(rows: DataFrame, text_col: str, extract: Callable[[str], list[dict]] | None) -> DataFrame:
    """Facts of each row by a model: fact_pos, summary, tags, occurred_at; without a model the text itself is the one fact, marked degraded."""
    if extract is None:
        return rows.select("*", F.lit(0).alias("fact_pos"), F.col(text_col).alias("summary"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("occurred_at"), F.lit(True).alias("degraded"))

    @F.udf("array<struct<summary: string, tags: array<string>, occurred_at: string>>", useArrow=True)
    def facts(text: str):
        return [{"summary": x.get("summary"), "tags": x.get("tags") or [], "occurred_at": x.get("occurred_at")} for x in extract(text or "") if x.get("summary")]

    return rows.withColumn("_facts", facts(text_col)).select(*rows.columns, F.posexplode("_facts").alias("fact_pos", "f")).select(*rows.columns, "fact_pos", "f.*", F.lit(False).alias("degraded"))
