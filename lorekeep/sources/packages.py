"""Results as JSON, and submissions as archives that hold exactly the expected answers."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import coverage


def strict_json(text: str) -> object:
    """JSON without repeated keys and without NaN or infinities; anything else raises."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key stands twice")
        return out

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=once, parse_constant=refuse)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line, in parts; keys in order."""
    results.select(F.to_json(F.struct(*sorted(results.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def package(expected: DataFrame, answers: DataFrame, path: str, key: str = "index") -> int:
    """A ZIP of the answers, in order, if their keys are exactly the expected ones, each once; gives their number.

    The archive is one file, so the answers stream through the driver one partition at a time.
    """
    repeated = answers.groupBy(key).count().where("count > 1").limit(3).collect()
    if repeated:
        raise ValueError(f"answered more than once: {[r[0] for r in repeated]}")
    wrong = coverage(expected, answers, key).limit(5).collect()
    if wrong:
        raise ValueError(f"not the expected answers: {[tuple(r) for r in wrong]}")
    if Path(path).exists():
        raise FileExistsError(path)
    count = 0
    ordered = answers.orderBy(key).select(F.to_json(F.struct(*sorted(answers.columns)), {"ignoreNullFields": "false"}).alias("value"))
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z, z.open("answers.jsonl", "w") as f:
        for row in ordered.toLocalIterator():
            f.write(row.value.encode() + b"\n")
            count += 1
    return count
