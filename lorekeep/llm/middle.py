"""Fill-in-middle transformation by an event scan (operator 12).

A text is cut at two of its units into prefix, middle and suffix, which are put in
another order with a sentinel before each. One Aho-Corasick automaton finds, in a
single pass, the sentinels and the ASCII characters that change the class of a text:
white space, which ends a word, and line ends. Only where the class changes is an event
kept. Between two events a text is of one class, so the number of units in a gap follows
from its length: as many as it has code points (``char``), one (``word``: a run of white
space or of anything else), or one behind each line end (``line``). The sums of these
numbers at the events are the index in which a rank is looked up: a binary search finds
the gap, arithmetic the place in it. The same events say whether a cut splits a word,
and the scan of an output finds the sentinels by which it is taken apart again.

Forms: ``plain``, the text as it is, for empty texts, for texts that hold a sentinel's
string and for those that the draw leaves as they are; ``psm`` and ``spm`` otherwise.
Draws follow from the seed and the document's id alone, so reruns agree; rows with the same id
are cut by the same draws. Null texts are empty ones. Rows without an id are left out, other
columns ignored. Memory of a task is a batch and about 60 bytes an event of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches

#: Strings before prefix, suffix and middle.
SENTINELS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
#: Of 100 texts so many are transformed, and of 100 of these so many have the suffix first.
RATE, SUFFIX_FIRST, SEED = 90, 20, 1

#: What an event is: a character of white space that is no line end, a line end, a sentinel.
_BLANK, _LINE = 1, 2
_automaton: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """The automaton of class-changing characters and sentinels, one in each process."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for character in "\t\x0b\x0c\r ":
            made.add_word(character, _BLANK)
        made.add_word("\n", _LINE)
        for sentinel in SENTINELS:
            made.add_word(sentinel, sentinel)
        made.make_automaton()
        _automaton = made
    return _automaton


@dataclass
class Events:
    """Where gaps of one class begin (the first at 0), how many units are before each, the units in each gap, and whether it is white space."""

    starts: np.ndarray
    before: np.ndarray
    counts: np.ndarray
    blank: np.ndarray
    unit: str
    length: int

    @property
    def units(self) -> int:
        return int(self.before[-1] + self.counts[-1]) if len(self.starts) else 0

    def place(self, rank: int) -> int:
        """The code point at which the unit of a rank begins; the text's end for the rank behind the last."""
        if rank >= self.units:
            return self.length
        gap = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[gap]) + (rank - int(self.before[gap]) if self.unit == "char" else 0)

    def inside_word(self, at: int) -> bool:
        """Whether the characters on both sides of a place belong to one word."""
        gap = int(np.searchsorted(self.starts, at, side="right")) - 1
        return 0 < at < self.length and not self.blank[gap] and int(self.starts[gap]) < at


def scanned(text: str, unit: str = "char") -> tuple[Events, list[tuple[int, str]]]:
    """The events of a text, and (place, sentinel) of the sentinels in it, from one pass of the automaton."""
    at, kind, sentinels = [], [], []
    for end, found in automaton().iter(text):
        if found.__class__ is int:
            at.append(end)
            kind.append(found)
        else:
            sentinels.append((end - len(found) + 1, found))
    where, what = np.array(at, dtype=np.int64), np.array(kind, dtype=np.int8)
    if not text:
        empty = np.zeros(0, dtype=np.int64)
        return Events(empty, empty, empty, empty.astype(bool), unit, 0), sentinels
    if unit == "line":  # the class of a character is the line that it stands in
        starts = np.unique(np.concatenate([[0], where[what == _LINE] + 1]))
        starts = starts[starts < len(text)]
        blank = np.zeros(len(starts), dtype=bool)
    else:
        # runs of adjacent hits: white space begins at a run's first hit and ends behind its last
        opens = where[np.diff(where, prepend=-2) > 1]
        closes = where[np.diff(where, append=len(text) + 2) > 1] + 1
        starts = np.unique(np.concatenate([[0], opens, closes]))
        starts = starts[starts < len(text)]
        blank = np.isin(starts, opens)
    counts = np.diff(starts, append=len(text)) if unit == "char" else np.ones(len(starts), dtype=np.int64)
    return Events(starts, np.cumsum(counts) - counts, counts, blank, unit, len(text)), sentinels


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that follow from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(doc_id: int, text: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, unit: str = "char") -> tuple:
    """(units, form, prefix's and middle's units, whether the cuts split a word, output) of a text."""
    events, sentinels = scanned(text, unit)
    n, drawn = events.units, draws(doc_id, seed)
    if not text or sentinels or drawn[2] % 100 >= rate:
        return n, "plain", None, None, None, None, text
    first, second = sorted(x % (n + 1) for x in drawn[:2])
    a, b = events.place(first), events.place(second)
    form = "spm" if drawn[3] % 100 < suffix_first else "psm"
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    output = suffix + prefix + middle if form == "spm" else prefix + suffix + middle
    return n, form, first, second - first, events.inside_word(a), events.inside_word(b), output


def restored(output: str, form: str) -> str:
    """The text that an output was made of: the parts behind the sentinels that the scan finds, in their first order."""
    if form == "plain":
        return output
    _, found = scanned(output)
    ends = [at for at, _ in found[1:]] + [len(output)]
    parts = {sentinel: output[at + len(sentinel) : end] for (at, sentinel), end in zip(found, ends, strict=True)}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


_MADE = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_splits_word boolean, middle_splits_word boolean, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, unit: str = "char") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_units and middle_units (null if plain), prefix_splits_word, middle_splits_word, output."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.large_string()]
        names = ["n", "form", "prefix_units", "middle_units", "prefix_splits_word", "middle_splits_word", "output"]
        for batch in batches:
            made = [transformed(d, t or "", rate, suffix_first, seed, unit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array([x[i] for x in made], kind) for i, kind in enumerate(kinds)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, _MADE)


def restore(made: DataFrame) -> DataFrame:
    """``made`` with a column ``text``: what each output was made of."""
    bounded_batches(made.sparkSession)
    names = made.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output, form = names.index("output"), names.index("form")
        for batch in batches:
            texts = [restored(o, f) for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return made.mapInArrow(rows, f"{_MADE}, text string")


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"), "prefix_splits_word", "middle_splits_word",
    )
