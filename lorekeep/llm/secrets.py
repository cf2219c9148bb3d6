"""Secret scan: a keyword automaton, anchored patterns near its hits, checksums (operator 8).

One Aho-Corasick automaton finds all keywords in a single pass over a text; a
pattern is tried only where its keyword was hit, anchored there. Runs of
hexadecimal digits have no keyword: the bytes are classified and the runs
measured. Kinds with a checksum in them are reported only if it holds.

Base kinds, leftmost and without overlap within a kind; a match that is too short
takes its place but is not reported:

* assign: a key word, a separator and a value of 8 or more characters
* access: AKIA and upper-case letters or digits, 16 characters or more
* hex: 32 or more lower-case hexadecimal digits

Kinds of this method:

* github, npm: a prefix, 30 base-62 characters and the CRC-32 of these in base 62
* jwt: three base64url parts whose first decodes to a JSON object with "alg"
* pem: a private key between its BEGIN and END lines, headers of encrypted ones included

Offsets are code points, ends exclusive. Null and empty texts have no spans. Each
row has its result, repeated ids too; one without an id is left out. A text takes
time in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import id_and_text
from .scratch import bounded_batches
from .textbytes import byte_class, slices

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "pem")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[^-]*+(?:-(?!----)[^-]*+)*+-----END \1-----")
_HEX = byte_class((0x30, 0x39), (0x61, 0x66))
_SMALL = {c: c + 32 for c in range(65, 91)}
#: The order of base-62 digits in tokens with a checksum.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_KEYWORDS = {word: "assign" for word in ("password", "passwd", "secret", "token", "apikey", "api_key")}
_KEYWORDS |= {"akia": "access", "npm_": "npm", "eyj": "jwt", "-----begin": "pem"} | {f"gh{c}_": "github" for c in "pousr"}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def checksum_holds(body: str) -> bool:
    """Whether the last six of 36 base-62 characters are the CRC-32 of the first thirty."""
    value = 0
    for c in body[30:]:
        value = value * 62 + _DIGITS.index(c)
    return value == zlib.crc32(body[:30].encode())


def _is_jwt(head: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, TypeError):
        return False


def _match(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """(end, whether it is reported) of the anchored match at a hit."""
    if kind == "assign":
        found = _ASSIGN.match(text, at)
        return found and (found.end(), len(found[2]) >= 8)
    if kind == "access":
        found = _ACCESS.match(text, at)
        return found and (found.end(), found.end() - at >= 16)
    if kind in ("github", "npm"):
        found = _CHECKED.match(text, at)
        return found and (found.end(), checksum_holds(found[1]))
    if kind == "jwt":
        found = _JWT.match(text, at)
        return found and (found.end(), _is_jwt(found[1]))
    found = _PEM.match(text, at)
    return found and (found.end(), True)


def keyword_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all kinds that have a keyword."""
    small = text.lower()
    if len(small) != len(text):  # a capital whose small form is longer
        small = text.translate(_SMALL)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(small))
    out, behind = [], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < behind[kind]:
            continue
        if found := _match(kind, text, at):
            behind[kind] = found[0]
            if found[1]:
                out.append((at, found[0], kind))
        elif kind == "jwt" and text.startswith("eyJ", at):  # what fails here depends on what follows the run: the hits within it fail too
            behind[kind] = _JWT_RUN.match(text, at).end()
    return out


def _hex_spans(data: np.ndarray, offsets: np.ndarray, least: int = 32) -> dict[int, list[tuple[int, int, str]]]:
    """Spans of hexadecimal runs by row."""
    mask = np.concatenate([[False], _HEX[data], [False]])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(mask[1:] & (~mask[:-1] | cut))
    ends = np.flatnonzero(mask[:-1] & (~mask[1:] | cut))
    keep = ends - starts >= least
    out: dict[int, list[tuple[int, int, str]]] = {}
    for start, end in zip(starts[keep], ends[keep], strict=True):
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        first = int(((data[offsets[row] : start] & 0xC0) != 0x80).sum())
        out.setdefault(row, []).append((first, first + int(end - start), "hex"))
    return out


def spans_in(column: pa.Array) -> Iterator[list[tuple[int, int, str]]]:
    """The sorted spans of each text of a column."""
    automaton = _automaton()
    order = {kind: i for i, kind in enumerate(KINDS)}
    for lo, hi, data, offsets in slices(column):
        hexes = _hex_spans(data, offsets)
        for i, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
            found = (keyword_spans(text, automaton) if text else []) + hexes.get(i, [])
            yield sorted(found, key=lambda x: (x[0], order[x[2]]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = list(spans_in(batch.column(1)))
        base = [[x for x in found if x[2] in BASE_KINDS] for found in every]
        counts = [[sum(x[2] == kind for x in found) for found in base] for kind in BASE_KINDS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string()), pa.array([_joined(x) for x in every], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans ("kind:start:end", comma-joined)."""
    bounded_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    return texts.mapInArrow(_scan_rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal stretch of spans replaced by the kind of its first one in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its columns, secrets in the text replaced by their kind; null texts stay null."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [text if not found else redacted_text(text, found) for text, found in zip(texts, spans_in(batch.column(at)), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(rows, docs.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
