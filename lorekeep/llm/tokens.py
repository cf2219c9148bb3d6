"""Token ids of texts by a tokenizer file of the ``tokenizers`` library.

Encoding a text word by word gives the same ids as encoding it whole, once the
pieces are known, and most pieces come again; so the pieces' ids are remembered
in each worker and only new ones go to the library's model. This holds for
texts of Latin letters, digits and ASCII signs; any other text, and texts with
a special token's string, are encoded whole by the library.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Pieces remembered in one generation, about 200 bytes each; the older of two generations is dropped when the newer is full.
REMEMBERED = 500_000

_latin = [chr(c) for c in range(0x250)]
_LETTERS = re.escape("".join(c for c in _latin if unicodedata.category(c)[0] == "L"))
_DIGITS = re.escape("".join(c for c in _latin if unicodedata.category(c)[0] == "N"))
#: Texts with any other character are left to the library: a capital whose small form is no single letter of these, and all white space but three.
_UNKNOWN = re.compile("[^\t\n\r -~" + re.escape("".join(c for c in _latin[0xA1:] if c.lower() in _latin)) + "]|<\\|")
#: The patterns by which the two kinds of tokenizer files cut texts.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^\s{_LETTERS}{_DIGITS}]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """The printable character for each byte that byte-level models use: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _plain(text: str) -> bool:
    """Whether a text may be cut here; the quick test holds for most texts, the pattern decides the others."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            if text.replace("\n", "").isprintable():
                return True
    return not _UNKNOWN.search(text)


class _Remembered(dict):
    def __init__(self, model) -> None:
        self.model, self.older, self.letters = model, {}, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.pieces = _Remembered(self.whole.model)
        self.lower = "Lowercase" in str(self.whole.normalizer)
        self.cut = (_WORDS if self.lower else _PIECES).findall

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _plain(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(text.lower() if self.lower else text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, one in each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
