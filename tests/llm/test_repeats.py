import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import EDGE

from lorekeep.llm.repeats import RunLengthIndex, remove_repeats


def brute(rows, length):
    seen = Counter()
    coded = [(d, (t or "").encode()) for d, t in rows]
    for _, b in coded:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in coded:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, f in zip(b, gone, strict=True) if not f)
        out[d] = (len(b), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone))), hashlib.sha256(kept).hexdigest())
    return out


def found(frame, **parameters):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(frame, **parameters).collect()}


@pytest.mark.parametrize("parameters", [{}, {"hot": 1}, {"block_bytes": 500}], ids=["plain", "hot", "small-blocks"])
def test_equals_brute_force(texts, parameters):
    draw = random.Random(5)
    piece = lambda n: "".join(draw.choice("abcé") for _ in range(n))
    common, other = piece(90), piece(60)
    rows = [(i, piece(draw.randrange(60)) + draw.choice([common, other, other + common, common[:55], ""]) + piece(draw.randrange(60))) for i in range(60)]
    rows += [(100, "z" * 300), (101, "yx" * 70), (102, None), (103, ""), (104, rows[3][1]), (105, rows[3][1]), (106, "z" * 300)]
    assert found(texts(rows), length=50, anchor=20, **parameters) == brute(rows, 50)


def test_edges(texts, spark):
    rows = [(d, t) for d, t in EDGE if d != 7] + [(7, "ab" * 4000)]
    assert found(texts(rows)) == brute(rows, 200)
    assert remove_repeats(texts([])).count() == 0


def test_index_of_runs():
    strings = [b"banana", b"bandana", b"an", b"", b"banana"]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    index = RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), offsets)
    assert index.run_lengths.sum() == offsets[-1] + len(strings)
    assert ((index.run_symbols[1:] != index.run_symbols[:-1]) | (index.run_symbols[1:] == 0)).all()

    def longest(k, i):  # with any other position
        rest = strings[k][i:]
        best = 0
        for k2, s in enumerate(strings):
            for j in range(len(s)):
                if (k2, j) != (k, i):
                    n = 0
                    while n < len(rest) and j + n < len(s) and rest[n] == s[j + n]:
                        n += 1
                    best = max(best, n)
        return best

    assert index.matching_statistics().tolist() == [longest(k, i) for k, s in enumerate(strings) for i in range(len(s))]
