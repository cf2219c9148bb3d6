import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm.packing import LevelPacker, pack


def padding(length, size):
    return 0 if length & (length - 1) == 0 else size - length


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=120), st.integers(2, 40))
def test_packer_keeps_every_token(lengths, most_open):
    packer = LevelPacker(32, most_open)
    source = {d: np.arange(n, dtype="<u4").tobytes() for d, n in enumerate(lengths)}
    made = [s for d, ids in source.items() for s in packer.add((d, 0, ids, 0))] + list(packer.close())
    parts = defaultdict(dict)
    for pieces in made:
        total = sum(len(p[2]) // 4 for p in pieces)
        assert 0 < total <= 32 and not padding(total, 32)
        for d, start, ids, _ in pieces:
            assert ids and start not in parts[d]
            parts[d][start] = ids
    assert {d: b"".join(ids for _, ids in sorted(p.items())) for d, p in parts.items()} == source


def test_level_of_least_squares():
    packer = LevelPacker(8)
    packer.counts[:] = [0, 3, 0, 0, 1, 2, 0, 0, 0]
    squares = lambda counts: int((counts[1:8] ** 2).sum())
    for length in range(1, 8):
        costs = {}
        for level in range(0, 9 - length):
            after = packer.counts.copy()
            if level and not after[level]:
                continue
            after[level] -= level > 0
            after[level + length] += 1
            costs[level] = squares(after)
        assert costs[packer.level_for(length)] == min(costs.values())


@pytest.mark.parametrize("size", [1024, 16])
def test_pieces(texts, size):
    rows = [(d, t) for d, t in EDGE if d != 7] + [(7, "abc de " * 3000)]
    made = pack(texts(rows), size=size).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in made:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted(parts[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids
        assert all(r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length == len(r.ids) // 4 for r in mine)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and not padding(at, size)


def test_empty_table(texts):
    assert pack(texts([])).count() == 0
