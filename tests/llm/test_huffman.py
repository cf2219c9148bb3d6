import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm.huffman import Code, code_lengths, read_ids, write_ids
from lorekeep.llm.tokens import Encoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), Encoder(path)
    said = [t or "" for _, t in EDGE if _ != 7] + ["It's DON'T we'll 'S", "x  y\n\n z \t", "ÄÖÜ ß ı İ ſ", "a'stop,'s 'tis", "12 3.4 ¼²", "soft­hyphen", "é é", "日本"]
    assert [own.ids(t) for t in said] == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in said]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library_for_every_character(name):
    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), Encoder(path)
    draw = random.Random(7)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    said = [f"a{c}b {c}{c} x{c}1 {c}'s" for c in every]
    said += ["".join(draw.choices(every[:0x250] + list("  abc's.1\n"), k=draw.randrange(1, 40))) for _ in range(10_000)]
    for at in range(0, len(said), 4096):
        part = said[at : at + 4096]
        wrong = [t for t, ids in zip(part, whole.encode_batch(part, add_special_tokens=False), strict=True) if own.ids(t) != np.array(ids.ids, "<u4").tobytes()]
        assert not wrong, wrong[:5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=700), st.integers(6, 12), st.integers(1, 200))
def test_round_trip(ids, limit, interval):
    ids = np.array(ids, dtype=np.int64)
    lengths = code_lengths(np.bincount(ids, minlength=1), limit)
    assert lengths.max() <= limit
    code = Code(lengths)
    assert (code.decode(code.encode(ids, interval)) == ids).all()


def test_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0, 21])
    assert code_lengths(counts, 20).tolist() == [7, 7, 6, 5, 4, 3, 2, 0, 1]
    limited = code_lengths(counts, 4)
    assert limited.max() == 4 and sum(2.0 ** -int(x) for x in limited if x) == 1
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, int), 3)
    with pytest.raises(ValueError):
        Code(limited).decode(b"nothing like a block of ids....")


@pytest.mark.parametrize("block_tokens", [1 << 18, 40], ids=["one-block", "small-blocks"])
def test_file(spark, texts, tmp_path, block_tokens):
    rows = [(d, t) for d, t in EDGE if d != 7] + [(7, "ab " * 3000)]
    write_ids(texts(rows), str(tmp_path / "f"), block_tokens=block_tokens)
    whole, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    made = {r.doc_id: r for r in read_ids(spark, str(tmp_path / "f")).collect()}
    for d, t in sorted(rows):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (made[d].start, made[d].n_tokens, made[d].ids_crc32, bytes(made[d].ids)) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    # in ascending order of ids, block by block
    firsts = [r.docs for r in spark.read.parquet(str(tmp_path / "f/blocks")).orderBy("first_doc").collect()]
    assert sum(firsts, []) == sorted(d for d, _ in rows)


def test_empty_table(spark, texts, tmp_path):
    write_ids(texts([]), str(tmp_path / "e"))
    assert read_ids(spark, str(tmp_path / "e")).count() == 0
