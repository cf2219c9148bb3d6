import hashlib
import random
import re
from collections import Counter

import pytest
import regex
import xxhash
from cases import EDGE

from lorekeep.llm.fingerprints import fingerprints, op2_fingerprints

M = (1 << 64) - 1
P1, P2, P3, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5


def of_long(value, seed):
    return xxhash.xxh64((value & M).to_bytes(8, "little"), seed=seed).intdigest()


def of_int(value, seed):
    """XXH64 of four bytes."""
    h = (seed + P5 + 4) & M
    h ^= (value & 0xFFFFFFFF) * P1 & M
    h = ((h << 23 | h >> 41) & M) * P2 + P3 & M
    h = (h ^ h >> 33) * P2 & M
    h = (h ^ h >> 29) * P3 & M
    return h ^ h >> 32


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def signature(text, width=3, slots=64):
    apart = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ", text)
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", apart) if x]
    seen, least = Counter(), {}
    for i in range(max(len(w) - width + 1, min(1, len(w)))):
        kmer = 42
        for x in w[i : i + width]:
            kmer = xxhash.xxh64(x.encode(), seed=kmer).intdigest()
        seen[kmer] += 1
        h = of_int(seen[kmer], of_long(kmer, 42))
        family, packed = signed(h) % (2 * slots), signed(h >> 31 << 31 & M) | i
        least[family] = min(least.get(family, packed), packed)
    out = []
    for j in range(slots):
        a, b = least.get(2 * j), least.get(2 * j + 1)
        if a is None and b is None:
            out.append(None)
            continue
        parts = [(0, a), (1, b)]
        if not (b is None or a is not None and a & (1 << 31) - 1 < b & (1 << 31) - 1):
            parts.reverse()
        h = 42
        for side, x in parts:
            h = of_int(side, h)
            h = h if x is None else of_long((x & M) >> 31, h)
        out.append(h & 0xFFFFFFFF)
    return out


def likeness(a, b):
    filled = sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
    return sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / filled if filled else 1.0


def brute(rows):
    rows = sorted((d, t or "") for d, t in rows)
    signatures, out = [signature(t) for _, t in rows], {}
    text_of = lambda s: "".join("........" if x is None else f"{x:08x}" for x in s)
    for i, (d, t) in enumerate(rows):
        j, half = (i + 1) % len(rows), len(t) // 2
        edited = t[: len(t) - half] + rows[j][1][:half]
        s = signature(edited)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(signatures[i]), text_of(s), likeness(signatures[i], s), likeness(signatures[i], signatures[j]))
    return out


def found(frame, **parameters):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints(frame, **parameters).collect()}


ROWS = [*EDGE, *((20 + i, "the cat sat on the mat and the cat sat on the hat " * (i % 4 + 1) + f"end {i % 3}") for i in range(12))]


@pytest.mark.parametrize("rows", [ROWS, EDGE[:1], EDGE[4:5], []], ids=["all", "null", "one", "none"])
@pytest.mark.parametrize("size", [1 << 22, 200], ids=["one-bucket", "many-buckets"])
def test_equals_brute_force(texts, rows, size):
    assert found(texts(rows), partition_bytes=size) == brute(rows)


def test_order_matters(texts):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    made = found(texts([(1, " ".join(words)), (2, " ".join(turned)), (3, " ".join(words))]))
    assert made[1][2] == made[3][2]
    assert 0 < made[1][5] < 0.75  # the same words, in another order


def test_native(spark, data, capsys):
    fingerprints(spark.read.parquet(f"{data}/documents.parquet")).explain()
    assert "Python" not in (said := capsys.readouterr().out) and "Arrow" not in said


def densified(text, width=3, slots=64):
    """The signature by walking through the families, and how many slots order two k-mers."""
    apart = regex.sub(r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 ", text)
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", apart) if x]
    seen, least, n = Counter(), {}, 2 * slots
    for i in range(max(len(w) - width + 1, min(1, len(w)))):
        kmer = 42
        for x in w[i : i + width]:
            kmer = xxhash.xxh64(x.encode(), seed=kmer).intdigest()
        seen[kmer] += 1
        h = of_int(seen[kmer], of_long(kmer, 42))
        packed = signed(h >> 31 << 31 & M) | i
        least[signed(h) % n] = min(least.get(signed(h) % n, packed), packed)

    def lender(family, but):
        stride = (family * 0x9E3779B1 >> 7) % n | 1
        return next((g for t in range(n) if (g := (family + t * stride) % n) in least and g != but), None)

    out, two = [], 0
    for j in range(slots):
        f = lender(2 * j, None)
        if f is None:
            out.append(None)
            continue
        g = lender(2 * j + 1, f)
        parts = [(0, least[f]), (1, least.get(g))]
        two += g is not None
        if g is not None and (least[f] & (1 << 31) - 1) >= (least[g] & (1 << 31) - 1):
            parts.reverse()
        h = 42
        for side, x in parts:
            h = of_int(side, h)
            h = h if x is None else of_long((x & M) >> 31, h)
        out.append(h & 0xFFFFFFFF)
    return out, two


def test_densified_equals_brute_force(texts):
    made = found(texts(ROWS), densified=True)
    for d, text in ROWS:
        assert made[d][2] == "".join("........" if x is None else f"{x:08x}" for x in densified(text or "")[0]), d
        assert densified(text or "")[1] == 64 or len((text or "").split()) < 5


@pytest.mark.parametrize("size", [20, 60, 130])
def test_order_matters_in_short_texts(spark, tmp_path, size):
    rows = []
    for i in range(0, 40, 2):
        words = [f"w{i}x{j}" for j in range(size)]
        q = size // 4
        turned = words[3 * q :] + words[2 * q : 3 * q] + words[q : 2 * q] + words[:q]
        rows += [(i, " ".join(words)), (i + 1, " ".join(turned))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    near = [r.near_next for r in op2_fingerprints(spark, str(tmp_path)).collect() if r.doc_id % 2 == 0]
    # of two k-mers that both have, one pair in four at most is of one quarter
    assert 0 < sum(near) / len(near) < 0.3


def test_likeness_falls_with_edits_and_serves_unspaced_scripts(texts):
    draw = random.Random(4)
    words = [f"w{draw.randrange(10**6)}" for _ in range(600)]

    def edited(n):
        out = list(words)
        for i in draw.sample(range(len(out)), n):
            out[i] = f"x{i}"
        return " ".join(out)

    signs = "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(300))
    rows = [(0, " ".join(words)), (1, " ".join(words)), (10, " ".join(words)), (11, edited(6)), (20, " ".join(words)), (21, edited(60)), (30, " ".join(words)), (31, edited(300)), (40, signs), (41, signs + "\u3002")]
    near = {r.doc_id: r.near_next for r in fingerprints(texts(rows), densified=True).collect()}
    assert near[0] == 1.0 > near[10] > near[20] > near[30] and near[10] > 0.8 and near[30] < 0.2
    assert near[40] > 0.8
