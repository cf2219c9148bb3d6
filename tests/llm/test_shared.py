"""Common prefixes of suffixes against a byte-wise comparison."""

import numpy as np

from lorekeep.llm.repeats import RunLengthIndex
from lorekeep.llm.textbytes import prefix_sums


def test_common_prefixes_equal_a_byte_wise_comparison():
    draw = np.random.default_rng(5)
    base = draw.integers(97, 99, 400).astype(np.uint8)
    other = base.copy()
    other[[63, 64, 200]] ^= 1
    parts = [base, base[:130], base[50:300], other, np.zeros(70, np.uint8), np.full(90, 255, np.uint8), base[:1], np.zeros(0, np.uint8), draw.integers(0, 256, 60).astype(np.uint8)]
    data, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    words = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    stop = np.repeat(offsets[1:], np.diff(offsets))
    a = np.concatenate([draw.integers(0, len(data), 3000), np.arange(400), [0, 0]])
    b = np.concatenate([draw.integers(0, len(data), 3000), np.arange(400) + offsets[3], [offsets[1], -1]])
    expected = []
    for x, y in zip(a, b, strict=True):
        one, two = data[x : stop[x]], data[y : stop[y]] if y >= 0 else data[:0]
        n = min(len(one), len(two))
        differ = np.flatnonzero(one[:n] != two[:n])
        expected.append(int(differ[0]) if len(differ) else n)
    assert RunLengthIndex._shared(words, prefix_sums(data), stop, a, b).tolist() == expected
    assert max(expected) > 130 and {63, 130} & set(expected)
