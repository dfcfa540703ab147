"""The interval expansion begins where the sort's classes end."""

import numpy as np
import pytest

from lacuna.llm import fm_index, suffix_dedup


@pytest.mark.parametrize("length", [1, 2, 3, 17, 50, 64])
def test_classes_against_strings(length, monkeypatch):
    rng = np.random.default_rng(length)
    words = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(40)]
    pieces = [np.concatenate([words[k] for k in rng.integers(0, 40, 8)]) for _ in range(60)] + [np.full(200, 256)]
    text = np.concatenate([[0], *(np.append(p, 0) for p in pieces)]).astype(np.int64)
    levels, real = [], suffix_dedup.tb.ragged
    monkeypatch.setattr(suffix_dedup.tb, "ragged", lambda *a: (levels.append(1), real(*a))[1])
    classes = suffix_dedup.expand_intervals(text, length)
    assert len(levels) <= max(0, length - length // 2)  # before, a level for each symbol
    strings = [(k, text[k : k + length].tobytes()) for k in range(len(text) - length + 1) if 0 not in text[k : k + length]]
    assert len({s for _, s in strings}) == len({classes[k] for k, _ in strings}) == len({(s, classes[k]) for k, s in strings})


def test_ranks_of_packed_symbols():
    for high in (2, 300, 1 << 40):
        text = np.random.default_rng(high % 97).integers(0, high, 300)
        text[100:200] = text[:100]
        for depth in (1, 2, 4, 8, None):
            keys = [tuple(text[k : k + depth if depth else None].tolist()) for k in range(300)]
            place = {s: k for k, s in enumerate(sorted(set(keys)))}
            assert fm_index.suffix_ranks(text, depth).tolist() == [place[s] for s in keys]


def test_wide_keys_are_sorted_as_values(monkeypatch):
    rng = np.random.default_rng(8)
    for n, bits in ((1, 63), (5, 62), (3000, 40), (3000, 63), (70000, 50)):
        keys = rng.integers(0, 1 << bits, n, endpoint=False, dtype=np.int64)
        keys[rng.integers(0, n, n // 2)] = keys[0]
        order = np.argsort(keys, kind="stable")
        distinct, want = np.unique(keys, return_inverse=True)
        with monkeypatch.context() as patch:
            patch.setattr(fm_index.np, "argsort", None)
            got = fm_index.ordered_ranks(keys)
        assert got[0].tolist() == want.tolist() and got[1] == len(distinct) and got[2].tolist() == order.tolist()


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    rng = np.random.default_rng(4)
    text = rng.integers(0, 200, 4000)
    text[3000:3300] = text[100:400]
    sizes, real = [], fm_index._sorted
    monkeypatch.setattr(fm_index, "_sorted", lambda keys: (sizes.append(len(keys)), real(keys))[1])
    classes, order = fm_index.suffix_classes(text, 32)
    assert sizes[0] == 4000 and max(sizes[1:]) < 1000
    by = sorted(range(4000), key=lambda k: (tuple(text[k : k + 64].tolist()), k))
    assert order.tolist() == by
    first = {}
    for place, k in enumerate(by):
        first.setdefault(tuple(text[k : k + 32].tolist()), place)
    assert classes.tolist() == [first[tuple(text[k : k + 32].tolist())] for k in range(4000)]
