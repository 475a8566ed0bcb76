"""Induction over alphabets of any size, and its time."""

import time

import numpy as np
import pytest

from wattfold.llm import suffix_array as module
from wattfold.llm.suffix_array import _induce, _induce_by_one, _types, suffix_array


def by_sorting(s):
    t = s.tolist()
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("k", [2, 3, 40, 500])
def test_both_inductions_agree(k):
    rng = np.random.default_rng(k)
    for n in (2, 3, 10, 200):
        s = rng.integers(0, k, n)
        smaller = _types(s)
        lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
        assert np.array_equal(_induce(s, smaller, lms, k), _induce_by_one(s, smaller, lms, k))


@pytest.mark.parametrize("bucket", [1, 10**9])
def test_recursion_on_many_names(monkeypatch, bucket):
    """Strings whose names repeat, so that the string of names is sorted, level after level."""
    calls = []
    own = suffix_array

    def counted(s, k):
        calls.append((len(s), k))
        return own(s, k)

    monkeypatch.setattr(module, "suffix_array", counted)
    monkeypatch.setattr(module, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    part = rng.integers(0, 200, 700)
    s = np.concatenate([part, rng.integers(0, 200, 50), part, part[:300]])
    assert counted(s, 200).tolist() == by_sorting(s)
    assert len(calls) > 2 and max(k for _, k in calls) > 200
    assert all(2 * b[0] <= a[0] for a, b in zip(calls, calls[1:], strict=False))


def test_periods_and_linear_time():
    for s in (np.full(3000, 7), np.tile([1, 2], 2000), np.tile([3, 1, 2, 2], 900)):
        assert suffix_array(s, 8).tolist() == by_sorting(s)
    took = {}
    rng = np.random.default_rng(8)
    pool = [rng.integers(97, 123, rng.integers(2, 9)) for _ in range(3000)]
    for mb in (1, 4):
        text = np.concatenate([np.append(pool[i], 32) for i in rng.integers(0, 3000, mb * 180_000)])
        start = time.process_time()
        suffix_array(text, 256)
        took[mb] = (time.process_time() - start) / len(text)
    print("seconds a MB", {k: v * 1e6 for k, v in took.items()})
    assert took[4] < 2.5 * took[1]
    start = time.process_time()
    suffix_array(np.tile([97, 98], 1 << 19), 256)
    assert time.process_time() - start < 60
