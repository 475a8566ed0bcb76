"""Blocks of long texts that share a key and little else, and the signatures' distance."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattfold.llm import minhash
from wattfold.llm.minhash import _blocks, _by_differences, _near, _within_distance, near_duplicates

PERCENT = 80


def members(seed, n=70, own=300):
    """Sets that share little with the first, in families of near copies."""
    rng = np.random.default_rng(seed)
    first = set(rng.integers(0, 1 << 60, 50).tolist())
    sets = []
    for i in range(n):
        if i % 7 or not sets:
            s = set(rng.integers(0, 1 << 60, own).tolist()) | set(list(first)[:5])
        else:
            s = set(list(sets[-3])[int(rng.integers(0, 60)) :]) | {i}
        sets.append(s)
    return first, sets


def linked(s, t):
    return 100 * len(s & t) >= PERCENT * len(s | t)


def connected(pairs):
    group = {}
    for a, b in pairs:
        merged = group.get(a, {a}) | group.get(b, {b})
        for m in merged:
            group[m] = merged
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("entries", [(2000, 5000), (500, 700), (1 << 20, 1 << 22)])
def test_long_differences_are_cut_into_more_blocks(spark, monkeypatch, entries):
    monkeypatch.setattr(minhash, "APART_ENTRIES", entries[0])
    monkeypatch.setattr(minhash, "OTHERS_ENTRIES", entries[1])
    first, sets = members(3)
    rows = [
        (i + 1, 0, linked(s, first), len(first), len(first - s), len(s - first), sorted(s ^ first))
        for i, s in enumerate(sets)
    ]
    stars = spark.createDataFrame(rows, minhash.CONFIRMED)
    want = {(i + 1, j + 1) for i, s in enumerate(sets) for j in range(i) if linked(s, sets[j])}
    assert len(want) > 5
    got = [tuple(r) for r in _by_differences(stars, PERCENT).collect()]
    assert {(max(p), min(p)) for p in got} <= want
    assert connected(got) == connected(want)
    size = F.sum(F.size("differences")).alias("n")
    blocks = _blocks(stars).groupBy("b", "x", "y", "apart").agg(size).collect()
    longest = max(len(r[6]) for r in rows)
    for r in blocks:
        # Members are dealt by hash: so many a block on average, and some more in a few.
        mean = (entries[0] if r.apart else entries[1]) / longest
        assert r.n <= (mean + 4 * mean**0.5 + 4) * longest
    for apart, bound in ((True, entries[0]), (False, entries[1])):
        kind = [r for r in blocks if r.apart is apart]
        cuts = max(r.x if apart else r.y for r in kind) + 1
        total = sum(len(r[6]) for r in rows if not (apart and r[2]))
        assert cuts >= 0.7 * total / bound  # the last ones may be empty
    assert (len(blocks) > 2) == (entries[0] < 1 << 20)


def test_distance_of_signatures(spark):
    k = minhash.CHUNKS * minhash.CHUNK
    base = np.arange(k, dtype=np.uint16)
    rows = []
    for differing in range(0, k + 1, 2):
        other = base.copy()
        other[:differing] += 100
        rows.append((differing, base.tobytes(), other.tobytes()))
    a, x, y = zip(*rows, strict=True)
    columns = [pa.array(a), pa.array(a), pa.array([False] * len(a)), pa.array(x), pa.array(y)]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "large", "x", "y"])
    kept = [r for out in _near([batch, batch.slice(0, 0)]) for r in out["a"].to_pylist()]
    assert kept == [d for d in a if d <= minhash.FAR]
    classes = spark.createDataFrame([(i, s) for i, s in enumerate((x[0], y[-1]))], "rep bigint, signature binary")
    pairs = spark.createDataFrame([(0, 1, False), (1, 0, True), (0, 0, False)], "a bigint, b bigint, large boolean")
    assert {tuple(r) for r in _within_distance(pairs, classes).collect()} == {(1, 0, True), (0, 0, False)}


def test_the_distance_loses_no_link(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    monkeypatch.setattr(minhash, "_within_distance", lambda pairs, classes: pairs)
    assert got == sorted(tuple(r) for r in near_duplicates(docs).collect())
