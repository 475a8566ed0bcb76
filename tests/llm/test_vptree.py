"""Routing to shards: what it leaves out, and that it loses nothing at factor one."""

import numpy as np
import pytest

from tests.llm.test_others import VECTORS, by_brute_force
from wattfold.llm.vptree import Router, VantageTree, nearest_neighbours, reach


def clustered(n=6000, dim=16, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 4
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.3


def routed(x, queries, k, factor, regions, leaf=32):
    """The two rounds in this process: results, share of regions and of rows compared."""
    most = float((x * x).sum(axis=1).max())
    router = Router(x[:: max(1, len(x) // 2000)], most, regions)
    region = router.regions(router.of_rows(x))
    trees, bounds = {}, {}
    for r in np.unique(region):
        rows = np.flatnonzero(region == r)
        trees[r] = VantageTree(rows, x[rows], leaf=leaf, most=most)
        d = router.of_rows(x[rows])[:, router.paths[r]]
        bounds[r] = (d.min(axis=0), d.max(axis=0))
    points = x[queries]
    d = router.of_queries(points)
    home, gaps = router.regions(d), router.gaps(d, bounds)
    found = [[] for _ in queries]
    compared = visited = 0
    least = np.full(len(queries), -np.inf)
    for turn in range(2):
        far = reach((points * points).sum(axis=1), most, least, factor)
        for r, tree in trees.items():
            mine = np.flatnonzero(home == r if turn == 0 else (home != r) & (gaps[r] <= far))
            if len(mine):
                ids, scores = tree.search(queries[mine], points[mine], k, factor, least[mine])
                compared += tree.compared
                visited += len(mine)
                for q, i, s in zip(mine, ids, scores, strict=True):
                    found[q] += [(-b, a) for a, b in zip(i.tolist(), s.tolist(), strict=True) if b > -np.inf]
        if turn == 0:
            own = [sorted(f)[k - 1 : k] for f in found]
            least = np.array([-f[0][0] if f else -np.inf for f in own])
    found = [[i for _, i in sorted(f)[:k]] for f in found]
    return found, visited / len(queries) / len(trees), compared / len(queries) / len(x)


def exact(x, queries, k):
    scores = x[queries] @ x.T
    scores[np.arange(len(queries)), queries] = -np.inf
    return np.argsort(-scores, axis=1, kind="stable")[:, :k].tolist()


def test_clustered_vectors_meet_few_shards():
    x = clustered()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries = np.arange(0, len(x), 20)
    want = exact(x, queries, 20)
    got, regions, rows = routed(x, queries, 20, 1.0, 16)
    assert got == want
    print("clustered, factor 1: regions", regions, "rows", rows)
    assert regions < 0.5 and rows < 0.2
    got, regions_2, rows_2 = routed(x, queries, 20, 1.5, 16)
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, want, strict=True)])
    print("clustered, factor 1.5: regions", regions_2, "rows", rows_2, "recall", recall)
    assert recall >= 0.9 and rows_2 < rows and regions_2 <= regions


@pytest.mark.parametrize("factor", [1.0, 1.1])
def test_regions_of_different_norms(factor):
    rng = np.random.default_rng(9)
    x = clustered(2000, 8) * rng.uniform(0.2, 3, (2000, 1))
    queries = np.arange(0, 2000, 20)
    got, regions, rows = routed(x, queries, 10, factor, 8)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, exact(x, queries, 10), strict=True)])
    assert recall == 1.0 if factor == 1.0 else recall >= 0.9


def test_a_region_of_copies_is_split(spark):
    """Several regions, one of which holds more copies than a shard may have."""
    x = clustered(900, 6, 12).astype(np.float32)
    x[300:700] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + 20 * i, [1.0, float(i)]) for i in range(4)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    got = nearest_neighbours(df, lambda c: c % 20 == 0, shard_rows=60, query_rows=9).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == by_brute_force(rows, 20)
