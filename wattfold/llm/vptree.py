"""Nearest neighbours by inner product: routed to shards, over vantage-point trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.common import stored

#: Rows of a shard, which one tree holds; queries that travel as one row; rows of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 1024, 256
#: Vectors and components that the top-level tree is fitted on, and its regions at most.
SAMPLE_ROWS, SAMPLE_VALUES, MOST_REGIONS = 20_000, 4 << 20, 256
SHARD = "dim int, region int, split int, lows array<double>, highs array<double>, tree binary"
BLOCK = "dim int, region int, queries binary"


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Lifted:
    """Vectors with one more component, which brings all norms to that of the largest.

    A query's is zero. Then ``d(q, x)**2 = |q|**2 + most - 2 q.x``, so the largest inner
    product is the least distance and the triangle inequality holds.
    """

    def __init__(self, vectors: np.ndarray, most: float):
        self.vectors, self.most = vectors, most
        self.extra = np.sqrt(np.maximum(most - _squares(vectors), 0))

    def take(self, rows: np.ndarray) -> Lifted:
        own = object.__new__(Lifted)
        own.vectors, own.most, own.extra = self.vectors[rows], self.most, self.extra[rows]
        return own

    def among(self, other: Lifted) -> np.ndarray:
        """Distances between these and other lifted vectors."""
        products = self.vectors @ other.vectors.T + np.outer(self.extra, other.extra)
        return np.sqrt(np.maximum(self.most + other.most - 2 * products, 0))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        products = queries @ self.vectors.T
        return np.sqrt(np.maximum(_squares(queries)[:, None] + self.most - 2 * products, 0))


def _cut(points: Lifted, rows: np.ndarray):
    """A vantage point, its median distance, and who lies within; None if all lie alike."""
    # The row farthest from the first one sees the others at many distances.
    far = rows[np.argmax(points.take(rows[:1]).among(points.take(rows))[0])]
    d = points.take(np.array([far])).among(points.take(rows))[0]
    middle = float(np.median(d))
    inner = d <= middle
    if inner.all():
        inner = d < middle
    return None if inner.all() or not inner.any() else (far, middle, inner)


class Router:
    """The top-level tree, fitted on a sample: it deals all vectors to regions.

    Of a region, the least and the largest distance of its vectors to each vantage point
    above it bound how near it comes to a query.
    """

    def __init__(self, sample: np.ndarray, most: float, regions: int):
        points = Lifted(sample, most)
        self.vantages: list[int] = []
        self.nodes: list[tuple] = []  # vantage, middle, inner, outer; below zero a region
        self.paths: list[list[int]] = []  # of regions: numbers of the nodes above

        def build(rows: np.ndarray, regions: int, path: list[int]) -> int:
            cut = _cut(points, rows) if regions > 1 and len(rows) > 1 else None
            if cut is None:
                self.paths.append(path)
                return -len(self.paths)
            far, middle, inner = cut
            self.nodes.append(())
            n = len(self.nodes) - 1
            self.vantages.append(far)
            left = build(rows[inner], regions // 2, [*path, n])
            right = build(rows[~inner], regions - regions // 2, [*path, n])
            self.nodes[n] = (middle, left, right)
            return n

        self.root = build(np.arange(len(sample)), regions, [])
        self.points = points.take(np.array(self.vantages, np.int64))

    def regions(self, d: np.ndarray) -> np.ndarray:
        """The region of each row, by its distances to all vantage points."""
        out = np.zeros(len(d), np.int32)
        todo = [(self.root, np.arange(len(d)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                middle, left, right = self.nodes[node]
                inner = d[rows, node] <= middle
                todo += [(left, rows[inner]), (right, rows[~inner])]
        return out

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        return Lifted(vectors, self.points.most).among(self.points)

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        return self.points.of_queries(queries)

    def gaps(self, d: np.ndarray, bounds: dict[int, tuple]) -> dict[int, np.ndarray]:
        """How near each region can come to each query, by the triangle inequality."""
        out = {}
        for region, (lows, highs) in bounds.items():
            own = d[:, self.paths[region]]
            gap = np.maximum(own - np.array(highs), np.array(lows) - own)
            out[region] = gap.max(axis=1, initial=0.0)
        return out


class VantageTree:
    """A tree over the vectors of a shard; nearness is the inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, most=None):
        self.ids, self.vectors = ids, vectors
        own = float(_squares(vectors).max(initial=0.0))
        self.most = own if most is None else max(most, own)
        self.points = Lifted(vectors, self.most)
        self.leaf = leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        cut = _cut(self.points, rows) if len(rows) > self.leaf else None
        if cut is None:
            return rows  # few, or all at one distance, copies mostly
        far, middle, inner = cut
        return far, middle, self._build(rows[inner]), self._build(rows[~inner])

    def search(self, ids, queries: np.ndarray, k: int, factor: float, least=None):
        """The ``k`` nearest rows other than the query's own id: ids and inner products.

        A branch is left out if the triangle inequality shows that nothing in it is
        nearer than ``1 / factor`` of the distance of the k-th found so far, here or, by
        its score ``least``, elsewhere. Factor one leaves nothing nearer out; larger ones
        look at fewer branches.
        """
        search = _Search(self, ids, queries, k, factor, least)
        search.visit(self.root, np.arange(len(ids)))
        self.compared = search.compared
        return search.found_ids, search.found_scores


def reach(squares: np.ndarray, most: float, worst: np.ndarray, factor: float) -> np.ndarray:
    """Distance of the k-th found, a little more for the sake of rounding and ties."""
    scale = squares + most
    return np.sqrt(np.maximum(scale - 2 * worst, 0) + 1e-7 * scale) / factor


class _Search:
    def __init__(self, tree, ids, queries, k, factor, least):
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        self.squares = _squares(queries)
        self.found_ids = np.full((len(ids), k), -1, np.int64)
        self.found_scores = np.full((len(ids), k), -np.inf)
        self.least = np.full(len(ids), -np.inf) if least is None else least
        self.compared = 0

    def _worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.found_scores[q, -1], self.least[q])

    def visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if not isinstance(node, tuple):
            self._leaf(node, q)
            return
        vantage, middle, inner, outer = node
        d = self.tree.points.take(np.array([vantage])).of_queries(self.queries[q])[:, 0]
        near = d <= middle
        for own, first, second in ((near, inner, outer), (~near, outer, inner)):
            mine, gap = q[own], np.abs(d[own] - middle)
            self.visit(first, mine)
            far = reach(self.squares[mine], self.tree.most, self._worst(mine), self.factor)
            self.visit(second, mine[gap <= far])

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        ids, vectors = self.tree.ids[rows], self.tree.vectors[rows]
        self.compared += len(rows) * len(q)
        rough = self.queries[q] @ vectors.T
        slack = 1e-9 * (self.squares[q] + self.tree.most)
        bar = self._worst(q) - slack
        if len(rows) > self.k + 1:
            # One of the k + 1 best may be the query's own row.
            at = len(rows) - self.k - 1
            bar = np.maximum(bar, np.partition(rough, at, axis=1)[:, at] - slack)
        for i, j in zip(q, (rough >= bar[:, None]), strict=True):
            j = np.flatnonzero(j)
            j = j[ids[j] != self.ids[i]]
            if not len(j):
                continue
            # Products summed one after the other are the same wherever a vector lies.
            score = np.cumsum(vectors[j] * self.queries[i], axis=1)[:, -1]
            all_ids = np.concatenate([self.found_ids[i], ids[j]])
            scores = np.concatenate([self.found_scores[i], score])
            best = np.lexsort((all_ids, -scores))[: self.k]
            self.found_ids[i], self.found_scores[i] = all_ids[best], scores[best]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


FOUND = "query_id bigint, vec_id bigint, score double"


def _usable(vectors: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vector.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows.withColumn("dim", F.size("v"))


def fit_routers(rows: DataFrame, shard_rows: int) -> dict[int, Router]:
    """A router for each length of vectors, from a sample of bounded rows and values.

    A length that the sample misses, or that has one shard's rows, has a single region.
    """
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("most"))
    total, values = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("dim"))).first()
    share = min(1.0, SAMPLE_ROWS / max(total or 1, 1), SAMPLE_VALUES / max(values or 1, 1))
    unit = 1 << 40
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(unit)) < int(share * unit))

    def fit(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("vec_id")
        regions = min(-(-int(own["n"].iloc[0]) // shard_rows), MOST_REGIONS)
        router = Router(_matrix(own["v"]), float(own["most"].iloc[0]), regions)
        return pd.DataFrame({"dim": [key[0]], "router": [pickle.dumps(router)]})

    fitted = some.join(sizes, "dim").groupBy("dim").applyInPandas(fit, "dim int, router binary")
    return {r["dim"]: pickle.loads(r["router"]) for r in fitted.collect()}


def nearest_neighbours(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    factor: float = 1.0,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` rows of largest inner product.

    A top-level tree, fitted on a sample of at most ``SAMPLE_ROWS`` vectors, deals every row
    to one of at most ``MOST_REGIONS`` regions; a region of more than ``shard_rows`` is split
    over shards by the id's hash, and each shard has a tree. A query first searches its own
    region. With the k-th score found there it goes on only to the regions which its reach,
    divided by ``factor``, meets; in both rounds queries travel in blocks. The best k of all
    that the shards give stay. Factor one is exact.

    Scores are sums in double precision over the vectors as given; ties go to the smaller
    vec_id. A vector that is null, empty, zero, or holds a null or a component that isn't
    finite takes no part, nor does a row without vec_id. Rows that share a vec_id are one;
    the least vector counts. Vectors meet those of their own length only. With fewer than
    ``k`` candidates all are returned; an empty table gives no rows. Other columns play no
    role.
    """
    rows = stored(_usable(vectors))
    routers = fit_routers(rows, shard_rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, own in batch.groupby("dim"):
                router, region = routers.get(dim), np.zeros(len(own), np.int32)
                if router is not None and router.nodes:
                    points = _matrix(own["v"])
                    asked = own["asked"].to_numpy(bool)
                    d = np.where(asked[:, None], router.of_queries(points), router.of_rows(points))
                    region = router.regions(d)
                yield own.assign(region=region)

    placed = "vec_id bigint, v array<double>, dim int, asked boolean, region int"
    dealt = rows.withColumn("asked", F.lit(False)).mapInPandas(place, placed)
    sizes = stored(dealt.groupBy("dim", "region").agg(F.count("*").alias("n")))
    splits = F.ceil(F.col("n") / shard_rows).cast("int")
    dealt = dealt.join(sizes.select("dim", "region", splits.alias("splits")), ["dim", "region"])
    split = F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int").alias("split")

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        router, points = routers.get(key[0]), _matrix(own["v"])
        most = None if router is None else router.points.most
        tree = VantageTree(own["vec_id"].to_numpy(np.int64), points, most=most)
        path = [] if router is None else router.paths[key[1]]
        d = router.of_rows(points)[:, path] if path else np.zeros((1, 0))
        row = [*key, d.min(axis=0).tolist(), d.max(axis=0).tolist(), pickle.dumps(tree)]
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD.split(", ")])

    trees = dealt.select("dim", "region", split, "vec_id", "v")
    trees = stored(trees.groupBy("dim", "region", "split").applyInPandas(build, SHARD))
    bounds = trees.select(
        "dim", "region", F.posexplode_outer(F.arrays_zip("lows", "highs")).alias("at", "b")
    )
    bounds = bounds.groupBy("dim", "region", "at").agg(
        F.min("b.lows").alias("low"), F.max("b.highs").alias("high")
    )
    known: dict[int, dict[int, tuple]] = {}
    for r in sorted(bounds.collect(), key=lambda r: (r["dim"], r["region"], r["at"] or 0)):
        lows, highs = known.setdefault(r["dim"], {}).setdefault(r["region"], ([], []))
        if r["at"] is not None:
            lows.append(r["low"])
            highs.append(r["high"])

    asked = rows.where(is_query(F.col("vec_id"))).withColumn("asked", F.lit(True))
    asked = stored(asked.mapInPandas(place, placed))
    blocks = max(1, -(-asked.count() // query_rows))
    # Blocks take queries of one region by another hash than shards take rows.
    block = F.pmod(F.hash("vec_id"), F.lit(blocks))

    def pack(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        least = own["least"].to_numpy(np.float64) if "least" in own else None
        data = pickle.dumps((own["vec_id"].to_numpy(np.int64), _matrix(own["v"]), least))
        return pd.DataFrame({"dim": [key[0]], "region": [key[1]], "queries": [data]})

    def packed(own: DataFrame) -> DataFrame:
        return own.groupBy("dim", "region", block.alias("block")).applyInPandas(pack, BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, queries in zip(batch.column(0), batch.column(1), strict=True):
                tree = pickle.loads(data.as_py())
                ids, points, least = pickle.loads(queries.as_py())
                found, scores = tree.search(ids, points, k, factor, least)
                real = (scores > -np.inf).ravel()
                columns = (np.repeat(ids, k)[real], found.ravel()[real], scores.ravel()[real])
                names = [c.split()[0] for c in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names)

    def searched(blocks: DataFrame) -> DataFrame:
        """Blocks meet each shard of the region they go to, by the shard's own key."""
        shards = sizes.select("dim", "region", F.explode(F.sequence(F.lit(0), splits - 1)).alias("split"))
        own = blocks.join(shards, ["dim", "region"]).join(trees, ["dim", "region", "split"])
        return stored(own.select("tree", "queries").mapInArrow(search, FOUND))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks for the other regions which the queries' reach meets."""
        for batch in batches:
            for dim, home, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, points, least = pickle.loads(data)
                router, own = routers.get(dim), known.get(dim, {})
                if router is None or len(own) < 2:
                    continue
                far = reach(_squares(points), router.points.most, least, factor)
                for region, gap in router.gaps(router.of_queries(points), own).items():
                    mine = np.flatnonzero(gap <= far)
                    if region != home and len(mine):
                        data = pickle.dumps((ids[mine], points[mine], least[mine]))
                        columns = [pa.array([dim], pa.int32()), pa.array([region], pa.int32())]
                        yield pa.RecordBatch.from_arrays(
                            [*columns, pa.array([data], pa.binary())], ["dim", "region", "queries"]
                        )

    first = searched(packed(asked))
    worst = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
    worst = first.groupBy(F.col("query_id").alias("vec_id")).agg(worst.alias("least"))
    later = asked.join(worst, "vec_id", "left").fillna(float("-inf"), ["least"])
    second = searched(packed(later).mapInArrow(spread, BLOCK))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(second)
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
