"""Ranked lexical search over an index of documents of equal length norm."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.llm.common import id_and_text, slabs, stored

#: Parts of a hundred of a document's length that enter its norm, and documents listed.
LENGTH_PART, LISTED = 75, 10
#: Documents and bytes of text of a shard of the index; items and bytes of a query block.
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
BLOCK_ITEMS, BLOCK_BYTES = 1024, 4 << 20
#: Strata visited at first; then twice as many each time.
FIRST_VISIT = 4

#: Terms are runs of ASCII letters and digits and of bytes above ASCII; A-Z lower-cased.
_TERM_BYTES = bytes(
    i | 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i > 127 else 32
    for i in range(256)
)

INDEX = (
    "shard bigint, n_docs bigint, n_terms bigint, ids array<bigint>, lengths array<bigint>, "
    "terms binary, df binary, postings binary"
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def build_index(docs: DataFrame) -> DataFrame:
    """A row per shard of documents: ids and lengths by ascending length, the shard's terms
    with their document frequencies, and postings (document's place, occurrences) by term
    and place.

    A document's norm grows with its length, so documents of one norm lie side by side
    whatever the averages are, which only the whole index tells.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in INDEX.split(", ")]
        for ids, texts in slabs(batches, SHARD_DOCS, SHARD_BYTES):
            shard += 1
            columns = _shard(ids, texts)
            if columns is not None:
                own = [pa.array([shard]), *columns]
                yield pa.RecordBatch.from_arrays(own, names)

    return id_and_text(docs).mapInArrow(build, INDEX)


def _shard(ids: pa.Array, texts: list[str]) -> list[pa.Array] | None:
    number: dict[bytes, int] = {}
    term, tf, sizes, lengths = [], [], [], []
    for text in texts:
        counts = Counter(terms_of(text))
        sizes.append(len(counts))
        lengths.append(sum(counts.values()))
        term += [number.setdefault(t, len(number)) for t in counts]
        tf += counts.values()
    if not number:
        return None
    lengths = np.array(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    place = np.zeros(len(texts), np.int64)
    place[order] = np.arange(len(order))
    term, place, tf = np.array(term), np.repeat(place, sizes), np.array(tf)
    by = np.lexsort((place, term))
    postings = np.stack([place[by], tf[by]]).astype("<u4")
    df = np.bincount(term, minlength=len(number)).astype("<u4")
    return [
        pa.array([len(order)], pa.int64()),
        pa.array([int(lengths.sum())], pa.int64()),
        pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
        pa.array([lengths[order]], pa.list_(pa.int64())),
        pa.array([b" ".join(number)], pa.binary()),
        pa.array([df.tobytes()], pa.binary()),
        pa.array([postings.tobytes()], pa.binary()),
    ]


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """``25 + 75 * n * N div L`` in whole numbers of any size, once per distinct length."""
    own, at = np.unique(lengths, return_inverse=True)
    m = [100 - LENGTH_PART + LENGTH_PART * n * n_docs // n_terms for n in own.tolist()]
    return np.array(m, np.int64)[at]


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Strata:
    """A shard's documents grouped by norm, with postings by stratum, term and occurrences."""

    def __init__(self, row: dict, vocabulary: pa.Array, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        m = norms(row["lengths"], n_docs, n_terms)
        begins = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        stratum = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(m))))
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        found = _found(row["terms"], vocabulary)
        mine = np.flatnonzero(found >= 0)
        size = df[found[mine]]
        flat = _ranges((np.cumsum(df) - df)[found[mine]], size)
        postings = np.frombuffer(row["postings"], "<u4").reshape(2, -1)
        place, tf = (x[flat].astype(np.int64) for x in postings)
        term, of = np.repeat(mine, size), stratum[place]
        order = np.lexsort((tf, of, term))
        term, of, tf, place = (x[order] for x in (term, of, tf, place))
        #: Places of documents, by term, stratum and occurrences.
        self.place = place
        # An impact is computed once for all postings of a term, stratum and tf.
        new = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
        runs = np.flatnonzero(np.append(True, new | (tf[1:] != tf[:-1]))[: len(tf)])
        once = impacts(tf[runs], m[begins][of[runs]])
        self.impact = np.repeat(once, np.diff(np.append(runs, len(tf))))
        # The last posting of a term in a stratum has the most occurrences, so its impact
        # bounds the others.
        shape = (len(vocabulary), len(begins))
        self.begin, self.size = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.most = np.zeros(shape, np.int64)
        cells = np.flatnonzero(np.append(True, new)[: len(tf)])
        sizes = np.diff(np.append(cells, len(tf)))
        at = term[cells], of[cells]
        self.begin[at], self.size[at] = cells, sizes
        self.most[at] = self.impact[cells + sizes - 1]

    def search(self, item: Item) -> None:
        """Strata from the highest bound on, until no bound reaches the item's tenth."""
        bounds = item.weight @ self.most[item.term]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        at, step = 0, FIRST_VISIT
        while at < len(order):
            own = order[at : at + step]
            own = own[bounds[own] >= item.least]
            if not len(own):
                return
            item.visited += len(own)
            self._visit(item, own)
            at, step = at + step, 2 * step

    def _visit(self, item: Item, strata: np.ndarray) -> None:
        cells = np.ix_(item.term, strata)
        size = self.size[cells]
        flat = _ranges(self.begin[cells].ravel(), size.ravel())
        score = np.repeat(item.weight, size.sum(axis=1)) * self.impact[flat]
        place, at = np.unique(self.place[flat], return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, at, score)
        good = np.flatnonzero((total >= item.least) & (total > 0))
        item.add([self.ids[i] for i in place[good].tolist()], total[good])


class Item:
    """An item's distinct terms, their weight times how often it holds them, and the best
    documents so far."""

    def __init__(self, item_id, term: np.ndarray, weights: np.ndarray, k: int):
        self.item_id, self.term, self.weight, self.k = item_id, term, weights, k
        self.best: list[tuple] = []
        self.least = self.visited = 0

    def add(self, ids: list, scores: np.ndarray) -> None:
        new = [(-s, i is None, i or 0) for i, s in zip(ids, scores.tolist(), strict=True)]
        self.best = sorted(self.best + new)[: self.k]
        if len(self.best) == self.k:
            self.least = -self.best[-1][0]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begins - (upto - sizes), sizes)


def _found(terms: bytes, vocabulary: pa.Array) -> np.ndarray:
    """Each vocabulary term's number in a shard, or -1."""
    own = pa.array(terms.split(b" "), pa.binary())
    return pc.fill_null(pc.index_in(vocabulary, value_set=own), -1).to_numpy()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, terms, times``: rows that share an item_id are one, the least text counts."""
    one = items.select(
        F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    one = one.groupBy("item_id").agg(F.min("text").alias("text"))
    schema = one.select("item_id").schema
    schema.add("terms", T.ArrayType(T.BinaryType())).add("times", T.ArrayType(T.LongType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                ["item_id", "terms", "times"],
            )

    return one.mapInArrow(count, schema)


def _frequencies(index: DataFrame, vocabulary: pa.Array) -> np.ndarray:
    """Documents that hold each term of a block of items, over the whole index."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, df in zip(*batch.columns, strict=True):
                found = _found(terms.as_py(), vocabulary)
                mine = found >= 0
                total[mine] += np.frombuffer(df.as_py(), "<u4")[found[mine]]
        own = np.flatnonzero(total)
        columns = [pa.array(own), pa.array(total[own])]
        yield pa.RecordBatch.from_arrays(columns, ["term", "df"])

    found = index.select("terms", "df").mapInArrow(look, "term bigint, df bigint")
    out = np.zeros(len(vocabulary), np.int64)
    for row in found.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = LISTED, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score of each item.

    The index covers every document. Items go to its shards in blocks of bounded size, so
    a task holds one block and one shard. In a shard an item visits strata, documents of
    one length norm, from the highest bound on and stops where none reaches its k-th score
    so far, which a task keeps from shard to shard; so no document that belongs into the
    result is left out. A task gives k rows an item, and the best k of those stay.

    Weights, impacts and scores are whole numbers but for the logarithm, in doubles. A
    score above zero is needed. Equal scores go by ascending doc_id, null ids last. Rows
    that share a doc_id are documents of their own; rows that share an item_id are one
    item. Null and empty texts hold no term: such a document isn't counted, such an item
    finds nothing. An empty table gives no rows; other columns play no role.
    """
    index = stored(build_index(docs))
    sums = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = (int(x or 0) for x in sums)
    asked = stored(item_terms(items))
    size = F.aggregate("terms", F.lit(0), lambda a, t: a + F.length(t) + 16)
    count, total = asked.agg(F.count("*"), F.sum(size)).first()
    blocks = max(1, -(-count // block_items), -(-(total or 0) // BLOCK_BYTES))
    of = F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks))
    kind = asked.schema["item_id"].dataType
    found = [
        _search_block(index, asked.where(of == b), n_docs, n_terms, k) for b in range(blocks)
    ]
    found = reduce(DataFrame.unionAll, found)
    found = found.withColumn("item_id", F.col("item_id").cast(kind))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _search_block(
    index: DataFrame, asked: DataFrame, n_docs: int, n_terms: int, k: int
) -> DataFrame:
    """The best documents of each task for a block of items, which is bounded in size."""
    rows = asked.collect()
    vocabulary = pa.array(sorted({bytes(t) for r in rows for t in r["terms"]}), pa.binary())
    number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    df = _frequencies(index, vocabulary) if n_docs else np.zeros(len(number), np.int64)
    own = []
    for r in rows:
        term = np.array([number[bytes(t)] for t in r["terms"]], np.int64)
        times = np.array(r["times"], np.int64)
        held = df[term] > 0
        w = np.array([weight(x, n_docs) for x in df[term[held]].tolist()], np.int64)
        own.append((r["item_id"], term[held], w * times[held]))
    schema = asked.select("item_id").schema
    schema.add("doc_id", T.LongType()).add("score", T.LongType())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Item(*item, k) for item in own]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("ids", "terms", "df", "postings")}
                row["lengths"] = batch["lengths"][i].values.to_numpy()
                strata = Strata(row, vocabulary, n_docs, n_terms)
                for item in held:
                    strata.search(item)
        best = [(item.item_id, *b) for item in held for b in item.best]
        if best:
            item_id, score, missing, doc_id = zip(*best, strict=True)
            ids = [None if no else i for i, no in zip(doc_id, missing, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item_id),
                    pa.array(ids, pa.int64()),
                    pa.array([-s for s in score], pa.int64()),
                ],
                ["item_id", "doc_id", "score"],
            )

    columns = ["ids", "lengths", "terms", "df", "postings"]
    return index.select(columns).mapInArrow(search, schema)
