"""Fingerprints of documents by order MinHash, sensitive to the order of passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.llm.common import stored

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint, hex digits of each.
K, TUPLE, SKETCHES, DIGITS = 6, 2, 32, 8
#: The low bits of a sort key hold a place within a window of k-mers; hashes have the rest.
PLACE_BITS = 24
PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: K-mers that are hashed at once.
WINDOW = 1 << 14
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Code points of documents that are taken together, and of the documents' number.
SLAB_CHARS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permutations(n: int) -> np.ndarray:
    """A random odd factor for each sketch: ``hash * factor`` orders k-mers anew."""
    return np.random.default_rng(20240901).integers(0, 1 << 63, n, np.uint64) * np.uint64(
        2
    ) + np.uint64(1)


FACTORS = permutations(SKETCHES)


def kmers(points: np.ndarray) -> np.ndarray:
    """Hash of the ``K`` code points from each place on."""
    h = np.zeros(max(len(points) - K + 1, 0), np.uint64)
    for i in range(K if len(h) else 0):
        h *= ODD
        h += points[i : i + len(h)]
    return _mixed(h)


def numbered(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers with the number of their occurrence in their document.

    Documents lie one after the other, so of equal hashes those of a document are together.
    """
    if len(h) <= 1 << PLACE_BITS:
        # The sorted key holds the place, so no permutation has to be sorted beside it.
        key = np.sort((h & ~PLACE) | np.arange(len(h), dtype=np.uint64))
        order, own = (key & PLACE).astype(np.int64), key & ~PLACE
    else:
        own = h & ~PLACE
        order = np.argsort(own, kind="stable")
        own = own[order]
    of = doc[order]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (of[1:] != of[:-1])))
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    again = np.flatnonzero(nth)
    out, at = h.copy(), order[again]
    out[at] = _mixed(h[at] + nth[again].astype(np.uint64) * ODD)
    return out


def _least(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of each segment, the ``TUPLE`` least keys of each permutation.

    A key is the high bits of a permuted hash over the place in the window. Where a segment
    has fewer k-mers, ``NONE`` stands.
    """
    out = np.empty((TUPLE, SKETCHES, len(begins)), np.uint64)
    place, key = np.arange(len(x), dtype=np.uint64), np.empty_like(x)
    for s, factor in enumerate(FACTORS):
        np.multiply(x, factor, out=key)
        key &= ~PLACE
        key |= place
        for nth in range(TUPLE):
            least = np.minimum.reduceat(key, begins, out=out[nth, s])
            key[(least[least != NONE] & PLACE).astype(np.int64)] = NONE
    return out


def _sketches(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes of the selected k-mers, put back into the order of the text."""
    h = np.zeros(keys.shape[1:], np.uint64)
    for place in np.sort(np.where(keys == NONE, NONE, keys & PLACE), axis=0):
        there = place != NONE
        own = np.where(there, x[np.where(there, place, 0).astype(np.int64)], np.uint64(0))
        h = _mixed((h + own + np.uint64(1)) * ODD)
    return (h >> np.uint64(32)).astype(np.uint32).T


def _window(texts: list[str]) -> np.ndarray:
    """Sketches of texts that have fewer code points together than a window has places."""
    lengths = np.array([max(len(t), K) for t in texts])
    points = np.frombuffer("".join(t.ljust(K, "\0") for t in texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum(lengths)
    inside = np.ones(len(points), bool)
    for i in range(1, K):
        inside[ends - i] = False
    h = kmers(points)[inside[: len(points) - K + 1]]
    doc = np.repeat(np.arange(len(texts)), lengths - K + 1)
    begins = ends - lengths - np.arange(len(texts)) * (K - 1)
    for i, text in enumerate(texts):
        if len(text) < K:  # what fills it up is not the text's
            h[begins[i]] += np.uint64(K - len(text))
    x = numbered(h, doc)
    return _sketches(_least(x, begins), x)


def _long(text: str) -> np.ndarray:
    """Sketches of a text of any length: the least keys of its windows, merged."""
    h = kmers(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    x = numbered(h, np.zeros(len(h), np.int8))
    least = []
    for a in range(0, len(x), WINDOW):
        keys = _least(x[a : a + WINDOW], np.zeros(1, np.int64))[:, :, 0].T
        least.append([[(int(k) >> PLACE_BITS, a + int(k & PLACE)) for k in own if k != NONE] for own in keys])
    best = [sorted(sum(own, []))[:TUPLE] for own in zip(*least, strict=True)]
    places = np.array([[p for _, p in own] for own in best], np.int64).T
    own = x[np.sort(places, axis=0)].ravel()
    keys = np.arange(len(own), dtype=np.uint64).reshape(TUPLE, SKETCHES, 1)
    return _sketches(keys, own)[0]


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of sketches for each text: equal texts have equal rows.

    A sketch orders the numbered k-mers by its own permutation, takes the ``TUPLE`` least,
    puts them back into the order of the text and hashes them.
    """
    out = np.empty((len(texts), SKETCHES), np.uint32)
    out[:] = _sketches(np.full((TUPLE, SKETCHES, 1), NONE), np.zeros(1, np.uint64))
    rows: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) >= WINDOW + K:
            out[i] = _long(text)
        elif text:
            if size + len(text) > WINDOW:
                out[rows] = _window([texts[r] for r in rows])
                rows, size = [], 0
            rows.append(i)
            size += max(len(text), K)
    if rows:
        out[rows] = _window([texts[r] for r in rows])
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first ones of another text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def hex_text(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal sketches, row by row."""
    return (a == b).mean(axis=-1)


RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
#: ``end`` tells a partition's first row, and its last one, which waits for the next
#: partition's first; both carry their text.
PASSED = f"{RESULT}, part int, end string, text string"


def _finished(ids: list, texts: list[str], following: list[str], end: list[str], part: int):
    """Result rows of texts and those that follow them; no result for a partition's end."""
    own = fingerprints([*texts, following[-1]])
    nexts = own[1:]
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = fingerprints(changed)
    n = len(texts)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
        pa.array(list(map(hex_text, own[:n]))),
        pa.array(list(map(hex_text, new))),
        pa.array(likeness(own[:n], new)),
        pa.array(likeness(own[:n], nexts)),
        pa.array([part] * n, pa.int32()),
        pa.array(end),
        pa.array([None if not e else t for e, t in zip(end, texts, strict=True)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PASSED.split(", ")])


def _ends(ids: list, texts: list[str], end: str, part: int) -> pa.RecordBatch:
    row = dict.fromkeys(c.split()[0] for c in PASSED.split(", "))
    rows = [row | {"doc_id": ids[0], "text": texts[0], "end": end, "part": part}]
    return pa.RecordBatch.from_pylist(rows, _arrow_schema())


def _arrow_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PASSED.split(", ")])


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with the one after it."""
    part = TaskContext.get().partitionId()
    ids, texts, size, begun = [], [], 0, False
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py()
            if not begun:
                begun = True
                yield _ends([doc_id], [text], "first", part)
            if size >= SLAB_CHARS:
                yield _finished(ids, texts, [*texts[1:], text], [""] * len(ids), part)
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if len(ids) > 1:
        yield _finished(ids[:-1], texts[:-1], texts[1:], [""] * (len(ids) - 1), part)
    if ids:
        yield _ends(ids[-1:], texts[-1:], "last", part)


def _join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            out = _finished([row["doc_id"]], [row["text"]], [row["following"]], [""], 0)
            yield out.select([c.split()[0] for c in RESULT.split(", ")])


def order_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` for each row.

    A text's k-mers of ``K`` code points are numbered by their occurrence, so that repeats
    count. Each of the ``SKETCHES`` permutations selects the ``TUPLE`` least of them; in
    the order of the text they are hashed to one sketch. Likeness is the share of equal
    sketches: moving a passage changes tuples though it leaves the set of k-mers alone.

    The document after a row is the one with the next smaller doc_id, and after the last
    the first. Rows are dealt by ranges of doc_id and sorted within a range, so each meets
    the next one in passing; the last of a range meets the first of the next range in a
    second, small pass with two rows per range. Only the numbers of the ranges that hold
    rows reach the driver. Rows that share a doc_id follow each other by the hash of their
    text and, if alike, by where they were read, so many rows of one id split over ranges.

    A null text is empty and has the fingerprint of no k-mer; null ids come last. A single
    row is followed by itself. Texts below ``K`` code points are one k-mer. Long texts go
    through windows of k-mers. An empty table gives no rows; other columns play no role.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("read", F.monotonically_increasing_id())
    by = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("read")]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    passed = stored(rows.mapInArrow(_pass, PASSED))
    lasts = passed.where("end = 'last'").select("doc_id", "text", "part")
    firsts = passed.where("end = 'first'").select(F.col("text").alias("following"), "part")
    parts = sorted(r["part"] for r in lasts.select("part").collect())
    after = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    pairs = docs.sparkSession.createDataFrame(list(after.items()), "part int, after int")
    firsts = firsts.withColumnRenamed("part", "after")
    ends = lasts.join(pairs, "part").join(firsts, "after").select("doc_id", "text", "following")
    names = [c.split()[0] for c in RESULT.split(", ")]
    done = passed.where("end = ''").select(*names)
    return done.unionByName(ends.mapInArrow(_join_ends, RESULT))
