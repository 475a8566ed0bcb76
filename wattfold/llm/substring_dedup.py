"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.llm.common import slabs, stored
from wattfold.llm.suffix_array import common_prefixes, suffix_array

#: Bytes of a string that must repeat.
LENGTH = 100
#: Bytes of an anchor. Each string of LENGTH bytes holds LENGTH - ANCHOR + 1 of them, and
#: the one with the least hash decides in which shard the string is sorted.
ANCHOR = 24
#: Bytes that one suffix array holds.
SHARD_BYTES = 3 << 20
#: Fragments with one longer anchor that may lie in one shard. Strings of an anchor with
#: more are grouped by their digest instead, which splits over tasks.
ANCHOR_FRAGMENTS = 20_000
TAG = (1 << 18) - 1
FRAGMENTS = "anchor bigint, content bigint, doc_id bigint, place bigint"


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random bytes' weights, powers of an odd base, and of its inverse, modulo 2 ** 64."""
    rng = np.random.default_rng(20240401)
    weight = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, base, np.uint64), out=up[1:])
    np.cumprod(np.full(n, inverse, np.uint64), out=down[1:])
    return weight, up, down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def text_tag(text: bytes) -> int:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=3).digest(), "big") & TAG


def _fragments(data: np.ndarray, ends: np.ndarray, length: int, anchor: int):
    """Runs of strings that share an anchor: first start, number of starts, place of the
    anchor, its hash and that of the content.

    ``data`` holds documents one after the other; ``ends`` is where they end. Strings that
    are equal have their anchor at the same offset, the leftmost of the least hash.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    weight, up, down = _powers(1 << max(20, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(weight[data] * up[:n], out=sums[1:])
    grams = n - anchor + 1
    value = _mixed((sums[anchor:] - sums[:-anchor]) * down[:grams])
    where = np.arange(grams, dtype=np.int32)
    width, window = 1, length - anchor + 1
    while width < window:
        step = min(width, window - width)
        later = value[step:] < value[:-step]
        value = np.where(later, value[step:], value[:-step])
        where = np.where(later, where[step:], where[:-step])
        width += step
    starts = n - length + 1
    whole = np.ones(starts, bool)  # False where a string crosses the end of a document
    for e in ends[:-1]:
        whole[max(0, e - length + 1) : e] = False
    fresh = np.append(True, where[1:] != where[:-1])
    fresh |= whole & np.append(True, ~whole[:-1])
    fresh |= ~whole
    first = np.flatnonzero(fresh)
    run = np.diff(np.append(first, starts))
    kept = whole[first]
    first, run = first[kept], run[kept]
    content = _mixed(
        (sums[first + run + length - 1] - sums[first]) * down[first] + run.astype(np.uint64)
    )
    return first, run, where[first], value[first], content


def fragments(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """A row per fragment; ``place`` packs first start, number of starts, the anchor's
    distance and the text tag.

    A fragment without its tail of ``length - 1`` bytes is the strings' starts. Those of
    a document don't overlap.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, own in slabs(batches, max_rows=64, max_bytes=1 << 18):
            raw = [text.encode() for text in own]
            ends = np.cumsum([len(x) for x in raw])
            begins = ends - [len(x) for x in raw]
            data = np.frombuffer(b"".join(raw), np.uint8)
            first, run, where, least, content = _fragments(data, ends, length, anchor)
            doc = np.searchsorted(ends, first, side="right")
            tags = np.array([text_tag(x) for x in raw], np.int64)
            place = (first - begins[doc]) << 32 | run << 25 | (where - first) << 18 | tags[doc]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least.view(np.int64)),
                    pa.array(content.view(np.int64)),
                    doc_ids.take(pa.array(doc)),
                    pa.array(place),
                ],
                ["anchor", "content", "doc_id", "place"],
            )

    return texts.mapInArrow(cut, FRAGMENTS)


def _start(place):
    return F.shiftright(place, 32)


def _run(place):
    return F.shiftright(place, 25).bitwiseAND(F.lit(127))


def _tag(place):
    return place.bitwiseAND(F.lit(TAG))


def _halves(place: int, length: int, anchor: int) -> Iterator[tuple[int, int, int, int]]:
    """A fragment's strings with half of the rest or more before the anchor, and the others.

    Strings of either kind share more than the anchor: gives starts, and the bytes, all
    counted from the fragment's start, that each string of the kind holds.
    """
    run, at = place >> 25 & 127, place >> 18 & 127
    half = (length - anchor) // 2
    middle = min(max(at - half + 1, 0), run)
    if middle > 0:
        yield 0, middle, at - half, at + anchor
    if middle < run:
        yield middle, run, at, at + length - half + 1


def _bytes_of(texts: DataFrame, wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes of halves of fragments, cut out of their documents, by a longer anchor."""
    by_doc = wanted.groupBy("doc_id", _tag(F.col("place")).alias("tag")).agg(
        F.collect_list("place").alias("wanted")
    )
    rows = texts.join(by_doc, "doc_id").select("doc_id", "text", "tag", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, ids, starts, tags, data = [], [], [], [], []
            for doc_id, text, tag, own in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                raw = text.encode()
                if text_tag(raw) != tag:
                    continue
                for place in own:
                    start = place >> 32
                    for a, b, x, y in _halves(place, length, anchor):
                        shared = raw[start + x : start + y]
                        digest = hashlib.blake2b(shared, digest_size=8).digest()
                        anchors.append(int.from_bytes(digest, "big", signed=True))
                        ids.append(doc_id)
                        starts.append(start + a)
                        tags.append(tag)
                        data.append(raw[start + a : start + b + length - 1])
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(x, pa.int64()) for x in (anchors, ids, starts, tags)),
                    pa.array(data, pa.binary()),
                ],
                ["anchor", "doc_id", "start", "tag", "bytes"],
            )

    schema = "anchor bigint, doc_id bigint, start bigint, tag bigint, bytes binary"
    return rows.mapInArrow(cut, schema)


def repeated_starts(
    ids: np.ndarray, starts: np.ndarray, tags: np.ndarray, data: list[bytes], length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Fragments, and offsets in them, whose string occurs in an earlier fragment.

    One suffix array of all fragments, each followed by an end that equals no symbol.
    Neighbours that share ``length`` symbols hold the same string, and of those the one
    with the least document and start is kept. Fragments alike in document, start and tag
    are of repeated rows and count as one.
    """
    sizes = np.array([len(x) + 1 for x in data])
    symbols = np.frombuffer(b"".join(x + b"\0" for x in data), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes)
    symbols[ends - 1] = 0
    order = np.lexsort((tags, starts, ids))
    fresh = np.ones(len(data), bool)
    fresh[1:] = np.any([np.diff(x[order]) != 0 for x in (ids, starts, tags)], axis=0)
    rank = np.empty(len(data), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    fragment = np.repeat(np.arange(len(data)), sizes)
    offset = np.arange(len(symbols)) - (ends - sizes)[fragment]
    sa = suffix_array(symbols, 257)
    fresh = common_prefixes(symbols, sa) < length
    key = (rank[fragment] << 16 | offset)[sa]
    group = np.flatnonzero(fresh)
    least = np.minimum.reduceat(key, group)
    later = sa[key > np.repeat(least, np.diff(np.append(group, len(sa))))]
    later.sort()
    return fragment[later], offset[later]


def _sorted_spans(length: int, shard_bytes: int):
    """Spans of repeats from rows sorted by anchor, an array per shard of whole anchors."""

    def spans(rows):
        ids, starts, tags = (np.array(x) for x in rows[:3])
        fragment, offset = repeated_starts(ids, starts, tags, rows[3], length)
        fresh = np.append(True, (fragment[1:] != fragment[:-1]) | (offset[1:] != offset[:-1] + 1))
        last = np.append(fresh[1:], True)
        fresh, last = fresh[: len(fragment)], last[: len(fragment)]
        own, a, b = fragment[fresh], offset[fresh], offset[last] + length
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, (ids[own], tags[own], starts[own] + a, starts[own] + b))],
            ["doc_id", "tag", "a", "b"],
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last = ([], [], [], []), 0, None
        for batch in batches:
            for anchor, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= shard_bytes and anchor != last:
                    yield spans(rows)
                    rows, held = ([], [], [], []), 0
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
                held += len(row[3])
                last = anchor
        if held:
            yield spans(rows)

    return sort


SPANS = "doc_id bigint, tag bigint, a bigint, b bigint"


def repeat_spans(
    texts: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    shard_bytes: int = SHARD_BYTES,
    anchor_fragments: int = ANCHOR_FRAGMENTS,
) -> DataFrame:
    """Spans ``a`` to ``b`` of bytes covered by strings that also start earlier.

    Only anchors that occur twice can hold a repeat. Of fragments alike, the first is
    the only one that may keep anything, so all others are spans without further work.
    Different fragments of one anchor meet in a shard's suffix array.
    """
    one = fragments(texts, length, anchor)
    counts = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counts.where("n > 1").select("anchor"))
    hits = stored(fragments(texts, length, anchor).join(repeated, "anchor"))
    first = hits.groupBy("anchor", "content").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    first = stored(first.select("anchor", "content", "first.*", "n"))
    place = F.col("place")
    known = first.where("n > 1").select(
        "anchor", "content", F.struct("doc_id", "place").alias("first")
    )
    alike = (
        hits.join(known, ["anchor", "content"])
        .where(F.struct("doc_id", "place") != F.col("first"))
        .select(
            "doc_id",
            _tag(place).alias("tag"),
            _start(place).alias("a"),
            (_start(place) + _run(place) + (length - 1)).alias("b"),
        )
    )
    variants = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"))
    variants = stored(variants.where("variants > 1").select("anchor"))
    wanted = first.join(variants, "anchor").select("doc_id", "place")
    cut = stored(_bytes_of(texts, wanted, length, anchor))
    met = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    met = stored(met.where("n > 1"))
    cut = cut.join(met, "anchor")
    few = F.col("n") <= anchor_fragments
    shards = cut.where(few).drop("n").repartition("anchor").sortWithinPartitions("anchor")
    parts = [alike, shards.mapInArrow(_sorted_spans(length, shard_bytes), SPANS)]
    if not met.where(~few).isEmpty():
        parts.append(_digest_spans(cut.where(~few), length))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.union(part)
    return spans


def _digest_spans(cut: DataFrame, length: int) -> DataFrame:
    """The same spans by grouping each string's digest, for anchors with many fragments."""
    offsets = F.sequence(F.lit(0), F.octet_length("bytes") - length)
    string = F.substring("bytes", F.col("offset") + 1, F.lit(length))
    strings = cut.select(
        "doc_id", "tag", "start", "bytes", F.explode(offsets).alias("offset")
    ).select(
        "doc_id",
        "tag",
        (F.col("start") + F.col("offset")).alias("a"),
        F.unhex(F.sha2(string, 256)).alias("digest"),
    )
    strings = stored(strings)
    first = strings.groupBy("digest").agg(
        F.min(F.struct("doc_id", "a", "tag")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    first = stored(first.where("n > 1").select("digest", "first"))
    return (
        strings.join(first, "digest")
        .where(F.struct("doc_id", "a", "tag") != F.col("first"))
        .select("doc_id", "tag", "a", (F.col("a") + length).alias("b"))
    )


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, as_text: bool = False, **shards: int
) -> DataFrame:
    """Each row of ``docs`` with ``kept``, ``n_bytes, n_removed, n_spans``.

    ``kept`` holds the bytes that are left or, ``as_text``, the characters left whole.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: at a
    smaller doc_id, or earlier in the same document. Strings are taken from the input, not
    from what is left, and never cross documents.

    A null text is empty; texts under ``length`` bytes stay whole. Rows without a doc_id
    have no place in the order and stay whole. Rows alike in doc_id and text are one
    document: each of them gets its result. Where rows of one doc_id have different texts,
    equal strings at the same start keep one of them. An empty table gives no rows. Other
    columns are passed on; names of the new columns win.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    texts = texts.where("doc_id IS NOT NULL")
    spans = repeat_spans(texts, length, **shards)
    spans = stored(
        spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spans")).alias("spans"))
    own = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    row = own.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"),
    )
    joined = row.join(by_doc, "doc_id", "left").select("text", "spans", "row")
    schema = T.StructType().add("kept", T.StringType() if as_text else T.BinaryType())
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema.add(name, T.LongType())
    schema.add("row", row.schema["row"].dataType)
    return joined.mapInArrow(_remove(as_text), schema).select(
        "row.*", "kept", "n_bytes", "n_removed", "n_spans"
    )


def _remove(as_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for text, by_tag in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.encode()
                found = []
                if by_tag.is_valid:
                    tag = text_tag(raw)
                    found = [x["spans"] for x in by_tag.as_py() if x["tag"] == tag]
                out, at, n = [], 0, 0
                for a, b in _merged(found[0] if found else []):
                    out.append(raw[at:a])
                    at, n = b, n + 1
                out.append(raw[at:])
                left = b"".join(out)
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(n)
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                    *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)),
                    batch.column(2),
                ],
                ["kept", "n_bytes", "n_removed", "n_spans", "row"],
            )

    return remove


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
