"""Near-duplicates by min-wise signatures and a multi-index join on signature distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.llm.common import id_and_text, slabs, stored
from wattfold.llm.components import components

#: Words of a shingle, and percent of the union that a link needs in common.
WORDS, PERCENT = 2, 80
#: A signature has CHUNKS chunks of CHUNK components of 16 bits. Signatures that differ in
#: fewer than CHUNKS * (ERRORS + 1) components have a chunk with at most ERRORS
#: differences, so they share one of its keys, which leave ERRORS components out.
#: A component of a pair at the threshold differs with probability 0.2; then the chance
#: that no chunk is that close is (1 - 0.8**5 - 5 * 0.2 * 0.8**4) ** 10 = 1.6e-6.
CHUNKS, CHUNK, ERRORS = 10, 5, 1
#: Pairs whose signatures differ in more components aren't compared on full sets. A pair at
#: the threshold differs in more with probability 1.1e-7, a fifteenth of the chance above.
FAR = 26
#: Members of a bucket that are compared with each other as pairs. In larger ones they are
#: compared by their differences from the bucket's first member, in blocks of so many
#: members that aren't linked with it and of so many others.
SMALL = 16
APART, OTHERS, COLUMNS = 512, 4096, 2048
#: Differences of a block's members and of its others, on average over a bucket's blocks.
APART_ENTRIES, OTHERS_ENTRIES = 1 << 20, 1 << 22

_DROPPED = list(combinations(range(CHUNK), ERRORS))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, hashes: dict, width: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text.

    Words are lower-cased in A-Z and split at ASCII white space. Fewer words than a
    shingle are one shingle; no words, none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    own = min(width, len(h))
    out = h[: len(h) - own + 1]
    for i in range(1, own):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - own + 1 + i])
    return np.unique(_mixed(out + np.uint64(own)))


def _set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two hashes that equal sets share."""
    a = np.bitwise_xor.reduce(_mixed(shingles + np.uint64(11)), initial=np.uint64(0))
    b = np.add.reduce(_mixed(shingles + np.uint64(29)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(sets: list[np.ndarray]) -> list[bytes]:
    """For each set the lowest 16 bits of its least hash under each of many orders."""
    k = CHUNKS * CHUNK
    out = np.zeros((len(sets), k), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        begins = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        flat = np.concatenate([sets[i] for i in full])
        rng = np.random.default_rng(7)
        factors = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        for j, factor in enumerate(factors):
            x = flat * factor
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            least = np.minimum.reduceat(x, begins)
            out[full, j] = _mixed(least).astype(np.uint16)
    return [row.tobytes() for row in out]


def _sign(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for doc_ids, texts in slabs(batches, max_rows=1024, max_bytes=4 << 20):
            if len(hashes) > 300_000:
                hashes.clear()
            sets = [shingle_set(text, hashes, width) for text in texts]
            pairs = [_set_hashes(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in pairs], pa.int64()),
                    pa.array([b for _, b in pairs], pa.int64()),
                    pa.array(_signatures(sets), pa.binary()),
                ],
                ["doc_id", "n", "h1", "h2", "signature"],
            )

    return sign


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per chunk and choice of components left out; the key is the rest, exactly."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data = b"".join(batch.column(1).to_pylist())
        signature = np.frombuffer(data, np.uint16).reshape(n, CHUNKS, CHUNK).astype(np.int64)
        slots, keys = [], []
        for chunk in range(CHUNKS):
            for d, dropped in enumerate(_DROPPED):
                key = np.zeros(n, np.int64)
                for j in range(CHUNK):
                    if j not in dropped:
                        key = key << 16 | signature[:, chunk, j]
                slots.append(np.full(n, chunk * len(_DROPPED) + d, np.int16))
                keys.append(key)
        rep = np.tile(np.array(batch.column(0)), len(slots))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(slots)), pa.array(np.concatenate(keys)), pa.array(rep)],
            ["slot", "key", "rep"],
        )


def _set_rows(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            reps, data = [], []
            for rep, text, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(hashes) > 300_000:
                    hashes.clear()
                shingles = shingle_set(text, hashes, width)
                if _set_hashes(shingles) == (h1, h2):
                    reps.append(rep)
                    data.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array(data, pa.binary())], ["rep", "shingles"]
            )

    return rows


def _confirm(percent: int):
    """Whether sets ``x`` and ``y`` of pairs are linked, and how ``x`` differs from ``y``."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, size, lost, added, differences = [], [], [], [], []
            for far, x, y in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                twice = both[1:] == both[:-1]
                common = int(np.count_nonzero(twice))
                linked.append(100 * common >= percent * (len(both) - common))
                size.append(len(b))
                lost.append(len(b) - common)
                added.append(len(a) - common)
                once = ~(np.append(twice, False) | np.append(False, twice))
                differences.append(both[once].view(np.int64) if far.as_py() else None)
            columns = [
                pa.array(linked, pa.bool_()),
                pa.array(size, pa.int64()),
                pa.array(lost, pa.int64()),
                pa.array(added, pa.int64()),
                pa.array(differences, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns],
                ["a", "b", "linked", "size", "lost", "added", "differences"],
            )

    return confirm


CONFIRMED = (
    "a bigint, b bigint, linked boolean, size bigint, lost bigint, added bigint, "
    "differences array<bigint>"
)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with their full sets compared; ``large`` asks for the differences."""
    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(a, "a").join(b, "b").select("a", "b", "large", "x", "y")
    return rows.mapInArrow(_confirm(percent), CONFIRMED)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures ``x`` and ``y`` differ in at most ``FAR`` components."""
    for batch in batches:
        x, y = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16) for i in (3, 4)
        )
        distance = np.count_nonzero((x != y).reshape(-1, CHUNKS * CHUNK), axis=1)
        kept = batch.filter(pa.array(distance <= FAR))
        yield kept.select(["a", "b", "large"])


def _within_distance(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs without those far apart by signatures; ``large`` ones all stay.

    Signatures have a fixed size and travel before any set does. Members of large buckets
    need their differences from the first, however far they are from it.
    """
    a = classes.select(F.col("rep").alias("a"), F.col("signature").alias("x"))
    b = classes.select(F.col("rep").alias("b"), F.col("signature").alias("y"))
    rows = pairs.where("NOT large").join(a, "a").join(b, "b").select("a", "b", "large", "x", "y")
    near = rows.mapInArrow(_near, "a bigint, b bigint, large boolean")
    return pairs.where("large").select("a", "b", "large").union(near)


def _shared(x: pa.Table, y: pa.Table) -> np.ndarray:
    """How many differences each row of one table has in common with each of the other."""
    parts = []
    for t in (x, y):
        lists = t["differences"].combine_chunks()
        parts.append((np.array(lists.flatten()), np.array(pa.compute.list_parent_indices(lists))))
    known = np.intersect1d(parts[0][0], parts[1][0])
    counts = np.zeros((len(x), len(y)), np.float32)
    if not len(known):
        return counts
    places = []
    for values, rows in parts:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        met = known[at] == values
        order = np.argsort(at[met], kind="stable")
        places.append((at[met][order], rows[met][order]))
    for first in range(0, len(known), COLUMNS):
        sides = []
        for (at, rows), n in zip(places, (len(x), len(y)), strict=True):
            a, b = np.searchsorted(at, (first, first + COLUMNS))
            side = np.zeros((n, COLUMNS), np.float32)
            side[rows[a:b], at[a:b] - first] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def _links_of_block(percent: int):
    """Links between a block's members apart from the first and its others.

    With ``lost`` and ``added`` against a first set of ``size``, two sets have
    ``size - lost - lost' + shared`` in common, where ``shared`` counts differences that
    both have. Of the links found, one for each member that they connect is returned.
    """

    def links(table: pa.Table) -> pa.Table:
        apart = table["apart"]
        x, y = table.filter(apart), table.filter(pa.compute.invert(apart))
        pairs: set[tuple[int, int]] = set()
        if len(x) and len(y):
            lost, added, ids = (
                [t[c].to_numpy() for t in (x, y)] for c in ("lost", "added", "a")
            )
            size = int(x["size"][0].as_py())
            common = size - lost[0][:, None] - lost[1][None] + _shared(x, y)
            total = (size - lost[0] + added[0])[:, None] + (size - lost[1] + added[1])[None]
            linked = 100 * common >= percent * (total - common)
            linked &= ids[0][:, None] != ids[1][None]
            pairs = _spanning(linked, *ids)
        columns = [pa.array([pair[i] for pair in pairs], pa.int64()) for i in (0, 1)]
        return pa.Table.from_arrays(columns, ["a", "b"])

    return links


def _spanning(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> set[tuple[int, int]]:
    """Links that connect what all links connect: members found from each start, in turn."""
    pairs: set[tuple[int, int]] = set()
    new_x, new_y = linked.any(axis=1), linked.any(axis=0)
    while new_x.any():
        edge = [int(np.argmax(new_x))]
        new_x[edge] = False
        while len(edge):
            reached = []
            for i in edge:
                own = np.flatnonzero(linked[i] & new_y)
                new_y[own] = False
                reached += own.tolist()
                pairs |= {(int(x[i]), int(y[j])) for j in own}
            edge = []
            for j in reached:
                own = np.flatnonzero(linked[:, j] & new_x)
                new_x[own] = False
                edge += own.tolist()
                pairs |= {(int(x[i]), int(y[j])) for i in own}
    return pairs


def _parts(rows, members: int, entries: int):
    """Blocks that a bucket's rows of a kind need, by their number and their differences."""
    n = F.ceil(F.count_if(rows) / members)
    size = F.ceil(F.sum(F.when(rows, F.size("differences"))) / entries)
    return F.greatest(n, size).cast("int")


def _blocks(stars: DataFrame) -> DataFrame:
    """Rows of the blocks ``b, x, y``: members apart from the first, and all others."""
    own = stars.where("differences IS NOT NULL")
    n = own.groupBy("b").agg(
        F.count_if(~F.col("linked")).alias("n"),
        _parts(~F.col("linked"), APART, APART_ENTRIES).alias("xs"),
        _parts(F.lit(True), OTHERS, OTHERS_ENTRIES).alias("ys"),
    )
    own = own.join(stored(n.where("n > 0").drop("n")), "b")
    x = F.pmod(F.xxhash64("a"), F.col("xs")).cast("int")
    y = F.pmod(F.xxhash64("a"), F.col("ys")).cast("int")
    columns = ["a", "b", "size", "lost", "added", "differences"]
    apart = own.where("NOT linked").select(
        *columns,
        F.lit(True).alias("apart"),
        x.alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"),
    )
    others = own.select(
        *columns,
        F.lit(False).alias("apart"),
        F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"),
        y.alias("y"),
    ).select(apart.columns)
    return apart.union(others)


def _by_differences(stars: DataFrame, percent: int) -> DataFrame:
    """Links in large buckets of members that aren't linked with the bucket's first.

    Those members meet all others that were compared with the same first, in blocks: a
    block of them and one of the others are a group, so a very large bucket splits over
    tasks. What members have in common follows from their differences from the first,
    which are few where texts are alike, so no pairs and no sets travel. Long texts that
    share little with the first have long differences; a bucket of such has more blocks,
    so that a block stays within ``APART_ENTRIES`` and ``OTHERS_ENTRIES`` on average.
    """
    blocks = _blocks(stars).groupBy("b", "x", "y")
    return blocks.applyInArrow(_links_of_block(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each document.

    Documents are linked if their shingle sets have ``percent`` of their union in common.
    Those with equal sets are a class with one representative, so copies meet once. The
    keys of representatives' signatures form buckets, and a bucket's members are compared
    with its first. Of the pairs that are left, those in a bucket of up to ``SMALL`` are
    compared if their signatures are near and they aren't connected already; those in
    larger ones by their full differences from the first, see ``_by_differences``. So no
    link in a bucket is lost but by the chance named at ``FAR``, and each is confirmed on
    full sets.

    A null or empty text, or one without words, has an empty set and is linked with
    nothing. Rows that share a doc_id are one document; of different texts the one whose
    set's hash is least counts. Rows without a doc_id are left out. An empty table gives
    no rows. Other columns play no role.
    """
    texts = id_and_text(docs).where("doc_id IS NOT NULL")
    schema = "doc_id bigint, n bigint, h1 bigint, h2 bigint, signature binary"
    signed = texts.mapInArrow(_sign(width), schema)
    signed = stored(
        signed.groupBy("doc_id")
        .agg(F.min(F.struct("h1", "h2", "n", "signature")).alias("s"))
        .select("doc_id", "s.*")
    )
    classes = stored(
        signed.where("n > 0")
        .groupBy("h1", "h2", "n")
        .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"))
    )
    keys = classes.select("rep", "signature")
    keys = keys.mapInArrow(_keys, "slot short, key bigint, rep bigint")
    bucket = ["slot", "key"]
    shared = keys.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    members = stored(keys.join(stored(shared.where("n > 1").select(*bucket)), bucket))
    needed = members.select("rep").distinct().join(classes, "rep").select("rep", "h1", "h2")
    own = texts.withColumnRenamed("doc_id", "rep").join(needed, "rep")
    sets = own.select("rep", "text", "h1", "h2").mapInArrow(
        _set_rows(width), "rep bigint, shingles binary"
    )
    sets = stored(sets.dropDuplicates(["rep"]))

    size = members.groupBy(*bucket).agg(
        F.min("rep").alias("b"), (F.count(F.lit(1)) > SMALL).alias("large")
    )
    size = stored(size)
    stars = members.join(size, bucket).where("rep != b")
    stars = stars.groupBy(F.col("rep").alias("a"), "b").agg(F.max("large").alias("large"))
    stars = stored(_within_distance(stored(stars), classes))
    stars = stored(_confirmed(stars, sets, percent))
    near_first = stars.where("linked").select("a", "b")
    links = stored(near_first.union(_by_differences(stars, percent)))
    label = components(links).withColumnRenamed("node", "rep")
    small = members.join(size.where("NOT large"), bucket).where("rep != b")
    small = small.join(label, "rep", "left").select(
        *bucket, "rep", F.coalesce("component", "rep").alias("own")
    )
    small = stored(small)
    other = small.select(*bucket, F.col("rep").alias("b"), F.col("own").alias("its"))
    pairs = small.withColumnRenamed("rep", "a").join(other, bucket).where("own < its")
    pairs = pairs.select("a", "b").distinct().withColumn("large", F.lit(False))
    pairs = stored(_within_distance(stored(pairs), classes))
    more = _confirmed(pairs, sets, percent).where("linked").select("a", "b")
    joined = components(links.union(stored(more)))
    class_of = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "h1", "h2", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component_id")
    )
    rows = signed.join(
        class_of,
        (signed["h1"] == class_of["h1"])
        & (signed["h2"] == class_of["h2"])
        & (signed["n"] == class_of["size"]),
        "left",
    )
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )
