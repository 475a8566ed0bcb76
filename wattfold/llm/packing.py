"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import combinations, count

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfold.llm.common import id_and_text, slabs, stored
from wattfold.llm.pretokens import ranks, split, word_encoding

CAPACITY = 2048
#: Pieces that one task packs together. A shard ends with about one underfull sequence
#: more than a single large one would.
SHARD_PIECES = 20_000
#: Code points beyond which a text is encoded word by word.
LONG_TEXT = 1 << 18
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "packing",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks(path),
        special_tokens=SPECIAL,
    )


def _long_ids(text: str, path: str) -> list[int]:
    """The same ids, word by word: no run of blanks is too long for it."""
    words, ids = word_encoding(path), []
    for n, part in enumerate(text.split("<|endoftext|>")):
        ids += [SPECIAL["<|endoftext|>"]] * (n > 0)
        for word in split(part):
            ids += words.encode_ordinary(word)
    return ids


def token_pieces(docs: DataFrame, rank_file: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of at most ``capacity`` tokens; the ids themselves stay in the task.

    The rank file holds the vocabulary of the tokenizer file; a special string inside a
    text is its special token, as in that library. Each document ends with id 0. A longer
    document is cut into full pieces, and its first piece takes the remainder. A null
    text is empty and gives one piece of one token. Rows alike give pieces alike.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(rank_file)
        for doc_ids, texts in slabs(batches):
            whose, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts):
                if len(text) > LONG_TEXT:
                    ids = _long_ids(text, rank_file)
                elif any(mark in text for mark in SPECIAL):
                    ids = encoding.encode(text, allowed_special="all")
                else:
                    ids = encoding.encode_ordinary(text)
                ids.append(0)
                data = memoryview(np.array(ids, "<u4")).cast("B")
                a = 0
                for k, b in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    whose.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
                    a = b
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(whose, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(cut, PIECES)


class _Bins:
    """Sequences of one shard: lists of item numbers, and how full each is."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, order: list[int]) -> None:
        """Each item, largest first, goes where the least room is left."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0  # bit r is set if some bin has r free
        for i in order:
            size = self.sizes[i]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += size
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)

    def _groups(self, b: int) -> dict[int, tuple[int, ...]]:
        """By size, a set of one or two items of a bin; for each size one stands for all."""
        by_size: dict[int, list[int]] = {}
        for i in self.items[b]:
            by_size.setdefault(self.sizes[i], []).append(i)
        groups = {2 * x: tuple(own[:2]) for x, own in by_size.items() if len(own) > 1}
        for (x, own), (y, other) in combinations(by_size.items(), 2):
            groups[x + y] = (own[0], other[0])
        return groups | {x: (own[0],) for x, own in by_size.items()}

    def _enter(self, b: int) -> None:
        """Puts an underfull bin's slots into the index; full and empty ones have none."""
        self.version[b] += 1
        self.groups[b] = {}
        room = self.capacity - self.fill[b]
        if not self.fill[b] or not room:
            return
        self.groups[b] = self._groups(b)
        for size in (0, *self.groups[b]):
            heappush(self.slots[size + room], (size, b, self.version[b]))
            if size < self.least[size + room]:
                self.least[size + room] = size

    def search_pass(self, fewest: int = 0) -> int:
        """Exchanges between underfull bins that raise the sum of squared fills.

        Out of bin A goes a group of one or two items, out of bin B one of none (a move),
        one or two, so that B gets fuller by ``d``. The squares rise by
        ``2 d (fill B - fill A + d)``. All underfull bins and all groups take part, and a
        bin is looked at until nothing more goes out of it. A pass ends early if no more
        than ``fewest`` bins are left.

        A slot is what B has room for once its group is out, ``c``. With a group of
        ``size`` in it B's room is ``c - size``, so the squares rise if that is less than
        A's room and B's group is smaller than A's. For each ``c`` the smallest group is
        enough to know whether there is a slot.
        """
        cap, fill, n = self.capacity, self.fill, len(self.fill)
        self.version, self.groups = [0] * n, [{} for _ in range(n)]
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(cap + 1)]
        self.least = np.full(cap + 1, cap + 1)
        used = sum(map(bool, self.items))
        for b in range(n):
            self._enter(b)
        done = 0
        for a in sorted((b for b in range(n) if self.groups[b]), key=lambda b: fill[b]):
            found = True
            while found:
                found = False
                for size in sorted(self.groups[a], reverse=True):
                    slot = self._slot(a, size)
                    if slot:
                        self._exchange(a, size, *slot)
                        done += 1
                        used -= not self.items[a]
                        if used <= fewest:
                            return done
                        found = True
                        break
        return done

    def _slot(self, a: int, size: int) -> tuple[int, int] | None:
        """The slot that fits a group of A most tightly and raises the squares."""
        c, end = size, size + self.capacity - self.fill[a]
        while c < end:
            smaller = self.least[c:end] < size
            step = int(smaller.argmax())
            if not smaller[step]:
                return None
            c += step
            top = self._top(c)
            if top and top[1] == a:
                heappop(self.slots[c])
                other = self._top(c)
                heappush(self.slots[c], top)
                self.least[c] = top[0]
                top = other
            if top and top[0] < size:
                return top[0], top[1]
            c += 1
        return None

    def _top(self, c: int) -> tuple[int, int, int] | None:
        """The smallest group of the slots of ``c``; those of bins as they were are dropped."""
        heap = self.slots[c]
        while heap and heap[0][2] != self.version[heap[0][1]]:
            heappop(heap)
        self.least[c] = heap[0][0] if heap else self.capacity + 1
        return heap[0] if heap else None

    def _exchange(self, a: int, size: int, back_size: int, b: int) -> None:
        group, back = self.groups[a][size], self.groups[b].get(back_size, ())
        self.items[a] = [i for i in self.items[a] if i not in group] + list(back)
        self.items[b] = [i for i in self.items[b] if i not in back] + list(group)
        self.fill[a] -= size - back_size
        self.fill[b] += size - back_size
        self._enter(a)
        self._enter(b)


def pack_sizes(sizes: list[int], capacity: int, passes: int | None = None) -> list[list[int]]:
    """Item numbers by bin: best fit, then the local search.

    The search ends when a pass finds nothing, which it comes to because the squares only
    rise, or when no fewer bins could hold the items; also after ``passes``, if given.
    """
    least = -(-sum(sizes) // capacity)
    bins = _Bins(sizes, capacity)
    bins.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    for _ in count() if passes is None else range(passes):
        if sum(map(bool, bins.items)) <= least or not bins.search_pass(least):
            break
    return [items for items in bins.items if items]


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; needs a stored table.

    A shard takes rows by their place in the table, not by a value of theirs, so equal
    rows spread evenly. A shard is packed on its own, within one task. An empty table
    gives no rows. Ties in length keep the order in which the shard was read.
    """
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    place = F.xxhash64(F.monotonically_increasing_id())
    rows = pieces.withColumn("shard", F.pmod(place, F.lit(shards)))

    def one(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sequence, offset = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        sizes = shard["length"].tolist()
        for number, items in enumerate(pack_sizes(sizes, capacity)):
            place = 0
            for i in items:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, place
                place += sizes[i]
        return shard.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    schema = f"{PIECES}, sequence_id bigint, offset bigint"
    return rows.groupBy("shard").applyInPandas(one, schema)


def pack_documents(docs: DataFrame, rank_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of all documents, packed into sequences of at most ``capacity``.

    Each piece lies once in a sequence; offsets have no gaps from 0. Null texts, equal
    rows, empty tables: see ``token_pieces`` and ``pack``. Other columns play no role.
    """
    return pack(stored(token_pieces(docs, rank_file, capacity)), capacity)
