"""A hashed maximum-entropy language model with class-factored words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.llm.common import id_and_text, slabs, stored

#: Branches of a class at each level of the tree, and levels: by a word's ending, then by
#: its beginning. A leaf holds the words that share both.
CLASSES, LEVELS = 16, 2
LEAVES = CLASSES**LEVELS
#: Rows of a level's weight table in one block: the number of training words, as a power of
#: two, within what a task can afford to send (4 MB for both levels); the first is also the
#: default. More words have more blocks.
ROWS, LEAST_ROWS, MOST_ROWS = 1 << 15, 1 << 12, 1 << 15
#: Passes over parts of the training rows, tokens of a gradient step, and its rate.
ROUNDS, STEP, RATE = 2, 1 << 13, 0.3
#: Logits are kept within this.
FAR = 60.0
#: A level's weight table travels in so many blocks.
BLOCKS = 32
#: No word holds white space, so the end token can't be one.
END = b"\n"
#: Documents and bytes of a chunk.
CHUNK_DOCS, CHUNK_BYTES = 4096, 16 << 20
#: Tokens that a block learns from and scores at most, and those it looks at in one go.
MOST_TOKENS, SLAB = 1 << 22, 1 << 18
#: Different hashes of a word's ending.
ENDINGS = 1 << 12
#: Words within a leaf: gradient steps on all training tokens, what a weight's square costs
#: (half of that times it), and tokens of the leaves that are fitted in one go.
LEAF_STEPS, COST, LEAF_SLAB = 8, 0.1, 1 << 16
ODD, EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Numbers(dict):
    """Words by the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Hashes(dict):
    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, key: bytes) -> int:
        self[key] = h = xxhash.xxh32_intdigest(key, seed=self.seed)
        return h


def _tokens(text: str) -> list[bytes]:
    words = text.encode().lower().split()
    words.append(END)
    return words


class Words:
    """What the model knows of distinct words: 32 bits of the word's hash, and 16 of which
    the low four are its branch by the beginning, and the high ones its ending's hash, whose
    low four are its branch by the ending. Each follows from the word alone."""

    ENDING, BEGINNING = _Hashes(1), _Hashes(2)

    def __init__(self, h: np.ndarray, key: np.ndarray):
        self.h, self.key = h, key

    @classmethod
    def of(cls, words: list[bytes]) -> Words:
        n = len(words)
        h = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, n)
        ends = np.fromiter((cls.ENDING[w[-2:]] for w in words), np.uint32, n)
        begins = np.fromiter((cls.BEGINNING[w[:2]] for w in words), np.uint32, n)
        return cls(h, (ends << 4 | begins % CLASSES).astype(np.uint16))

    @property
    def ending(self) -> np.ndarray:
        return self.key >> 4

    @property
    def branch(self) -> list[np.ndarray]:
        return [self.ending % CLASSES, self.key % CLASSES]

    @property
    def leaf(self) -> np.ndarray:
        return self.key % LEAVES

    def packed(self) -> bytes:
        return _packed(self.h.tobytes(), _planes(self.key))

    @classmethod
    def unpacked(cls, data: bytes) -> Words:
        h, key = _unpacked(data)
        return cls(np.frombuffer(h, np.uint32), _unplaned(key, np.uint16))


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What stands one place earlier; beyond a document's start stands zero."""
    out = np.concatenate([np.zeros(1, np.uint64), x[:-1].astype(np.uint64)])[: len(x)]
    out[first[first < len(out)]] = 0
    return out


def _contexts(h: np.ndarray, first: np.ndarray, ending: np.ndarray) -> list[np.ndarray]:
    """A number for each feature of each token: the word before (n-gram), the endings of the
    two words before (n-gram), those of the second and third before (skip)."""
    one = _before(ending, first)
    two = _before(one, first)
    three = _before(two, first)
    return _numbered(_before(h, first), one, two, three)


def _numbered(word: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> list[np.ndarray]:
    return [word * ODD + np.uint64(1), (one * ODD + two) * EVEN, (two * EVEN + three) * ODD]


def _rows(contexts: list[np.ndarray], above: np.ndarray | int, rows: int) -> list[np.ndarray]:
    """Rows of a level's weight table; ``above`` is the branch taken before, plus one."""
    bits, salt = np.uint64(64 - (rows.bit_length() - 1)), np.asarray(above, np.uint64) * EVEN
    out = []
    for x in contexts:
        x = x + salt
        out.append((((x ^ (x >> np.uint64(31))) * ODD) >> bits).astype(np.int32))
    return out


def _features(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Rows of the first level where a word's hash stands for its ending too."""
    return _rows(_contexts(h, first, h), 0, ROWS)


def _exps(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> tuple:
    """Exponentials of all branches' logits, and their sums.

    Weights and normal biases stay far within ``FAR``, which keeps exponentials finite.
    """
    logits = weights.take(features[0], axis=0)
    logits += bias
    for f in features[1:]:
        logits += weights.take(f, axis=0)
    np.clip(logits, -FAR, FAR, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(CLASSES, np.float32)


def _shares(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    exps, sums = _exps(weights, bias, features)
    exps /= sums[:, None]
    return exps


@dataclass
class Model:
    """Weights of each level, and the training counts (tokens, words) of each leaf."""

    weights: np.ndarray  # level, row, branch
    tokens: np.ndarray
    words: np.ndarray

    @classmethod
    def blank(cls, tokens: np.ndarray, words: np.ndarray, rows: int) -> Model:
        return cls(np.zeros((LEVELS, rows, CLASSES), np.float32), tokens, words)

    @property
    def sizes(self) -> np.ndarray:
        """Places of a leaf: a word has its count and one more, unseen words share one."""
        return self.tokens + self.words + 1

    def biases(self) -> list[np.ndarray]:
        """Without weights the tree gives each word its share of the training counts."""
        own = np.log(self.sizes.astype(np.float64).reshape(CLASSES, CLASSES))
        top = np.log(np.exp(own).sum(axis=1))
        top, own = top - top.max(), own - own.max(axis=1, keepdims=True)
        return [top[None].astype(np.float32), own.astype(np.float32)]

    def levels(
        self, contexts: list[np.ndarray], branches: list[np.ndarray]
    ) -> list[tuple[np.ndarray, tuple, np.ndarray, list[np.ndarray]]]:
        """Weights, biases and the branch above, the branch taken, and rows of features."""
        out, above = [], np.zeros(len(branches[0]), np.int8)
        for level, bias in enumerate(self.biases()):
            taken = branches[level].astype(np.int8)
            rows = _rows(contexts, above + np.int8(level), self.weights.shape[1])
            out.append((self.weights[level], (bias, above), taken, rows))
            above = taken
        return out

    def levels_of(self, words: Words, tokens: np.ndarray, first: np.ndarray) -> list:
        contexts = _contexts(words.h.astype(np.uint16)[tokens], first, words.ending[tokens])
        return self.levels(contexts, [b[tokens] for b in words.branch])


def _log10_leaves(levels: list) -> np.ndarray:
    """Logarithm of the chance of each token's leaf."""
    out = np.zeros(len(levels[0][2]))
    for weights, (bias, above), taken, rows in levels:
        for a in range(0, len(out), STEP):
            own = slice(a, a + STEP)
            exps, sums = _exps(weights, bias.take(above[own], axis=0), [r[own] for r in rows])
            share = exps[np.arange(len(exps)), taken[own]] / sums
            out[own] += np.log10(np.maximum(share.astype(np.float64), 1e-30))
    return out


def _step(weights, seen, squares, bias, taken, features) -> None:
    """One gradient step on a batch of tokens, with a rate per row that falls."""
    gradient = _shares(weights, bias, features)
    gradient[np.arange(len(taken)), taken] -= 1
    for f in features:
        order = np.argsort(f.astype(np.uint16) if len(weights) <= 1 << 16 else f, kind="stable")
        own = f[order]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        rows = own[begins]
        total = np.add.reduceat(gradient[order], begins, axis=0)
        squares[rows] += np.einsum("ij,ij->i", total, total) / CLASSES
        seen[rows] += np.diff(begins, append=len(f))
        weights[rows] -= RATE * total / np.sqrt(squares[rows] + 1.0)[:, None]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a missing id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 == 2


def _is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


#: Of kind 0, distinct words of a chunk that share a bucket: the words, their numbers there
#: and how often training rows hold them. Of kind 1, a chunk: its documents, their tokens as
#: places (``_ranked``) that give numbers, and its words' hashes.
CHUNKS = (
    "kind int, chunk bigint, bucket int, data binary, "
    "ids array<bigint>, lengths array<bigint>, tokens binary, words binary"
)


def _buckets(partitions: int) -> int:
    """Buckets of words, as many as keep one of them small however many chunks there are."""
    return min(max(2 * partitions, 16), 1 << 15)


def _packed(*parts: bytes) -> bytes:
    out = []
    for part in parts:
        data = pa.compress(part, codec="zstd", asbytes=True)
        out += [np.array([len(part), len(data)], np.int64).tobytes(), data]
    return b"".join(out)


def _unpacked(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size, own = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(pa.decompress(data[at + 16 : at + 16 + own], size, codec="zstd", asbytes=True))
        at += 16 + own
    return out


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys."""
    begins = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])).tolist()
    for i, j in zip(begins, [*begins[1:], len(sorted_keys)], strict=True):
        yield int(sorted_keys[i]), slice(i, j)


def chunked(docs: DataFrame) -> DataFrame:
    """The corpus as chunks of documents, tokenized once, and the words of each by bucket."""
    buckets = _buckets(docs.rdd.getNumPartitions())

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for ids, texts in slabs(batches, CHUNK_DOCS, CHUNK_BYTES):
            nth += 1
            numbers = _Numbers()
            own = [np.fromiter(map(numbers.__getitem__, t), np.uint32, len(t)) for t in map(_tokens, texts)]
            lengths = np.array([len(x) for x in own])
            found, rank = _ranked(np.concatenate(own))
            tokens = _places(rank, len(found))
            kept = np.array([not _is_held_out(d) for d in ids.to_pylist()])
            train = np.bincount(tokens[np.repeat(kept, lengths)], minlength=len(numbers))
            distinct = list(numbers)
            distinct = [distinct[i] for i in found]
            words = Words.of(distinct)
            bucket = words.h.astype(np.uint16) % buckets
            order = np.argsort(bucket, kind="stable")
            found, packs = [], []
            for k, cut in _cuts(bucket[order]):
                number = order[cut]
                found.append(k)
                packs.append(_packed(
                    b" ".join([distinct[i] for i in number]),
                    _planes(np.diff(number, prepend=0).astype(np.int32)),
                    _planes(train[number]),
                ))
            yield _chunk_rows(0, nth, len(found), {
                "bucket": pa.array(found, pa.int32()),
                "data": pa.array(packs, pa.binary()),
            })
            yield _chunk_rows(1, nth, 1, {
                "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "tokens": pa.array([_packed(_planes(rank))], pa.binary()),
                "words": pa.array([words.packed()], pa.binary()),
            })

    return id_and_text(docs).mapInArrow(chunk, CHUNKS)


_KINDS = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
}


def _chunk_rows(kind: int, chunk: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    fields = [c.split() for c in CHUNKS.split(", ")]
    given = columns | {
        "kind": pa.array(np.full(n, kind), pa.int32()),
        "chunk": pa.array(np.full(n, chunk), pa.int64()),
    }
    arrays = [given.get(name, pa.nulls(n, _KINDS[k])) for name, k in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one significance together: the high ones are nearly all zero."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplaned(data: bytes, dtype=np.uint32) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return planes.T.copy().view(dtype).ravel()


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and each one's place there, from one on, which compress well: those
    met more than once by frequency, then the others as met, whose place is zero for all."""
    found = pa.array(x).dictionary_encode()
    place = found.indices.to_numpy()
    n = np.bincount(place)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.uint32)
    rank[order] = np.arange(1, len(n) + 1)
    rank[n == 1] = 0
    return found.dictionary.to_numpy()[order], rank[place]


def _places(rank: np.ndarray, n: int) -> np.ndarray:
    """Places from zero on among the ``n`` distinct numbers."""
    once = rank == 0
    out = rank.astype(np.int64) - 1
    out[once] = np.arange(n - once.sum(), n)
    return out


def _chunk_tokens(row: dict, words: Words) -> np.ndarray:
    """A chunk's tokens, as numbers of its words."""
    return _places(_unplaned(*_unpacked(row["tokens"].as_py())), len(words.h))


COUNTS = (
    "chunk bigint, data binary, "
    "tokens array<bigint>, words array<bigint>, endings array<bigint>"
)


def _count_bucket(rows: pa.Table) -> pa.Table:
    """Counts of a bucket's words, packed for each chunk, and beside the first of them sums
    over distinct words: tokens and words by leaf, tokens by ending."""
    chunks, numbers, trains, words = rows["chunk"].to_pylist(), [], [], []
    for data in rows["data"]:
        joined, number, train = _unpacked(data.as_py())
        words.append(pa.array(joined.split(b" "), pa.large_binary()))
        numbers.append(number)
        trains.append(_unplaned(train, np.int64))
    lengths = [len(w) for w in words]
    found = pa.concat_arrays(words).dictionary_encode()
    place = found.indices.to_numpy()
    c = np.bincount(place, np.concatenate(trains)).astype(np.int64)
    own = Words.of(found.dictionary.to_pylist())
    sums = {
        "tokens": np.bincount(own.leaf, c, LEAVES),
        "words": np.bincount(own.leaf[c > 0], minlength=LEAVES),
        "endings": np.bincount(own.ending, c, ENDINGS),
    }
    back = np.split(c[place], np.cumsum(lengths)[:-1])
    none = [None] * (len(chunks) - 1)
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "data": pa.array([_packed(n, _planes(x)) for n, x in zip(numbers, back, strict=True)], pa.binary()),
        }
        | {k: pa.array([x.astype(np.int64), *none], pa.list_(pa.int64())) for k, x in sums.items()}
    )


def word_counts(chunks: DataFrame) -> DataFrame:
    """Training counts of all words, packed for each chunk, with sums by leaf and ending.

    A word stands once in each chunk that holds it, whatever its frequency, and without
    postings. One shuffle brings a bucket's words together; the counts go back packed.
    """
    rows = chunks.where("kind = 0").select("bucket", "chunk", "data")
    return rows.groupBy("bucket").applyInArrow(_count_bucket, COUNTS)


def _sums(counts: DataFrame, name: str, n: int) -> np.ndarray:
    own = counts.where(F.col(name).isNotNull()).select(F.posexplode(name).alias("at", "n"))
    sums = np.zeros(n, np.int64)
    for row in own.groupBy("at").agg(F.sum("n").alias("n")).collect():
        sums[row["at"]] = row["n"]
    return sums


def leaf_sums(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and words of each leaf; there are always ``LEAVES`` of them."""
    return _sums(counts, "tokens", LEAVES), _sums(counts, "words", LEAVES)


def table_rows(n_words: int) -> int:
    return min(max(1 << max(n_words - 1, 1).bit_length(), LEAST_ROWS), MOST_ROWS)


def _mean(frames: pd.DataFrame) -> tuple[bytes, bytes]:
    """Mean movement of a block's rows by how often each was seen, and the sum of that."""
    seen = np.stack([np.frombuffer(x, np.float32) for x in frames["seen"]])
    total = seen.sum(axis=0)
    moved = np.zeros((len(total), CLASSES), np.float32)
    for x, n in zip(frames["moved"], seen / np.maximum(total, 1), strict=True):
        moved += np.frombuffer(x, np.float16).reshape(-1, CLASSES) * n[:, None]
    return moved.astype(np.float16).tobytes(), total.tobytes()


def train(chunks: DataFrame, tokens: np.ndarray, words: np.ndarray) -> Model:
    """Weights from all rows that aren't held out, each in one of the rounds.

    In a round every task takes gradient steps on its chunks, beginning with the weights so
    far. A weight row's new value is the mean over tasks, by how often each has seen it.
    Blocks of the table are summed over groups of tasks, then over groups, each of about
    the square root of the number of tasks.
    """
    model = Model.blank(tokens, words, table_rows(int(words.sum())))
    rows = model.weights.shape[1]
    per = rows // BLOCKS
    schema = "block int, grp int, moved binary, seen binary"
    own = chunks.where("kind = 1").select("ids", "lengths", "tokens", "words")
    groups = max(1, round(own.rdd.getNumPartitions() ** 0.5))
    for turn in range(ROUNDS):
        begin = model

        def learn(
            batches: Iterator[pa.RecordBatch], begin=begin, turn=turn
        ) -> Iterator[pa.RecordBatch]:
            own = Model(begin.weights.copy(), begin.tokens, begin.words)
            seen, squares = np.zeros((2, LEVELS, rows), np.float32)
            for batch in batches:
                for i in range(batch.num_rows):
                    _learn_chunk(own, seen, squares, {c: batch[c][i] for c in batch.schema.names}, turn)
            if not seen.any():
                return
            moved = (own.weights - begin.weights).astype(np.float16).reshape(-1, per * CLASSES)
            blocks = list(enumerate(zip(moved, seen.reshape(-1, per), strict=True)))
            grp = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in blocks], pa.int32()),
                    pa.array([grp] * len(blocks), pa.int32()),
                    pa.array([m.tobytes() for _, (m, _) in blocks], pa.binary()),
                    pa.array([s.tobytes() for _, (_, s) in blocks], pa.binary()),
                ],
                ["block", "grp", "moved", "seen"],
            )

        def add(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
            moved, seen = _mean(frames)
            grp = key[1] if len(key) > 1 else 0
            return pd.DataFrame(
                {"block": [key[0]], "grp": [grp], "moved": [moved], "seen": [seen]}
            )

        sums = own.mapInArrow(learn, schema).groupBy("block", "grp").applyInPandas(add, schema)
        sums = sums.groupBy("block").applyInPandas(add, schema)
        weights = model.weights.copy().reshape(-1, per, CLASSES)
        for row in sums.collect():
            weights[row["block"]] += np.frombuffer(row["moved"], np.float16).reshape(per, -1)
        model = Model(weights.reshape(LEVELS, rows, CLASSES), tokens, words)
    return model


def _learn_chunk(model: Model, seen, squares, row: dict, turn: int) -> None:
    """Gradient steps on the training documents of a chunk that are this round's."""
    lengths, ids = row["lengths"].values.to_numpy(), row["ids"].as_py()
    mine = [i % ROUNDS == turn and not _is_held_out(d) for i, d in enumerate(ids)]
    mine = np.array(mine, bool)
    words = Words.unpacked(row["words"].as_py())
    tokens = _chunk_tokens(row, words)[np.repeat(mine, lengths)]
    if not len(tokens):
        return
    first = np.cumsum(np.append(0, lengths[mine][:-1]))
    _learn(model.levels_of(words, tokens, first), seen, squares)


def _learn(levels: list, seen: np.ndarray, squares: np.ndarray) -> None:
    for a in range(0, len(levels[0][2]), STEP):
        cut = slice(a, a + STEP)
        for level, (weights, (bias, above), taken, rows) in enumerate(levels):
            own = [r[cut] for r in rows]
            at = bias.take(above[cut], axis=0)
            _step(weights, seen[level], squares[level], at, taken[cut], own)


@dataclass
class Blocks:
    """Blocks of the weight table, each with rows of its own for what follows some endings.

    Endings, numbered by frequency from one on (zero: no word), fill a block after the
    other; one with more tokens than a block holds has several, by chunk or by word.
    """

    number: np.ndarray  # of each ending's hash
    block: np.ndarray  # of each ending's number, the first
    parts: np.ndarray  # and how many
    size: int  # tokens that a block should hold

    @classmethod
    def of(cls, endings: np.ndarray, n_words: int) -> Blocks:
        number = np.empty(ENDINGS, np.uint16)
        number[np.argsort(-endings, kind="stable")] = np.arange(1, ENDINGS + 1)
        tokens = np.zeros(ENDINGS + 1, np.int64)
        tokens[number] = endings
        tokens[0] = endings[Words.of([END]).ending[0]]
        # As many blocks as give the words a row each, and more if they would be too long.
        size = max(min(MOST_TOKENS, int(tokens.sum()) * MOST_ROWS // max(n_words, 1)), 1)
        parts = np.maximum(-(-tokens // size), 1)
        filled = np.maximum(np.cumsum(np.where(parts > 1, 0, tokens)) - 1, 0) // size
        more = np.where(parts > 1, parts, 0)
        block = np.where(parts > 1, filled.max() + 1 + np.cumsum(more) - more, filled)
        return cls(number, block, parts, size)

    def __len__(self) -> int:
        return int((self.block + self.parts).max())

    def by_word(self, h: np.ndarray, c: np.ndarray, ends: list[np.ndarray], chunk: int) -> np.ndarray:
        """Blocks of tokens by the word before: its hash, its frequency and the endings.

        What follows a word is in one block. A word too frequent for that has several, by the
        endings before it; beginnings of documents have nothing to go by but the chunk.
        """
        parts = self.parts[ends[0]].astype(np.uint64)
        share = (c * 4 // self.size + 1).astype(np.uint64)
        further = ((ends[1].astype(np.uint64) * EVEN + ends[2]) * ODD) >> np.uint64(32)
        part = ((h * ODD) >> np.uint64(32)) + further % share
        part[ends[0] == 0] = chunk
        return self.block[ends[0]] + (part % parts).astype(np.int64)


def _dealt(blocks: Blocks, row: dict, counts: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """A chunk's tokens by block: each one's document, whether it is for training, its leaf,
    the word before and the endings of the three before; with counts of the chunk's words also
    the word itself and its count."""
    ids, lengths = row["ids"].as_py(), row["lengths"].values.to_numpy()
    words = Words.unpacked(row["words"].as_py())
    tokens = _chunk_tokens(row, words)
    first = np.cumsum(lengths) - lengths
    ends = [_before(blocks.number[words.ending][tokens], first)]
    for _ in range(2):
        ends.append(_before(ends[-1], first))
    # The word before as the number of its hash and ending in this chunk, from zero on.
    distinct, own = np.unique(
        words.h.astype(np.uint64) << np.uint64(16) | blocks.number[words.ending], return_inverse=True
    )
    word = _before((own + 1)[tokens], first).astype(np.int64)
    distinct = np.append(np.uint64(0), distinct)
    train = np.repeat([not _is_held_out(d) for d in ids], lengths)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
    leaf = words.leaf.astype(np.uint8)[tokens]
    code, chunk = ends[0].astype(np.int64), row["chunk"].as_py()
    if counts is None:
        block = blocks.block[code] + chunk % blocks.parts[code]
    else:
        c = _before(counts[tokens], first)
        block = blocks.by_word(distinct[word] >> np.uint64(16), c, [code, *ends[1:]], chunk)
    order = np.argsort(block.astype(np.uint16) if len(blocks) < 1 << 16 else block, kind="stable")
    for k, cut in _cuts(block[order]):
        at = order[cut]
        before, rank = _ranked(word[at])
        parts = [
            _planes(np.diff(doc[at], prepend=np.int32(0))),
            np.packbits(train[at]).tobytes(),
            leaf[at].tobytes() if counts is None else b"",
            _planes(distinct[before]),
            _planes(rank),
            _planes(ends[1][at].astype(np.uint16)),
            _planes(ends[2][at].astype(np.uint16)),
        ]
        if counts is not None:
            found, rank = _ranked(tokens[at])
            leaves = words.leaf[found].astype(np.uint8)
            parts += [_planes(words.h[found]), leaves.tobytes(), _planes(counts[found]), _planes(rank)]
        yield k, _packed(*parts)


def _undealt(data: bytes) -> list[np.ndarray]:
    """Document, training, leaf, word before (low bits), endings of the three before; where
    they were dealt, hashes of the word before and of the word, and the word's count."""
    doc, train, leaf, distinct, rank, two, three, *more = _unpacked(data)
    distinct = _unplaned(distinct, np.uint64)
    word = distinct[_places(_unplaned(rank), len(distinct))]
    if more:
        h, leaves, c, rank = more
        place = _places(_unplaned(rank), len(leaves))
        leaf = np.frombuffer(leaves, np.uint8)[place]
        h, c = _unplaned(h)[place], _unplaned(c, np.int64).astype(np.float32)[place]
        more = [(word >> np.uint64(16)).astype(np.uint32), h, c]
    else:
        leaf = np.frombuffer(leaf, np.uint8)
    return [
        np.cumsum(_unplaned(doc, np.int32), dtype=np.int32),
        np.unpackbits(np.frombuffer(train, np.uint8), count=len(leaf)).astype(bool),
        leaf,
        (word >> np.uint64(16)).astype(np.uint16),
        (word & np.uint64(0xFFFF)).astype(np.uint16),
        _unplaned(two, np.uint16),
        _unplaned(three, np.uint16),
        *more,
    ]


def _block_levels(model: Model, leaf, *before) -> list:
    contexts = _numbered(*[x.astype(np.uint64) for x in before])
    return model.levels(contexts, [leaf >> 4, leaf & 15])


def _learn_block(tokens: np.ndarray, words: np.ndarray, columns: list[np.ndarray]) -> Model:
    """A block's weights, by gradient steps on all its training tokens."""
    model = Model.blank(tokens, words, MOST_ROWS)
    seen, squares = np.zeros((2, LEVELS, MOST_ROWS), np.float32)
    train = columns[1]
    for a in range(0, len(train), SLAB):
        own = [x[a : a + SLAB][train[a : a + SLAB]] for x in columns[2:7]]
        _learn(_block_levels(model, *own), seen, squares)
    return model


def _score_block(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """Logarithms of the chances of a block's leaves."""
    slabs = range(0, len(columns[0]), SLAB)
    return np.concatenate(
        [_log10_leaves(_block_levels(model, *[x[a : a + SLAB] for x in columns[2:7]])) for a in slabs]
    )


def _numbers_of(keys: np.ndarray) -> np.ndarray:
    """Equal keys' number, by the order in which they are met."""
    return pa.array(keys).dictionary_encode().indices.to_numpy()


@dataclass
class Leaves:
    """Weights of the words within leaves: a softmax over all of a leaf's words.

    Features are the word before, and that with the ending of the one before it; either has a
    weight for each word that training rows hold there, and no weight (zero) for others. A
    word's chance in its leaf is its share of the leaf's counts times the exponential of its
    weights, over the sum of that for all the leaf's words. Weights of zero leave that sum at
    one, so it is kept as one plus what the words with weights add: first by the first
    feature, then by the second, whose words are among those of the first.

    Numbers of contexts and of pairs (a word in a context) run from zero on where training
    rows hold them; tokens of larger numbers have no weight.
    """

    weights: list[np.ndarray]  # of each feature: of pairs
    sums: list[np.ndarray]  # of each feature: of contexts

    @classmethod
    def fit(cls, n: int, contexts: list[np.ndarray], pairs: list[np.ndarray], share: np.ndarray) -> Leaves:
        """Gradient steps on the logarithm of the first ``n`` tokens' chances, less the cost
        of weights; ``share`` is theirs of the leaf's counts. A weight's rate is what keeps it
        from passing its best value, were it alone, over the number of features."""
        contexts, pairs = ([x[:n] for x in of] for of in (contexts, pairs))
        met = [np.bincount(x).astype(np.float64) for x in pairs]
        held = [int(x.max()) + 1 if n else 0 for x in contexts]
        seen = np.bincount(contexts[-1]).astype(np.float64)

        def above(lower: np.ndarray, upper: np.ndarray, size: int) -> np.ndarray:
            out = np.empty(size, upper.dtype if upper.dtype.kind == "f" else np.intp)
            out[lower] = upper
            return out

        own = above(pairs[0], share.astype(np.float64), len(met[0]))
        at = [above(p, c, len(m)) for p, c, m in zip(pairs, contexts, met, strict=True)]
        wider = [above(p, q, len(m)) for p, q, m in zip(pairs[1:], pairs[:-1], met[1:], strict=True)]
        outer = [above(c, d, m) for c, d, m in zip(contexts[1:], contexts[:-1], held[1:], strict=True)]
        last = len(met) - 1
        weights = [np.zeros(len(m)) for m in met]

        def mass() -> tuple[list, list]:
            masses, sums = [], []
            for k, w in enumerate(weights):
                base = masses[-1][wider[k - 1]] if k else own
                masses.append(base * np.exp(w))
                added = np.bincount(at[k], masses[-1] - base, held[k])
                sums.append(added + (sums[-1][outer[k - 1]] if k else 1.0))
            return masses, sums

        for _ in range(LEAF_STEPS):
            masses, sums = mass()
            # Expected tokens of pairs: a pair's mass times what its context's tokens weigh, but
            # where a pair of the next feature stands for it, as many as that expects.
            weigh = [seen / sums[last]]
            for k in range(last, 0, -1):
                weigh.insert(0, np.bincount(outer[k - 1], weigh[0], held[k - 1]))
            expected = [None] * len(met)
            for k in range(last, -1, -1):
                expected[k] = masses[k] * weigh[k][at[k]]
                if k < last:
                    instead = masses[k][wider[k]] * weigh[k + 1][at[k + 1]]
                    expected[k] += np.bincount(wider[k], expected[k + 1] - instead, len(met[k]))
            for w, m, e in zip(weights, met, expected, strict=True):
                w += (m - e - COST * w) / (np.maximum(m, e) + COST) / len(met)
        return cls(weights, mass()[1])

    def log10(self, contexts: list[np.ndarray], pairs: list[np.ndarray]) -> np.ndarray:
        """Logarithm of a token's chance in its leaf, beyond that of its share."""
        out, whole = np.zeros(len(contexts[0])), np.zeros(len(contexts[0]))
        for w, s, c, p in zip(self.weights, self.sums, contexts, pairs, strict=True):
            known = p < len(w)
            out[known] += w[p[known]]
            known = c < len(s)
            whole[known] = np.log(s[c[known]])
        return (out - whole) / np.log(10)


def _log10_words(sizes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Logarithms of words' chances in their leaves, beyond their shares of the counts,
    learnt from a block's training tokens. Leaves are fitted one by one, small ones together."""
    leaf = columns[2]
    filled = np.maximum(np.cumsum(np.bincount(leaf, minlength=LEAVES)) - 1, 0) // LEAF_SLAB
    # A leaf's training tokens come first, so what they hold has the least numbers.
    group = np.unique(filled, return_inverse=True)[1].astype(np.uint16)[leaf]
    order = np.argsort(group * 2 + ~columns[1], kind="stable")
    out = np.empty(len(leaf))
    for _, cut in _cuts(group[order]):
        at = order[cut]
        train, leaves, _, end, two, _, one, word, c = (x[at] for x in columns[1:])
        where = [x.astype(np.uint64) for x in (leaves, end, one)]
        contexts = [_numbers_of(where[0] << np.uint64(48) | where[1] << np.uint64(32) | where[2])]
        pairs = [_numbers_of(contexts[0].astype(np.uint64) << np.uint64(32) | word)]
        contexts.append(_numbers_of(contexts[0].astype(np.uint64) << np.uint64(16) | two))
        pairs.append(_numbers_of(contexts[1].astype(np.uint64) << np.uint64(32) | pairs[0].astype(np.uint64)))
        n = int(train.sum())
        model = Leaves.fit(n, contexts, pairs, (c[:n] + 1.0) / sizes[leaves[:n]])
        out[at] = model.log10(contexts, pairs)
    return out


SUMS = "chunk bigint, data binary"


def _sum_block(rows: pa.Table, score) -> pa.Table:
    """Sums of a block's scores by chunk and document."""
    rows = rows.sort_by("chunk")
    pieces = [_undealt(x.as_py()) for x in rows["data"]]
    docs = [x[0] for x in pieces]
    columns = [np.concatenate(x) for x in zip(*pieces, strict=True)]
    del pieces
    scores = np.split(score(columns), np.cumsum([len(x) for x in docs])[:-1])
    out = []
    for doc, own in zip(docs, scores, strict=True):
        begins = np.flatnonzero(np.append(True, np.diff(doc) != 0))
        sums = np.add.reduceat(own, begins).astype(np.float32)
        out.append(_packed(_planes(np.diff(doc[begins], prepend=np.int32(0))), _planes(sums)))
    return pa.table({"chunk": rows["chunk"], "data": pa.array(out, pa.binary())})


def _dealt_rows(blocks: Blocks, row: dict, counts: np.ndarray | None = None) -> dict[str, pa.Array]:
    found = list(_dealt(blocks, row, counts))
    return {
        "block": pa.array([k for k, _ in found], pa.int32()),
        "chunk": pa.array([row["chunk"].as_py()] * len(found), pa.int64()),
        "data": pa.array([x for _, x in found], pa.binary()),
    }


DEALT = "block int, chunk bigint, data binary"


def _by_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.where("kind = 1").select("chunk", "ids", "lengths", "tokens", "words")


def block_sums(chunks: DataFrame, tokens: np.ndarray, words: np.ndarray, blocks: Blocks) -> DataFrame:
    """For each chunk and block, logarithms of the chances of leaves, summed by document.

    Each block of the weight table is one task's own: it gets the tokens of all chunks
    that follow the block's endings, learns from those for training and then scores all.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict(_dealt_rows(blocks, row))

    def learn(rows: pa.Table) -> pa.Table:
        return _sum_block(rows, lambda x: _score_block(_learn_block(tokens, words, x), x))

    dealt = _by_chunk(chunks).mapInArrow(deal, DEALT)
    return dealt.groupBy("block").applyInArrow(learn, SUMS)


def word_sums(
    chunks: DataFrame, counts: DataFrame, tokens: np.ndarray, words: np.ndarray, blocks: Blocks, levels: bool
) -> DataFrame:
    """As ``block_sums``, with the words' chances in their leaves beyond their shares of the
    counts, and without those of leaves unless ``levels``. A block gets all that follows its
    words."""
    sizes = Model.blank(tokens, words, 1).sizes

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        return pa.table(_dealt_rows(blocks, row, _chunk_counts(row, right["data"].to_pylist())))

    def score(columns: list[np.ndarray]) -> np.ndarray:
        out = _log10_words(sizes, columns)
        if levels:
            out += _score_block(_learn_block(tokens, words, columns), columns)
        return out

    def learn(rows: pa.Table) -> pa.Table:
        return _sum_block(rows, score)

    own = _by_chunk(chunks).groupBy("chunk").cogroup(counts.select("chunk", "data").groupBy("chunk"))
    return own.applyInArrow(deal, DEALT).groupBy("block").applyInArrow(learn, SUMS)


RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "base_score double, score double"
)


def _chunk_counts(row: dict, counts: list) -> np.ndarray:
    """Counts of a chunk's words by their numbers there."""
    c = np.zeros(len(Words.unpacked(row["words"].as_py()).h), np.int64)
    for data in counts:
        numbers, own = _unpacked(data)
        c[np.cumsum(_unplaned(numbers, np.int32))] = _unplaned(own, np.int64)
    return c


def _document_scores(model: Model, row: dict, counts: list, levels: bool) -> pa.Table:
    """Scores of a chunk's documents from its row and its words' counts; without ``levels``
    those of leaves are left to blocks."""
    ids, lengths = row["ids"].as_py(), row["lengths"].values.to_numpy()
    words = Words.unpacked(row["words"].as_py())
    tokens = _chunk_tokens(row, words)
    c = _chunk_counts(row, counts)
    first = np.cumsum(lengths) - lengths
    more = np.log10(c + 1.0)
    everything = float(np.log10(model.tokens.sum() + model.words.sum() + 1.0))
    leaf = more - np.log10(model.sizes.astype(np.float64))[words.leaf]

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first)

    score = leaf[tokens]
    if levels:
        score += _log10_leaves(model.levels_of(words, tokens, first))
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array([_is_held_out(d) for d in ids], pa.bool_()),
            "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(total((c > 0).astype(np.int64)[tokens]), pa.int64()),
            "base_score": pa.array(total(more[tokens] - everything)),
            "score": pa.array(total(score)),
        }
    )


def fit(chunks: DataFrame, counts: DataFrame) -> Model:
    return train(chunks, *leaf_sums(counts))


def score_documents(docs: DataFrame, to_words: bool = False) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Words are leaves' members in a tree of classes: a word's ending gives its branch at the
    root, its beginning that at the next level. A token's chance is the product of the
    softmax chances of its branches, from the model's features of the three words before,
    and its share of its leaf, by training counts of one more than each word's; one place
    in each leaf is for all words that training hasn't seen. The branches' biases are their
    counts, so without weights the model is the smoothed counts. ``base_score`` is the same
    sum for smoothed counts alone.

    With ``to_words`` the model goes down to the words: the last factor is no share but a
    softmax over all of the leaf's words, whose biases are their shares and whose features
    are the word before and that with the ending of the one before it (``Leaves``).

    Words within ``MOST_ROWS`` share one table of weights: all tasks learn it together. With
    more words there are as many blocks of ``MOST_ROWS`` rows as give each word a row: what
    follows some endings is one block's, so the table grows with the words and no place holds
    it whole. Features of one word before or two have their rows in one block; those that
    skip a word have some in each block. An ending's tokens beyond a block's are dealt to
    several by chunk, with ``to_words`` by the word before. Leaves' softmaxes have a weight
    for each word that follows another, in blocks too, whatever the number of words.

    Documents are tokenized once, into chunks that keep their tokens. Counts cover all
    training rows: a chunk sends its distinct words by bucket, and gets the counts back.

    A null or empty text is the end token alone. A null doc_id is no reason to be held
    out. Rows alike are scored and counted as often as they occur. Without training rows
    all counts are zero. An empty table gives no rows; other columns play no role.
    """
    chunks = stored(chunked(docs))
    counts = stored(word_counts(chunks))
    tokens, words = leaf_sums(counts)
    n_words = int(words.sum())
    few = n_words <= MOST_ROWS
    model = train(chunks, tokens, words) if few else Model.blank(tokens, words, 1)
    if few and not to_words:
        return scored(chunks, counts, model)
    blocks = Blocks.of(_sums(counts, "endings", ENDINGS), n_words)
    if to_words:
        sums = word_sums(chunks, counts, tokens, words, blocks, levels=not few)
    else:
        sums = block_sums(chunks, tokens, words, blocks)
    return scored(chunks, counts, model, sums, levels=few)


def scored(
    chunks: DataFrame,
    counts: DataFrame,
    model: Model,
    sums: DataFrame | None = None,
    levels: bool | None = None,
) -> DataFrame:
    """The documents' scores, chunk by chunk, by a model, by the sums of blocks or, with
    ``levels``, by both."""
    levels = sums is None if levels is None else levels
    whole, places = sums is None, "chunk bigint, nth bigint, "

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        found = _document_scores(model, row, right["data"].to_pylist(), levels)
        if whole:
            return found
        n = found.num_rows
        place = {"chunk": pa.array(np.full(n, row["chunk"].as_py())), "nth": pa.array(np.arange(n))}
        return pa.table(place | dict(zip(found.column_names, found.columns, strict=True)))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("nth")
        score = left["score"].to_numpy().copy()
        for data in right["data"].to_pylist():
            doc, own = _unpacked(data)
            score[np.cumsum(_unplaned(doc, np.int32))] += _unplaned(own, np.float32)
        found = left.select(left.column_names[2:-1])
        return found.append_column("score", pa.array(score))

    # Blocks deal by the same rows of chunks and counts, so one shuffle serves both.
    own = _by_chunk(chunks).groupBy("chunk").cogroup(counts.select("chunk", "data").groupBy("chunk"))
    found = own.applyInArrow(score, RESULT if whole else places + RESULT)
    if not whole:
        found = found.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(add, RESULT)
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(model.tokens.sum())).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
