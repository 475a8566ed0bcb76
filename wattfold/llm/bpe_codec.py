"""Byte-level BPE by merge replay over a shard's distinct words, and its inverse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattfold.llm.common import id_and_text, slabs
from wattfold.llm.pretokens import ranks, split

#: Words that a worker remembers from slab to slab; beyond it the table is begun anew.
REMEMBERED = 250_000
NONE = 1 << 60
END, GONE = -1, -2


class _State:
    """Symbols, their neighbours, and the index from a merge to the places of its pair."""

    def __init__(self, token: np.ndarray):
        self.token = token
        self.right = np.arange(1, len(token) + 1)
        self.left = np.arange(-1, len(token) - 1)
        self.merge = np.full(len(token), NONE)
        self.word = np.cumsum(token == END)
        self.places: dict[int, list[np.ndarray]] = {}

    def begin(self, replay: Replay) -> list[int]:
        self.merge[:-1] = replay._merge(self.token[:-1], self.token[1:])
        heap: list[int] = []
        self._enter(np.flatnonzero(self.merge != NONE), heap)
        return heap

    def _enter(self, at: np.ndarray, heap: list[int]) -> None:
        if not len(at):
            return
        rank = self.merge[at]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        begins = [0, *cuts.tolist(), len(at)]
        for r, a, b in zip(rank[begins[:-1]].tolist(), begins, begins[1:], strict=False):
            if r in self.places:
                self.places[r].append(at[a:b])
            else:
                self.places[r] = [at[a:b]]
                heappush(heap, r)

    def apply(self, replay: Replay, rank: int, heap: list[int]) -> None:
        """One merge at all its places, as far as each word would take them on its own.

        A word takes its merges from the left. Of places that touch, every second one is
        gone by then. Only a lower merge that arises beside a place comes before the places
        behind it; those wait.
        """
        at = np.unique(np.concatenate(self.places.pop(rank)))
        at = at[self.merge[at] == rank]
        if not len(at):
            return
        chain = np.flatnonzero(np.append(True, self.right[at[:-1]] != at[1:]))
        nth = np.arange(len(at)) - np.repeat(chain, np.diff(np.append(chain, len(at))))
        own = at[nth % 2 == 0]
        late = self._after_lower(replay, rank, own)
        if late is not None:
            at_word = self.word[at]
            self._put(rank, at[at > late[at_word]], heap)
            own = own[own <= late[self.word[own]]]
        gone = self.right[own]
        after = self.right[gone]
        self.token[own], self.token[gone] = rank, GONE
        self.right[own], self.left[after] = after, own
        self.merge[gone] = NONE
        before = self.left[own]
        made = np.full(len(own), rank)
        # Before the first symbol of all stands the last one, which is an end.
        self.merge[before] = replay._merge(self.token[before], made)
        self.merge[own] = replay._merge(made, self.token[after])
        near = np.unique(np.concatenate([own, before]))
        self._enter(near[self.merge[near] != NONE], heap)

    def _after_lower(self, replay: Replay, rank: int, own: np.ndarray) -> np.ndarray | None:
        """The place in each word at which a lower merge arises, or None if nowhere.

        At that time places to the left are merged and places to the right are not.
        """
        gone, before = self.right[own], self.left[own]
        made = np.full(len(own), rank)
        left = self.token[before]
        left[1:][before[1:] == gone[:-1]] = rank
        arises = np.minimum(
            replay._merge(made, self.token[self.right[gone]]), replay._merge(left, made)
        )
        bad = own[arises < rank]
        if not len(bad):
            return None
        last = np.full(self.word[-1] + 1, len(self.token))
        np.minimum.at(last, self.word[bad], bad)
        return last

    def _put(self, rank: int, at: np.ndarray, heap: list[int]) -> None:
        if len(at):
            self.places[rank] = [at]
            heappush(heap, rank)


class Replay:
    """A vocabulary's merges, replayed over many distinct words at once."""

    def __init__(self, rank_file: str):
        self.rank = ranks(rank_file)
        self.bytes_of = {i: token for token, i in self.rank.items()}
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted(
            (self.rank[a] << 32 | self.rank[b], i)
            for token, i in self.rank.items()
            for a, b in ((token[:k], token[k:]) for k in range(1, len(token)))
            if a in self.rank and b in self.rank
        )
        self.pair = np.array([key for key, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NONE."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.pair[at] == key), self.made[at], NONE)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; a word that is a token is that token.

        All other words lie in one row of symbols. The index holds, for each merge, the
        places of its pair. The lowest merge is applied at all its places, and each place
        touches only the pairs beside it, which enter the index under their own merges.
        """
        whole = [self.rank.get(word) for word in words]
        rows = [word for word, known in zip(words, whole, strict=True) if known is None]
        # The byte 0 after each word holds its place; it becomes the end mark.
        data = np.frombuffer(b"".join(word + b"\0" for word in rows), np.uint8)
        ends = np.cumsum([len(word) + 1 for word in rows], dtype=np.int64) - 1
        token = self.first[data]
        token[ends] = END
        state = _State(token)
        heap = state.begin(self)
        while heap:
            state.apply(self, heappop(heap), heap)
        kept = token >= 0
        ids, upto = token[kept], np.cumsum(kept)[ends]
        parts = iter(np.split(ids, upto[:-1]) if rows else [])
        return [next(parts) if known is None else np.array([known]) for known in whole]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def _replay(rank_file: str) -> tuple[Replay, dict[str, bytes]]:
    return Replay(rank_file), {}


def encode_decode(docs: DataFrame, rank_file: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, the ``ids``.

    A task is a shard of the corpus. Of each slab of its documents, the words that the
    worker doesn't know yet go through one merge replay; documents are then put together
    from their words' ids. Nothing is shuffled and the only shared data are the ranks.

    A null text is empty: no ids. A text is encoded whole, without special tokens. A null
    ``doc_id`` stays null, equal rows give equal rows, an empty table gives none; other
    columns play no role.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, known = _replay(rank_file)
        for doc_ids, texts in slabs(batches):
            if len(known) > REMEMBERED:
                known.clear()
            words = [split(text) for text in texts]
            new = list({w for own in words for w in own if w not in known})
            for word, ids in zip(new, replay.encode([w.encode() for w in new]), strict=True):
                known[word] = ids.astype("<u4").tobytes()
            n, ids_sha, text_sha, kept = [], [], [], []
            for own in words:
                data = b"".join(map(known.__getitem__, own))
                ids = np.frombuffer(data, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(data).hexdigest())
                text_sha.append(hashlib.sha256(replay.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [doc_ids, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs).mapInArrow(code, schema + (", ids array<bigint>" if keep_ids else ""))
