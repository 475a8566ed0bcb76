"""Token counts from the frequencies of distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattfold.llm.common import id_and_text, slabs
from wattfold.llm.pretokens import split, word_encoding

#: Distinct pre-tokens that a worker remembers from slab to slab. Beyond it, the table is
#: begun anew; the counts don't change.
REMEMBERED = 300_000
SPECIAL = "<|endoftext|>"


class _Pieces(dict):
    """Pieces of a pre-token, counted when it is met first."""

    def __init__(self, rank_file: str):
        self.encoding = word_encoding(rank_file)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.encoding.encode_ordinary(word))
        return n


@cache
def _pieces(rank_file: str) -> _Pieces:
    return _Pieces(rank_file)


def token_counts(docs: DataFrame, rank_file: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row.

    Within a slab of documents the frequencies of pre-tokens are rows (document, word,
    n); each distinct word's pieces are counted once, joined to those rows by the word's
    number, and summed by document. Nothing is shuffled: most words of a corpus are rare,
    so (document, word) rows would move more bytes than the texts have.

    A null text is empty: 0 bytes, 0 tokens. The special string inside a text counts as
    one token and splits the text, as in the tokenizer library. A null ``doc_id`` stays
    null, equal rows give equal rows, an empty table gives none; other columns play no
    role.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(rank_file)
        for doc_ids, texts in slabs(batches):
            if len(pieces) > REMEMBERED:
                pieces.clear()
            numbers: dict[str, int] = {}
            word, n, rows = [], [], np.zeros(len(texts), np.int64)
            extra = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                parts = text.split(SPECIAL)
                extra[i] = len(parts) - 1
                found = Counter(split(parts[0]))
                for part in parts[1:]:
                    found.update(split(part))
                rows[i] = len(found)
                word.append(
                    np.fromiter(
                        (numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)
                    )
                )
                n.append(np.fromiter(found.values(), np.int64, len(found)))
            each = np.fromiter(map(pieces.__getitem__, numbers), np.int64, len(numbers))
            doc = np.repeat(np.arange(len(texts)), rows)
            joined = np.concatenate(n) * each[np.concatenate(word)]
            tokens = np.zeros(len(texts), np.int64)
            np.add.at(tokens, doc, joined)
            sizes = [len(text.encode()) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(sizes, pa.int64()), pa.array(tokens + extra)],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint"
    return id_and_text(docs).mapInArrow(count, schema)
