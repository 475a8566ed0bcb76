"""Words of a megabyte, and vocabularies in which a merge makes way for a lower one."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.fixtures import texts as fixture_texts
from wattfold.llm.bpe_codec import Replay, encode_decode
from wattfold.llm.minhash import near_duplicates
from wattfold.llm.packing import _long_ids, pack_documents
from wattfold.llm.pretokens import ranks
from wattfold.llm.queries import RANKS_50K, RANKS_MULTI
from wattfold.llm.token_counts import token_counts


def long_words():
    rng = random.Random(7)
    mb = 1_000_000
    return {
        "one letter": "a" * mb,
        "blanks": " " * mb,
        "letters": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=mb)),
        "two letters": "".join(rng.choices("ab", k=mb)),
    }


def library(rank_file, pattern):
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks(rank_file), special_tokens={})


@pytest.mark.parametrize("name", sorted(long_words()))
def test_replay_of_a_megabyte(name):
    word = long_words()[name]
    replay = Replay(RANKS_MULTI)
    start = time.process_time()
    (ids,) = replay.encode([word.encode()])
    assert time.process_time() - start < 30
    assert ids.tolist() == library(RANKS_MULTI, r"(?s).+").encode_ordinary(word)
    assert replay.decode(ids.tolist()) == word.encode()


def test_replay_where_a_lower_merge_arises(tmp_path):
    """Random vocabularies: a token may rank below the parts that it is made of."""
    for seed in range(60):
        rng = random.Random(seed)
        tokens = [bytes([i]) for i in range(256)]
        while len(tokens) < 290:
            token = bytes(rng.choices(b"abc", k=rng.randint(2, 5)))
            if token not in tokens:
                tokens.append(token)
        path = tmp_path / f"{seed}.txt"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        own = ["".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(30)] + ["a" * 50, "ab" * 20]
        want = [library(str(path), r"(?s).+").encode_ordinary(w) for w in own]
        assert [x.tolist() for x in Replay(str(path)).encode([w.encode() for w in own])] == want


def test_operators_on_long_words(spark):
    texts = list(long_words().values())
    docs = spark.createDataFrame(list(enumerate([*texts, texts[2]])), "doc_id bigint, text string")
    # Each text is one match of the pattern; on blanks the library's pattern engine gives up.
    multi = library(RANKS_MULTI, r"(?s).+")
    for r in encode_decode(docs, RANKS_MULTI).collect():
        ids = np.array(multi.encode_ordinary([*texts, texts[2]][r.doc_id]), "<u4")
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256([*texts, texts[2]][r.doc_id].encode()).hexdigest()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    mixed = "".join(t or "" for t in fixture_texts())
    assert _long_ids(mixed, RANKS_50K) == tokenizer.encode(mixed, add_special_tokens=False).ids
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, RANKS_50K).collect()}
    assert got == want | {4: want[2]}
    pieces = pack_documents(docs, RANKS_50K).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] - 1 for r in pieces} == got
    near = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
