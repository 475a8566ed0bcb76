"""Token operators and scores against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, no_documents, texts, unique_documents, words
from wattfold.llm.bpe_codec import Replay, encode_decode
from wattfold.llm.maxent import score_documents
from wattfold.llm.packing import pack_documents, pack_sizes
from wattfold.llm.pretokens import ranks, split
from wattfold.llm.queries import RANKS_50K, RANKS_MULTI, op3_bpe_codec, op4_token_counts
from wattfold.llm.token_counts import token_counts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def multi():
    return tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(RANKS_MULTI), special_tokens={}
    )


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def table(spark, docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_split_is_that_of_the_pattern():
    import regex

    for text in texts():
        assert split(text or "") == regex.findall(public_tokenizers.PATTERN, text or "")


def test_replay_is_the_library(multi):
    own = sorted({w for t in [*texts(), words(5, 3000)] for w in split(t or "")})
    own += ["abab" * 40, "a" * 333, "----====" * 30]
    found = Replay(RANKS_MULTI).encode([w.encode() for w in own])
    assert [x.tolist() for x in found] == [multi.encode_ordinary(w) for w in own]
    assert Replay(RANKS_MULTI).encode([]) == []


def expected_codes(multi, text):
    ids = multi.encode_ordinary(text)
    sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return len(ids), sha, hashlib.sha256(text.encode()).hexdigest()


def test_codec(spark, multi):
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for docs, got in (
        (documents(spark), encode_decode(documents(spark, clashing=True), RANKS_MULTI)),
        (spark.read.parquet(f"{SF_DIR}/documents.parquet"), op3_bpe_codec(spark, SF_DIR)),
    ):
        want = Counter((i, *expected_codes(multi, t)) for i, t in table(spark, docs))
        assert rows(got, *columns) == want


def test_codec_returns_its_ids(spark, multi):
    got = encode_decode(unique_documents(spark), RANKS_MULTI, keep_ids=True).collect()
    want = {i: multi.encode_ordinary(t) for i, t in table(spark, unique_documents(spark))}
    assert {r.doc_id: list(r.ids) for r in got} == want


def test_counts(spark, tokenizer):
    def n(text):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)

    docs = documents(spark)
    want = Counter((i, len(t.encode()), n(t)) for i, t in table(spark, docs))
    got = token_counts(documents(spark, clashing=True), RANKS_50K)
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == want
    whole = table(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    want = Counter((i, len(t.encode()), n(t), n(t) > 1024) for i, t in whole)
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows(op4_token_counts(spark, SF_DIR), *columns) == want


def test_empty_tables(spark):
    none = no_documents(spark)
    assert encode_decode(none, RANKS_MULTI).count() == 0
    assert token_counts(none, RANKS_50K).count() == 0
    assert pack_documents(none, RANKS_50K).count() == 0
    assert score_documents(none).count() == 0


def check_packing(tokenizer, docs, got, capacity):
    want = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            size = (len(ids) - start - 1) % capacity + 1 if start == 0 else capacity
            data = np.array(ids[start : start + size], "<u4").tobytes()
            want[i, piece, start, size, zlib.crc32(data)] += 1
            start, piece = start + size, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing(spark, tokenizer):
    docs = documents(spark, clashing=True)
    got = pack_documents(docs, RANKS_50K).collect()
    used, least = check_packing(tokenizer, table(spark, docs), got, 2048)
    assert used <= least + 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pack_documents(docs, RANKS_50K, capacity=512).collect()
    used, least = check_packing(tokenizer, table(spark, docs), got, 512)
    assert used <= 1.02 * least


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    sizes = rng.integers(500, 1100, 1200).tolist()
    plain, searched = pack_sizes(sizes, 2048, passes=0), pack_sizes(sizes, 2048, passes=30)
    assert len(searched) < len(plain)
    for own in searched:
        assert sum(sizes[i] for i in own) <= 2048
    assert sorted(i for own in searched for i in own) == list(range(1200))
    assert pack_sizes([], 2048) == []


def test_local_search_of_a_full_shard():
    """With the defaults, on pieces of which best fit pairs up the large ones."""
    sizes = np.random.default_rng(3).integers(600, 801, 20_000).tolist()
    plain, searched = pack_sizes(sizes, 2048, passes=0), pack_sizes(sizes, 2048)
    assert sorted(i for own in searched for i in own) == list(range(20_000))
    assert max(sum(sizes[i] for i in own) for own in searched) <= 2048
    assert len(searched) < 0.95 * len(plain)


def test_local_search_ends_where_no_exchange_is_left():
    rng = np.random.default_rng(6)
    for low, high, n in ((500, 1100, 40), (600, 801, 60), (20, 700, 120)):
        sizes = rng.integers(low, high, n).tolist()
        bins = [[sizes[i] for i in own] for own in pack_sizes(sizes, 2048)]
        if len(bins) == -(-sum(sizes) // 2048):
            continue
        groups = [{0, *own, *(x + y for k, x in enumerate(own) for y in own[:k])} for own in bins]
        for a, x in enumerate(bins):
            for b, y in enumerate(bins):
                gains = {s - t for s in groups[a] for t in groups[b] if s > t and a != b}
                fits = [d for d in gains if sum(y) + d <= 2048]
                assert all(sum(y) + d <= sum(x) for d in fits)


def lm_tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def check_scores(docs, got):
    count = Counter(w for i, t in docs if not held(i) for w in lm_tokens(t))
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for i, t in docs:
        own = lm_tokens(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        want[i, held(i), len(own), sum(count[w] > 0 for w in own), n].append(base)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens].append(r.base_score)
        assert r.score < 0
    assert found.keys() == want.keys()
    for key, scores in want.items():
        assert np.allclose(sorted(scores), sorted(found[key]), rtol=1e-9)


def test_scores(spark):
    docs = documents(spark, clashing=True)
    check_scores(table(spark, docs), score_documents(docs).collect())


def test_scores_of_a_text_with_very_many_words(spark):
    """More distinct words in a chunk than 20 bits can number."""
    many = [f"{i * 7919 % 10**7:x}" for i in range(1_150_000)]
    training = [i for i in range(20) if not held(i)]
    rows = list(zip(training, [" ".join(many), " ".join(many[-9:] * 3), "only here"], strict=False))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert len(set(many)) > 1_100_000
    check_scores(rows, score_documents(docs).collect())


def test_model_beats_plain_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_documents(docs).collect()
    check_scores(table(spark, docs), got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_a_chance_sum_to_one():
    """Classes times words in a class, with one place for unseen words in each."""
    from wattfold.llm import maxent

    h = np.arange(5, dtype=np.uint64)
    weights = np.random.default_rng(0).normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    shares = maxent._shares(weights, np.zeros(maxent.CLASSES, np.float32), maxent._features(h, np.zeros(1, int)))
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-5)


def test_no_training_rows(spark):
    ids = [i for i in range(40) if held(i)]
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    got = score_documents(docs).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * len(ids)
