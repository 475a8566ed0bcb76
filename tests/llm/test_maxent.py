"""The language model's chances, one context and one word at a time."""

import math
from collections import Counter

import numpy as np
import xxhash

from tests.llm.fixtures import documents
from tests.llm.test_texts import held, lm_tokens, table
from wattfold.llm import maxent
from wattfold.llm.common import stored
from wattfold.llm.maxent import CLASSES, LEAVES, Model, chunked, fit, leaf_sums, score_documents, scored, word_counts

M = 2**64 - 1


def path(word):
    h = [xxhash.xxh32_intdigest(w, seed=s) for w, s in ((word[-2:], 1), (word[:2], 2))]
    return h[0] % CLASSES, h[1] % CLASSES, h[0] & 0xFFF


def chance(model, before, word, count):
    """Of a word after three others, by the definition."""
    odd, even = int(maxent.ODD), int(maxent.EVEN)
    rows = model.weights.shape[1]
    end = [0 if w is None else path(w)[2] for w in before]
    h = 0 if before[0] is None else xxhash.xxh32_intdigest(before[0]) & 0xFFFF
    contexts = [h * odd + 1, (end[0] * odd + end[1]) * even, (end[1] * even + end[2]) * odd]
    own = path(word)[:2]
    out, above = 1.0, 0
    for level in range(2):
        salt = 0 if level == 0 else (above + 1) * even
        sizes = model.sizes.reshape(CLASSES, CLASSES).astype(float)
        bias = sizes.sum(axis=1) if level == 0 else sizes[above]
        logits = np.log(bias)
        for x in contexts:
            x = (x + salt) & M
            row = (((x ^ (x >> 31)) * odd) & M) >> (64 - (rows.bit_length() - 1))
            logits = logits + model.weights[level][row]
        share = np.exp(logits - logits.max())
        out *= share[own[level]] / share.sum()
        above = own[level]
    return out * (count + 1) / model.sizes[own[0] * CLASSES + own[1]]


def contexts(tokens):
    padded = [None] * 3 + tokens
    return [(padded[i + 2], padded[i + 1], padded[i]) for i in range(len(tokens))]


def by_hand(model, docs, count):
    out = Counter()
    for doc_id, text in docs:
        tokens = [w.encode() for w in lm_tokens(text)]
        score = sum(math.log10(chance(model, b, w, count[w])) for b, w in zip(contexts(tokens), tokens, strict=True))
        out[doc_id, round(score, 2)] += 1
    return out


def small(spark):
    docs = documents(spark).where("length(text) < 5000 or text is null")
    chunks = stored(chunked(docs))
    counts = stored(word_counts(chunks))
    rows = table(spark, docs)
    count = Counter(w.encode() for i, t in rows if not held(i) for w in lm_tokens(t))
    return rows, chunks, counts, count


def check(model, rows, chunks, counts, count):
    got = scored(chunks, counts, model).collect()
    want = by_hand(model, rows, count)
    assert len(got) == sum(want.values())
    for doc_id in {r.doc_id for r in got}:
        a = sorted(r.score for r in got if r.doc_id == doc_id)
        b = sorted(s for (i, s), n in want.items() if i == doc_id for _ in range(n))
        assert np.allclose(a, b, atol=0.02, rtol=1e-4)


def test_scores_by_random_weights(spark):
    rows, chunks, counts, count = small(spark)
    tokens, words = leaf_sums(counts)
    assert (tokens.sum(), words.sum()) == (sum(count.values()), len(count))
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(2, maxent.LEAST_ROWS, CLASSES)).astype(np.float32)
    check(Model(weights, tokens, words), rows, chunks, counts, count)


def test_scores_by_the_trained_model(spark):
    rows, chunks, counts, count = small(spark)
    model = fit(chunks, counts)
    assert np.abs(model.weights).max() > 0.1
    check(model, rows, chunks, counts, count)


def test_chances_of_all_words_sum_to_one(spark):
    _, _, counts, count = small(spark)
    tokens, words = leaf_sums(counts)
    rng = np.random.default_rng(5)
    model = Model(rng.normal(size=(2, maxent.LEAST_ROWS, CLASSES)).astype(np.float32), tokens, words)
    for before in [(None, None, None), (b"one", b"two", None), (b"x", "ß".encode(), b"abc")]:
        total = sum(chance(model, before, w, n) for w, n in count.items())
        # A leaf's place for unseen words is worth what a word without a count has there.
        unseen, i = {}, 0
        while len(unseen) < LEAVES and i < 60_000:
            w = xxhash.xxh64_hexdigest(str(i)).encode()
            leaf = path(w)[:2]
            if w not in count and leaf not in unseen:
                unseen[leaf] = chance(model, before, w, 0)
            i += 1
        assert len(unseen) == LEAVES
        assert abs(total + sum(unseen.values()) - 1) < 1e-4


def test_gain_on_held_out_texts(spark):
    got = score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    out = [r for r in got.collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    print("gain a token", gain)
    assert gain > 0.1


def test_table_grows_with_the_words():
    assert [maxent.table_rows(n) for n in (0, 1, 5000, 100_000, 10**9)] == [1 << 12, 1 << 12, 1 << 13, 1 << 15, 1 << 15]


def test_words_travel_by_bucket(spark):
    """A chunk sends its words packed, in no more rows than there are buckets."""
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, None), (None, "w1 w1 w2")], "doc_id bigint, text string")
    chunks = stored(chunked(docs.coalesce(1)))
    assert chunks.where("kind = 0").count() <= 16
    got = {r.doc_id: r for r in score_documents(docs.coalesce(1)).collect()}
    kept = [(i, t) for i, t in table(spark, docs) if not held(i)]
    count = Counter(w for _, t in kept for w in lm_tokens(t))
    for doc_id, t in table(spark, docs):
        assert got[doc_id].n_known == sum(count[w] > 0 for w in lm_tokens(t))
        assert got[doc_id].train_tokens == sum(count.values())


def test_blocks_grow_with_the_words():
    """As many rows as words, whatever their number, and no block of too many tokens."""
    rng = np.random.default_rng(7)
    share = rng.zipf(1.5, maxent.ENDINGS).clip(max=10**4).astype(float)
    for n_words, n_tokens in ((40_000, 400_000), (10**6, 10**8), (10**8, 10**10)):
        endings = (share / share.sum() * n_tokens).astype(np.int64)
        blocks = maxent.Blocks.of(endings, n_words)
        assert len(blocks) * maxent.MOST_ROWS >= n_words
        held_by = np.zeros(len(blocks))
        tokens = np.append(0, np.sort(endings)[::-1])
        for t, b, n in zip(tokens, blocks.block, blocks.parts, strict=True):
            held_by[b : b + n] += t / n
        assert held_by.max() <= 2 * maxent.MOST_TOKENS


def corpus(spark, n=400, width=200):
    """More words than one table has rows, after words that announce what follows."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = rng.integers(0, 10**6, width)
        rows.append((i, " ".join(f"{x % 7}the {x % 7}{x}xx" for x in words)))
    rows += [(None, None), (5, "a b"), (5, "a b"), (-3, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_scores_of_blocks_by_definition(spark):
    docs = corpus(spark)
    chunks = stored(chunked(docs))
    counts = stored(word_counts(chunks))
    tokens, words = leaf_sums(counts)
    rows = table(spark, docs)
    count = Counter(w.encode() for i, t in rows if not held(i) for w in lm_tokens(t))
    assert len(count) > maxent.MOST_ROWS
    blocks = maxent.Blocks.of(maxent._sums(counts, "endings", maxent.ENDINGS), len(count))
    assert len(blocks) > 1
    found = {}
    for row in chunks.where("kind = 1").toArrow().to_pylist():
        names = ("ids", "lengths", "tokens", "words", "chunk")
        own = {k: maxent.pa.scalar(row[k]) for k in names}
        for k, data in maxent._dealt(blocks, own):
            found.setdefault(k, []).append((row["chunk"], maxent._undealt(data)))
    models = {}
    for k, pieces in found.items():
        pieces.sort(key=lambda x: x[0])
        columns = [np.concatenate(x) for x in zip(*[p for _, p in pieces], strict=True)]
        models[k] = maxent._learn_block(tokens, words, columns)
    assert sum(len(p[0]) for x in found.values() for _, p in x) == sum(len(lm_tokens(t)) for _, t in rows)

    def chance_in_block(chunk, before, word):
        code = [0 if w is None else int(blocks.number[path(w)[2]]) for w in before]
        k = blocks.block[code[0]] + chunk % blocks.parts[code[0]]
        model, odd, even = models[int(k)], int(maxent.ODD), int(maxent.EVEN)
        h = 0 if before[0] is None else xxhash.xxh32_intdigest(before[0]) & 0xFFFF
        x = [h * odd + 1, (code[0] * odd + code[1]) * even, (code[1] * even + code[2]) * odd]
        out, above, own = 1.0, 0, path(word)[:2]
        for level in range(2):
            sizes = model.sizes.reshape(CLASSES, CLASSES).astype(float)
            logits = np.log(sizes.sum(axis=1) if level == 0 else sizes[above])
            for y in x:
                y = (y + (0 if level == 0 else (above + 1) * even)) & M
                logits = logits + model.weights[level][(((y ^ (y >> 31)) * odd) & M) >> 49]
            share = np.exp(logits - logits.max())
            out *= share[own[level]] / share.sum()
            above = own[level]
        return out * (count[word] + 1) / model.sizes[own[0] * CLASSES + own[1]]

    got = score_documents(docs).collect()
    assert len(got) == len(rows)
    some = {i for i, _ in rows if i is None or i < 20}
    chunk_of = {i: r.chunk for r in chunks.where("kind = 1").collect() for i in r.ids}
    for doc_id, text in rows:
        if doc_id in some and doc_id != 5:
            words_ = [w.encode() for w in lm_tokens(text)]
            want = sum(
                math.log10(chance_in_block(chunk_of[doc_id], b, w))
                for b, w in zip(contexts(words_), words_, strict=True)
            )
            assert any(abs(r.score - want) < 0.02 for r in got if r.doc_id == doc_id)
    out = [r for r in got if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.2
