"""Words within their leaves: a softmax over all of a leaf's words."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_maxent import corpus
from tests.llm.test_texts import check_scores, held, lm_tokens, table
from wattfold.llm import maxent
from wattfold.llm.maxent import ENDINGS, LEAVES, Blocks, Words, score_documents
from wattfold.llm.queries import op8_maxent_scores


def by_definition(tokens):
    """Each token's chance in its leaf, over its share: ``tokens`` are (training, leaf, word,
    share, features), and every training word of a leaf takes part in its softmax."""
    share, met = defaultdict(dict), Counter()
    for train, leaf, word, q, features in tokens:
        if train:
            share[leaf][word] = q
            met.update((leaf, f, word) for f in features)
    weights = dict.fromkeys(met, 0.0)

    def shifts(leaf, features):
        by = {w: math.exp(sum(weights.get((leaf, f, w), 0.0) for f in features)) for w in share[leaf]}
        return by, 1 + sum(share[leaf][w] * (x - 1) for w, x in by.items())

    for _ in range(maxent.LEAF_STEPS):
        expected = Counter()
        for train, leaf, _, _, features in tokens:
            if train:
                by, whole = shifts(leaf, features)
                for w, x in by.items():
                    for f in features:
                        expected[leaf, f, w] += share[leaf][w] * x / whole
        for k, w in weights.items():
            step = met[k] - expected[k] - maxent.COST * w
            weights[k] = w + step / (max(met[k], expected[k]) + maxent.COST) / 2
    out = []
    for _, leaf, word, _, features in tokens:
        by, whole = shifts(leaf, features)
        out.append(math.log10(by.get(word, 1.0) / whole))
    return np.array(out)


def columns(rng, n, vocabulary=9):
    """A block's tokens of few words and contexts; the last are not for training."""
    train = np.arange(n) < n * 3 // 4
    leaf = rng.integers(0, 4, n).astype(np.uint8) * 5
    one = rng.integers(1, 4, n).astype(np.uint32)
    end, two = one.astype(np.uint16) % 2, rng.integers(0, 3, n).astype(np.uint16)
    # The first of a leaf's words is often the one that the context announces.
    word = np.where(rng.random(n) < 0.5, one + two, rng.integers(0, vocabulary, n)).astype(np.uint32)
    count = Counter(zip(leaf[train], word[train], strict=True))
    c = np.array([count[x] for x in zip(leaf, word, strict=True)], np.float32)
    sizes = np.ones(LEAVES, np.int64)
    for (x, _), m in count.items():
        sizes[x] += m + 1
    # Rows in any order: training ones need not come first.
    order = rng.permutation(n)
    doc = np.zeros(n, np.int32)
    found = [doc, train, leaf, one.astype(np.uint16), end, two, two, one, word, c]
    return sizes, [x[order] for x in found]


@pytest.mark.parametrize("slab", [1, 100, 1 << 16])
def test_chances_in_a_leaf_by_definition(slab, monkeypatch):
    monkeypatch.setattr(maxent, "LEAF_SLAB", slab)
    sizes, cols = columns(np.random.default_rng(1), 240)
    _, train, leaf, _, end, two, _, one, word, c = cols
    tokens = [
        (bool(t), int(x), int(w), (k + 1) / sizes[x], ((int(e), int(o)), (int(e), int(o), int(s))))
        for t, x, w, k, e, o, s in zip(train, leaf, word, c, end, one, two, strict=True)
    ]
    want = by_definition(tokens)
    assert np.abs(want).max() > 0.3
    assert np.allclose(maxent._log10_words(sizes, cols), want, atol=1e-6)


def test_chances_of_a_leafs_words_sum_to_one():
    sizes, cols = columns(np.random.default_rng(2), 400)
    _, train, leaf, _, end, two, _, one, word, c = cols
    count = {(x, w): k for t, x, w, k in zip(train, leaf, word, c, strict=True) if t}
    contexts = sorted(set(zip(leaf, end, one, two, strict=True)))
    asked = [(*x, w, k) for x in contexts for (at, w), k in count.items() if at == x[0]]
    asked += [(*x, 999, 0) for x in contexts]  # the place for unseen words
    x, e, o, s, w, k = (np.array(v) for v in zip(*asked, strict=True))
    more = [np.zeros(len(x)), np.zeros(len(x), bool), x, o, e, s, s, o, w, k]
    both = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(cols, more, strict=True)]
    out = maxent._log10_words(sizes, both)[len(leaf) :]
    total = Counter()
    for a, score in zip(asked, out, strict=True):
        total[a[:4]] += (a[5] + 1) / sizes[a[0]] * 10**score
    assert len(total) == len(contexts)
    assert np.allclose(list(total.values()), 1)


def test_no_training_tokens_leave_shares():
    sizes, cols = columns(np.random.default_rng(3), 40)
    cols[1] = np.zeros(40, bool)
    assert not maxent._log10_words(sizes, cols).any()


def within(rows):
    """Sums over each document's tokens of the logarithms beyond shares, all in one block."""
    count = Counter(w for i, t in rows if not held(i) for w in lm_tokens(t))

    def key(word):
        own = Words.of([word.encode()])
        return int(own.ending[0]), int(own.leaf[0])

    sizes = Counter()
    for w, n in count.items():
        sizes[key(w)[1]] += n + 1
    tokens, lengths = [], []
    for i, t in rows:
        words = lm_tokens(t)
        lengths.append(len(words))
        padded = [None, None, *words]
        for w, one, two in zip(words, padded[1:], padded, strict=False):
            leaf = key(w)[1]
            features = (one,), (one, two if two is None else key(two)[0])
            tokens.append((not held(i), leaf, w, (count[w] + 1) / (sizes[leaf] + 1), features))
    out = by_definition(tokens)
    return [x.sum() for x in np.split(out, np.cumsum(lengths)[:-1])]


def test_scores_to_words_by_definition(spark):
    rng = np.random.default_rng(6)
    word = [f"ab{i}yz" for i in range(12)] + ["of", "the", "ßa", "x\ty"]
    rows = [(i, " ".join(rng.choice(word, rng.integers(0, 12)))) for i in range(60)]
    rows += [(None, None), (None, "ab1yz of"), (7, rows[7][1]), (2**40, "of of unseen")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    rows = table(spark, docs)
    got = score_documents(docs, to_words=True).collect()
    check_scores(rows, got)
    base = Counter((r.doc_id, r.n_tokens, round(r.score, 2)) for r in score_documents(docs).collect())
    want = sorted(((i is None, i or 0, x) for (i, _), x in zip(rows, within(rows), strict=True)))
    plain = defaultdict(list)
    for (i, n, s), k in base.items():
        plain[i, n] += [s] * k
    gains = []
    for r in got:
        # Rows that share id and length are told apart by the nearest sum.
        gains.append((r.doc_id is None, r.doc_id or 0, r.score, plain[r.doc_id, r.n_tokens]))
    for missing, i, x in want:
        assert any(
            (m, j) == (missing, i) and any(abs(score - p - x) < 0.02 for p in ps) for m, j, score, ps in gains
        )
    assert max(x for _, _, x in want) > 0.5


def announced(i):
    """A document whose words share a leaf, each after the word that announces it."""
    rng = np.random.default_rng(i)
    return " ".join(f"k{x} ab{x}yz" for x in rng.integers(0, 50, 60))


def gain(rows):
    out = [r for r in rows if r.held_out]
    return sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)


def test_query_tells_words_of_a_leaf_apart(spark, tmp_path):
    """Fifty words of one leaf are known by the word before; shares alone can't tell them."""
    docs = spark.createDataFrame([(i, announced(i)) for i in range(150)], "doc_id bigint, text string")
    assert len({int(Words.of([f"ab{x}yz".encode()]).leaf[0]) for x in range(50)}) == 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_maxent_scores(spark, str(tmp_path)).collect()
    check_scores(table(spark, docs), got)
    assert gain(got) > gain(score_documents(docs).collect()) + 0.5


def test_query_of_more_words_than_a_table_has_rows(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_maxent_scores(spark, str(tmp_path)).collect()
    check_scores(table(spark, docs), got)
    assert gain(got) > 0.2


def test_all_that_follows_a_word_is_in_one_block():
    rng = np.random.default_rng(8)
    endings = np.zeros(ENDINGS, np.int64)
    endings[5], endings[6] = 10**8, 10
    blocks = Blocks.of(endings, 10**4)
    assert blocks.parts[1] > 10
    n = 200_000
    h = rng.integers(0, 1000, n).astype(np.uint64)
    ends = [np.where(h % 10 == 0, 0, 1), *rng.integers(0, 90, (2, n)).astype(np.uint64)]
    for chunk in (1, (3 << 32) + 8):
        rare = blocks.by_word(h, np.full(n, 1000, np.uint64), ends, chunk)
        of = defaultdict(set)
        for x, b in zip(h[ends[0] == 1], rare[ends[0] == 1], strict=True):
            of[x].add(b)
        assert {len(x) for x in of.values()} == {1} and len(set().union(*of.values())) == blocks.parts[1]
    # A word of more tokens than a block has several, by the two endings before it.
    often = blocks.by_word(h * 0, np.full(n, 5 * 10**7, np.uint64), ends, 1)[ends[0] == 1]
    size = np.bincount(often - blocks.block[1], minlength=blocks.parts[1])
    assert size.min() > 0 and size.max() < 2 * size.mean()
    assert (often == blocks.by_word(h * 0, np.full(n, 5 * 10**7, np.uint64), ends, 9)[ends[0] == 1]).all()


def test_hashes_of_words_keep_32_bits():
    words = [f"w{i}".encode() for i in range(1000)]
    own = Words.of(words)
    again = Words.unpacked(own.packed())
    assert (again.h == [xxhash.xxh32_intdigest(w) for w in words]).all() and (again.key == own.key).all()
