"""Repeated strings, near-duplicates and the pipeline against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.fixtures import documents, no_documents, unique_documents, words
from wattfold.llm import minhash
from wattfold.llm.components import components
from wattfold.llm.minhash import near_duplicates
from wattfold.llm.queries import op7_suffix_array_dedup
from wattfold.llm.substring_dedup import repeated_starts, substring_dedup
from wattfold.llm.suffix_array import common_prefixes, suffix_array

SF_DIR = "/root/testdata/sf0.001"


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 5))
        s = rng.integers(0, k, n)
        if trial % 3 == 0 and n:
            s = np.tile(s[: max(1, n // 8)], 12)
        sa, t = suffix_array(s, k), s.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = common_prefixes(s, sa) if len(s) else []
        for q in range(1, len(t)):
            x, y, c = sa[q - 1], sa[q], 0
            while max(x, y) + c < len(t) and t[x + c] == t[y + c] != 0:
                c += 1
            assert shared[q] == c


def test_a_suffix_array_with_many_names():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 3, 40_000)
    sa = suffix_array(s, 3)
    data = s.astype(np.uint8).tobytes()
    picked = [data[i : i + 200] for i in sa[:: 7]]
    assert picked == sorted(picked) and sorted(sa.tolist()) == list(range(len(s)))


def brute_repeats(docs, length):
    """Covered bytes by a dictionary of all strings, documents in the order of their ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = text.encode()
        mask = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                mask[p : p + length] = True
            seen.add(s)
        left = bytes(np.frombuffer(raw, np.uint8)[~mask])
        spans = int((np.diff(np.append(False, mask).astype(int)) == 1).sum())
        out[i] = (len(raw), int(mask.sum()), spans, left)
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 500}, {"anchor_fragments": 1}])
def test_repeats(spark, limits):
    docs = unique_documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = substring_dedup(docs, **limits).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == (
        brute_repeats(rows, 100)
    )


def test_repeats_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = {
        i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in brute_repeats(rows, 100).items()
    }
    assert {r[0]: tuple(r)[1:] for r in op7_suffix_array_dedup(spark, SF_DIR).collect()} == want


def test_repeats_with_odd_rows(spark):
    docs = documents(spark, clashing=True)
    got = substring_dedup(docs)
    assert set(got.columns) == set(docs.columns) | {"n_bytes", "n_removed", "n_spans"}
    found = got.collect()
    assert len(found) == docs.count()
    # Without an id a text stays whole; rows alike get the same.
    assert [r.n_removed for r in found if r.doc_id is None] == [0]
    assert len({(r.n_bytes, r.n_removed) for r in found if r.doc_id == 5}) == 1
    assert substring_dedup(no_documents(spark)).count() == 0


def test_kept_text_holds_no_broken_characters(spark):
    rows = [(1, "é" + "x" * 99 + "tail"), (2, "é" + "x" * 99 + "end"), (3, "ê" + "x" * 99)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in substring_dedup(docs, as_text=True).collect()}
    want = {i: x[3].decode("utf-8", "ignore") for i, x in brute_repeats(rows, 100).items()}
    assert kept == want


def test_a_shard_keeps_the_first_of_equal_strings():
    data = [b"x" * 5 + b"abcdefghij", b"abcdefghij", b"abcdefghij" + b"y"]
    ids, starts, tags = np.array([7, 3, 3]), np.array([0, 40, 10]), np.zeros(3, int)
    fragment, offset = repeated_starts(ids, starts, tags, data, 10)
    assert list(zip(fragment.tolist(), offset.tolist(), strict=True)) == [(0, 5), (1, 0)]


@pytest.mark.parametrize("limits", [{}, {"anchor_fragments": 1}])
def test_repeats_of_a_repeated_row(spark, limits):
    """What only a repeated row holds stays, also around a passage that others share."""
    shared = words(50, 60)
    rows = [(1, f"{words(51, 80)} {shared} {words(52, 80)}")]
    rows += [(2, f"{words(53, 80)} {shared} {words(54, 80)}"), (3, f"{shared} {words(55, 9)}")]
    df = spark.createDataFrame(rows + rows[:2] + rows[1:2], "doc_id bigint, text string")
    got = [
        (r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
        for r in substring_dedup(df, **limits).collect()
    ]
    want = brute_repeats(rows, 100)
    assert sorted(got) == sorted((i, want[i]) for i in (1, 1, 2, 2, 2, 3))


def test_a_shard_takes_fragments_of_a_repeated_row_as_one():
    data = [b"abcdefghij", b"abcdefghij", b"abcdefghij"]
    ids, starts, tags = np.array([3, 5, 3]), np.array([10, 0, 10]), np.array([4, 1, 4])
    fragment, offset = repeated_starts(ids, starts, tags, data, 10)
    assert list(zip(fragment.tolist(), offset.tolist(), strict=True)) == [(1, 0)]


def brute_components(docs, percent=80, width=2):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        own = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        sets[i] = own or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def variants(seed, n, copies, changes):
    """Documents made of others by changing a few words, so that links form chains."""
    import random

    rng = random.Random(seed)
    own = [words(seed, n).split()]
    for _ in range(copies):
        new = list(rng.choice(own))
        for _ in range(changes):
            new[rng.randrange(n)] = f"w{rng.randrange(10**6)}"
        own.append(new)
    return [" ".join(x) for x in own]


def star_of_variants(seed, n, copies):
    """Copies of one document with few or many changed words, close to the threshold."""
    import random

    rng = random.Random(seed)
    base = words(seed, n).split()
    out = [base]
    for _ in range(copies):
        new = list(base)
        for _ in range(rng.randint(1, 8)):
            new[rng.randrange(n)] = rng.choice(["one", "two", f"w{rng.randrange(10**6)}"])
        out.append(new)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("small,apart,others", [(16, 512, 4096), (2, 7, 11)])
def test_near_duplicates(spark, monkeypatch, small, apart, others):
    for name, value in (("SMALL", small), ("APART", apart), ("OTHERS", others)):
        monkeypatch.setattr(minhash, name, value)
    texts = [t for s in range(6) for t in variants(s, 120, 12, 5)] + variants(77, 60, 40, 2)
    texts += star_of_variants(78, 100, 60)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c, _ in got.values()}) < len(rows) / 2


def test_near_duplicates_with_odd_rows(spark):
    docs = unique_documents(spark)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs).collect()} == want
    got = near_duplicates(documents(spark, clashing=True)).collect()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    assert near_duplicates(no_documents(spark)).count() == 0


def test_signature_distance_guarantee():
    """Any two signatures below the distance share a key."""
    rng = np.random.default_rng(5)
    k = minhash.CHUNKS * minhash.CHUNK
    most = minhash.CHUNKS * (minhash.ERRORS + 1) - 1
    import pyarrow as pa

    for _ in range(200):
        a = rng.integers(0, 1 << 16, k).astype(np.uint16)
        b = a.copy()
        at = rng.choice(k, most, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, most).astype(np.uint16)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([0, 1]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], ["rep", "s"]
        )
        (keys,) = minhash._keys(iter([batch]))
        own = {0: set(), 1: set()}
        for slot, key, rep in zip(*(c.to_pylist() for c in keys.columns), strict=True):
            own[rep].add((slot, key))
        assert own[0] & own[1]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)}
    assert components(df.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out, rows = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in out.collect()}
        out = stage(spark, out, SF_DIR).cache()
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in out.collect()}
        if name == "near_dedup":
            want = brute_components(list(before.items()), width=5)
            assert set(rows) == {i for i, x in want.items() if x[2]}
        elif name == "suffix_array_dedup":
            want = brute_repeats([(i, t or "") for i, t in before.items()], 100)
            assert rows == {i: x[3].decode("utf-8", "ignore") for i, x in want.items()}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == set(rows)
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_pipeline_stages_with_odd_rows(spark):
    docs = documents(spark, clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert set(docs.columns) >= set(documents(spark).columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents(spark), SF_DIR).count() == 0


def test_near_dedup_judges_every_text(spark):
    """Rows that share an id or have none, and pairs between two-word and five-word links."""
    base, other, third = words(50, 200), words(51, 150), words(52, 90)
    few, many = base.split(), base.split()
    for i in range(3):
        few[10 + 60 * i] = f"few{i}"
    for i in range(9):
        many[5 + 20 * i] = f"many{i}"
    few, many = " ".join(few), " ".join(many)
    pairs = [(0, base), (1, many)]
    assert not brute_components(pairs)[0] == brute_components(pairs)[1] and brute_components(pairs)[1][1] == 0
    assert brute_components(pairs, width=5)[1][1] == 1
    rows = [(3, base), (3, other), (3, other), (5, few), (6, many), (7, third), (7, base), (None, third), (None, words(53, 80))]
    rows += [(2, few), (9, ""), (9, None), (9, "short text"), (10, "Short  text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_dedup(spark, docs.withColumn("key", F.lit(1)), "")
    assert got.columns == [*docs.columns, "key"]
    got = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(2, few), (3, other), (6, many), (7, third), (None, words(53, 80)), (9, ""), (9, None), (9, "short text")]
    assert got == sorted(want, key=str)
    # Judged one by one: each text under a number of its own, in the order of ids.
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    found = brute_components([(n, rows[i][1]) for n, i in enumerate(order)], width=5)
    assert got == sorted((rows[i] for n, i in enumerate(order) if found[n][2]), key=str)


def test_pipeline_frees_its_scratch(spark):
    import os

    from wattfold.scratch import scratch_dir

    top = os.path.dirname(scratch_dir(spark))
    before = set(os.listdir(top))
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
    # What is left: the last stage's input and its pieces.
    assert len(set(os.listdir(top)) - before) <= 2
