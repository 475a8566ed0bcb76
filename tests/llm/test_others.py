"""Neighbours, chat records, quality rules and licence lines on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, no_documents
from wattfold.llm.chat import (
    TURNS,
    chat_digests,
    field_paths,
    find_layout,
    fingerprint,
    format_chat,
    read_chat,
    turn_rows,
)
from wattfold.llm.licenses import scan_licenses
from wattfold.llm.quality import RULES, cascade_order, quality_verdicts
from wattfold.llm.vptree import VantageTree, nearest_neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int"


def by_brute_force(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = [(-float(np.cumsum(np.float64(x) * np.float64(y))[-1]), i) for i, y in rows if i != q and len(x) == len(y)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


@pytest.mark.parametrize("norms", [1.0, 5.0])
def test_neighbours(spark, norms):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12)) * rng.uniform(1, norms, (600, 1))
    x[200:420] = x[7]  # a third of all rows alike
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    got = nearest_neighbours(df, lambda c: c % 20 == 0, shard_rows=150, query_rows=7).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    assert found == by_brute_force(rows, 20)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 1.0], 1), (1, [2.0, 1.0], 2), (2, None, 1), (3, [], 1)]
    rows += [(4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, inf], 1), (7, [1.0, None], 1)]
    rows += [(None, [1.0, 1.0], 1), (20, [-1.0, 0.5], 1), (8, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("shard", F.lit(1)).withColumn("v", F.lit(2))
    got = nearest_neighbours(df, lambda c: c % 20 == 0).collect()
    want = [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.5)]
    assert sorted(tuple(r) for r in got) == want
    assert nearest_neighbours(df.limit(0), lambda c: c % 20 == 0).count() == 0


def test_a_larger_factor_looks_at_less_and_still_finds_most():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    tree = VantageTree(np.arange(4000), x, leaf=32)
    exact, _ = tree.search(np.arange(100), x[:100], 10, 1.0)
    loose, _ = tree.search(np.arange(100), x[:100], 10, 1.3)
    want = np.argsort(-(x[:100] @ x.T) + 1e9 * (np.arange(100)[:, None] == np.arange(4000)), axis=1)
    assert np.array_equal(exact, want[:, :10])
    assert 0.9 <= np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose, strict=True)])


HARD = ["\\### Assistant: </turn> ok", "a>b<c\\l\\b\\", "</turn>\n<turn user>", "", "😀\n\n", None]


def test_template_is_reversible(spark):
    roles = ["user", "assistant", "<sys>", None]
    rows = [(i, t, roles[(i + t) % 4], HARD[(i * 5 + t) % 6]) for i in range(8) for t in range(6)]
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 0, "assistant", "x"), (9, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("formatted", F.lit("clash")).withColumn("piece", F.lit(0))
    formatted = format_chat(turn_rows(df, "conv_id"))
    got = {r.conv_id: r for r in read_chat(formatted).collect()}
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == own.keys()
    for c, turns in own.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert got[c].loss_text == "".join(x[2] for x in turns if x[1] == "assistant")
    assert chat_digests(format_chat(turn_rows(df.limit(0), "conv_id"))).count() == 0


LAYOUTS = [
    ("prompt string, response string", ("q", "a"), [("user", "q"), ("assistant", "a")]),
    ("prompt string, completion string", (None, "a"), [("user", ""), ("assistant", "a")]),
    (
        "instruction string, input string, output string",
        ("do", "this", "done"),
        [("user", "do\nthis"), ("assistant", "done")],
    ),
    (
        "system string, prompt string, response string",
        ("s", "q", "a"),
        [("system", "s"), ("user", "q"), ("assistant", "a")],
    ),
    (
        "messages array<struct<role:string,content:string>>",
        ([("user", "q"), ("assistant", None)],),
        [("user", "q"), ("assistant", "")],
    ),
    (
        "conversations array<struct<from:string,value:string>>",
        ([("human", "q"), ("gpt", "a")],),
        [("user", "q"), ("assistant", "a")],
    ),
    ("messages array<struct<role:string,content:string>>", (None,), []),
]


@pytest.mark.parametrize("schema,record,want", LAYOUTS)
def test_layouts(spark, schema, record, want):
    df = spark.createDataFrame([(1, *record, 5)], f"id bigint, {schema}, extra int")
    rows = sorted(turn_rows(df, "id").collect(), key=lambda r: r.turn)
    assert [(r.role, r.text) for r in rows] == want


def test_fingerprints(spark):
    a = spark.createDataFrame([], "x struct<a:int,b:array<struct<c:int>>>, y string").schema
    assert sorted(field_paths(a)) == ["x.a", "x.b[].c", "y"]
    assert fingerprint(["p", "q"]) == fingerprint(["q", "p"]) != fingerprint(["p"])
    with pytest.raises(ValueError, match="no known chat layout"):
        find_layout(spark.range(1), "id")
    assert TURNS


def test_quality_of_odd_rows(spark):
    docs = documents(spark, clashing=True)
    got = quality_verdicts(docs)
    assert set(got.columns) >= set(docs.columns)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.kept <= (not r.base_failed)
        if not r.text or not r.text.strip():
            assert (r.n_words, r.word_chars, r.n_repeat_words, r.kept) == (0, 0, 0, False)
    assert quality_verdicts(no_documents(spark)).count() == 0


def test_the_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = cascade_order(docs, RULES, sample_of=2)
    assert sorted(r.name for r in order) == sorted(r.name for r in RULES)
    one, two = (
        sorted(tuple(x) for x in quality_verdicts(docs, rules).select("doc_id", "kept").collect())
        for rules in (RULES, tuple(reversed(RULES)))
    )
    assert one == two


def test_rules_keep_good_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality = 1")
    good = quality_verdicts(docs).join(labels, "doc_id").where("NOT base_failed")
    lost, n = good.where("NOT kept").count(), good.count()
    assert lost <= 0.002 * n


def test_license_lines_of_odd_rows(spark):
    rows = [(1, "Cc-by cc by All rights Reserved"), (2, None), (3, ""), (4, "all rights reserved all rights reserved")]
    rows += [(5, "rights reserved"), (6, "released under MIT license"), (7, "apache license version 2 0 x")]
    rows += [(1, "Cc-by cc by All rights Reserved"), (None, "license mit"), (8, "x " * 30_000 + "cc by")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("words", F.lit(1))
    got = sorted((tuple(r) for r in scan_licenses(df.withColumn("hits", F.lit(2))).collect()), key=str)
    both = (1, 7, 3, 0, 4, "cc-by,reserved", "cc-by,reserved", 1.0)
    want = [both, both, (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0)]
    want += [(4, 6, 2, 0, 3, "reserved", "reserved", 1.0), (5, 2, 0, None, None, "", "", 0.0)]
    want += [(6, 4, 0, None, None, "", "", 0.0), (7, 6, 0, None, None, "", "", 0.0)]
    want += [(None, 2, 0, None, None, "", "", 0.0), (8, 30_002, 1, 30_000, 30_000, "cc-by", "cc-by", 1.0)]
    assert got == sorted(want, key=str)
    assert scan_licenses(df.limit(0)).count() == 0
