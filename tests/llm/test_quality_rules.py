"""Quality rules against definitions written out, and the order of their cascade."""

import zlib
from collections import Counter
from itertools import permutations

import pytest

from tests.llm.fixtures import documents, no_documents, texts, words
from wattfold.llm import quality
from wattfold.llm.quality import (
    COMPRESSION,
    RULES,
    Measures,
    Pattern,
    Rule,
    best_order,
    cascade_order,
    cascade_seconds,
    quality_verdicts,
    rule_patterns,
)


def written_out(text):
    split = text.encode().split()
    pairs = Counter(zip(split, split[1:], strict=False))
    grams = Counter(text[i : i + 3] for i in range(len(text) - 2))
    lettered = [w for w in split if any(b > 127 or chr(b).isalpha() for b in w)]
    return {
        "n_top_pair": max(pairs.values(), default=0),
        "n_lettered": len(lettered),
        "n_trigrams": sum(grams.values()),
        "trigram_squares": sum(n * n for n in grams.values()),
        "n_compressed": len(zlib.compress(text.encode(), 1)),
        "n_bytes": len(text.encode()),
    }


@pytest.mark.parametrize("chars", [7, quality.CHARS])
def test_metrics_of_odd_texts(monkeypatch, chars):
    monkeypatch.setattr(quality, "CHARS", chars)
    for text in [t or "" for t in texts()] + ["a", "ab", "abc", "1 2 3 x", "\x00\x00\x00\x00"]:
        if len(text) > 5000 and chars < 100:
            text = text[:2000]
        measures = Measures(text)
        assert {name: measures[name] for name in written_out(text)} == written_out(text)


def test_each_rule_rejects_what_it_names():
    good = words(3, 120)
    rejects = {r.name: r.rejects for r in (*RULES, COMPRESSION)}
    odd = {
        "few_letters": " ".join(f"{i} {i * 7 % 1000} w{i}" for i in range(100)),
        "frequent_pair": " ".join(f"buy now a{i} b{i * 3} c{i * 5}" for i in range(40)),
        "few_trigrams": "abab " * 100,
        "compression": "the same sentence comes again and again. " * 80,
    }
    for name, text in odd.items():
        assert rejects[name](Measures(text)), name
        assert not rejects[name](Measures(good)), name


def test_the_order_counts_what_earlier_rules_leave():
    # Rule 0 rejects 60 texts at 1 second a text, rule 1 50 of the same, rule 2 30 others.
    patterns = {
        0b011: Pattern(50, {"x": 50.0, "y": 45.0, "z": 50.0}),
        0b001: Pattern(10, {"x": 10.0, "y": 9.0, "z": 10.0}),
        0b100: Pattern(30, {"x": 30.0, "y": 27.0, "z": 30.0}),
        0b000: Pattern(10, {"x": 10.0, "y": 9.0, "z": 10.0}),
    }
    needs = [{"x"}, {"y"}, {"z"}]
    assert best_order(patterns, needs) == [0, 2, 1]
    spent = {o: cascade_seconds(patterns, needs, list(o)) for o in permutations(range(3))}
    assert spent[0, 2, 1] == min(spent.values()) == 100 + 40 + 9
    assert cascade_seconds(patterns, needs, [0, 2, 1], stop=False) == 100 + 90 + 100


def test_a_known_metric_costs_nothing():
    patterns = {0b01: Pattern(5, {"x": 8.0, "y": 1.0}), 0b10: Pattern(4, {"x": 8.0, "y": 1.0})}
    patterns[0b100] = Pattern(1, {"x": 8.0, "y": 1.0})
    assert best_order(patterns, [{"x"}, {"y"}, {"x", "y"}]) == [1, 0, 2]
    assert best_order({}, [{"x"}, {"y"}]) == [0, 1]


def test_patterns_of_a_table(spark):
    docs = documents(spark)
    rules = (*RULES, COMPRESSION)
    patterns, needs = rule_patterns(docs, rules)
    seen = Counter()
    for row in docs.select("text").collect():
        m = Measures(row.text or "")
        seen[sum(r.rejects(m) << i for i, r in enumerate(rules))] += 1
    assert {p: found.n for p, found in patterns.items()} == dict(seen)
    assert needs[0] == {"words", "n_words"}
    assert needs[-1] == {"n_compressed", "n_bytes"}
    order = best_order(patterns, needs)
    best = cascade_seconds(patterns, needs, order)
    assert 0 < best < cascade_seconds(patterns, needs, order, stop=False)
    assert rule_patterns(no_documents(spark), rules) == ({}, [set() for _ in rules])
    assert cascade_order(no_documents(spark), rules) == list(rules)


def test_the_sample_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns, _ = rule_patterns(docs, RULES)
    assert 40 < sum(p.n for p in patterns.values()) < 200


def test_verdicts_of_rules_of_a_caller(spark):
    docs = documents(spark)
    rules = (COMPRESSION, Rule("none", lambda m: False))
    rows = quality_verdicts(docs, rules, measured=False).select("text", "kept").collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = (r.text or "").encode()
        assert r.kept == (10 * len(zlib.compress(text, 1)) >= len(text))
