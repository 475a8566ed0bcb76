"""Whole licence texts, whole and edited, against the definition and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import multiset
from wattfold.llm.licenses import (
    AGREEING,
    LEAST_PERCENT,
    SHIFT,
    TEXT_TEMPLATES,
    Template,
    scan_licenses,
    text_postings,
)
from wattfold.llm.oracle import SQL

SCHEMA = "doc_id bigint, text string"


def share(words, t):
    """Most of a template's words near their places, over all places of its key."""
    best = 0
    n = len(t.key)
    for p in range(len(words)):
        if tuple(words[p : p + n]) == t.key:
            s = p - t.key_at
            around = [words[max(s + i - SHIFT, 0) : max(s + i + SHIFT + 1, 0)] for i in range(len(t.words))]
            best = max(best, sum(w in near for w, near in zip(t.words, around, strict=True)))
    return best / len(t.words) if 100 * best >= LEAST_PERCENT * len(t.words) else 0.0


def edited(rng, t, changes, kind):
    """A template's words with so many of those outside the key changed, cut or added."""
    out = list(t.words)
    key = range(t.key_at, t.key_at + len(t.key))
    for i in sorted(rng.sample([i for i in range(len(out)) if i not in key], changes), reverse=True):
        out[i : i + 1] = {"changed": ["other"], "cut": [], "added": ["more", out[i]]}[kind]
    return out


def cases():
    rng = random.Random(5)
    noise = ["lorem", "software", "the", "of", "notice", "permission", "x1"]
    texts = []
    for t in TEXT_TEMPLATES:
        for kind in ("changed", "cut", "added"):
            for percent in (0, 4, 15, 20, 24):
                own = edited(rng, t, len(t.words) * percent // 100, kind)
                before = rng.choices(noise, k=rng.choice((0, 3, 200)))
                texts.append(" ".join([*before, *own, *rng.choices(noise, k=rng.choice((0, 40)))]))
        texts.append(" ".join(t.words).upper().replace(" ", ", "))
        texts.append(" ".join(t.key))
        texts.append(" ".join(w for i, w in enumerate(t.words) if i != t.key_at))
        texts.append(" ".join(t.words[t.key_at :]))
    every = " ".join(w for t in TEXT_TEMPLATES for w in t.words)
    shuffled = every.split()
    rng.shuffle(shuffled)
    return [*texts, every, " ".join([every] * 40), " ".join(shuffled), " ".join(TEXT_TEMPLATES[0].key * 3000)]


@pytest.fixture(scope="module")
def found(spark):
    texts = cases()
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (-1, None), (-2, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.withColumn("votes", F.lit(1)).withColumn("agreed", F.lit(2))
    return rows, df, scan_licenses(df).collect()


def test_texts_are_found_as_defined(found):
    rows, _, got = found
    want = []
    for doc_id, text in rows:
        words = (text or "").lower().replace(",", " ").split()
        own = [(t.label, share(words, t)) for t in TEXT_TEMPLATES]
        want.append((doc_id, sorted({label for label, s in own if s > 0}), max(s for _, s in own)))
    labels = {t.label for t in TEXT_TEMPLATES}
    mine = [(r.doc_id, [x for x in r.labels.split(",") if x in labels], r.score) for r in got]
    # A line of one sentence may score higher than the text it stands in.
    pairs = list(zip(sorted(mine, key=str), sorted(want, key=str), strict=True))
    assert [m[:2] for m, _ in pairs] == [w[:2] for _, w in pairs]
    assert all(m[2] >= w[2] for m, w in pairs)
    assert sum(bool(w[1]) for w in want) > 40 and any(not w[1] for w in want)


def test_the_share_of_a_text_is_its_score(spark):
    own = [(i, text) for i, text in enumerate(cases())]
    df = spark.createDataFrame(own, SCHEMA)
    for t in TEXT_TEMPLATES:
        got = {r.doc_id: r.score for r in scan_licenses(df, (), (t,)).collect()}
        assert got == {i: share(x.lower().replace(",", " ").split(), t) for i, x in own}


def test_same_rows_as_sql(spark):
    # The SQL copies a text for each place of a key, so it gets the shorter ones.
    rows = [(i, t) for i, t in enumerate(cases()) if len(t) < 4000]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (-1, None), (-2, "")], SCHEMA)
    got = scan_licenses(df).collect()
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = con.sql(SQL["op9_license_scan"])
    columns = got[0].__fields__
    assert sorted(columns) == sorted(want.columns)
    assert multiset(columns, got) == multiset(want.columns, want.fetchall())


def test_how_rare_words_are_changes_no_result(spark):
    texts = cases()[:24]
    rows = list(enumerate(texts))
    alone = {r.doc_id: tuple(r) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    common = [(1000 + i, "merchantability sublicense tort noninfringement hereby fee") for i in range(300)]
    among = scan_licenses(spark.createDataFrame(rows + common, SCHEMA)).where("doc_id < 1000").collect()
    assert {r.doc_id: tuple(r) for r in among} == alone


def test_postings():
    t = TEXT_TEMPLATES[0]
    places = text_postings(t, {w: 9 for w in t.words[:20]})
    key = set(range(t.key_at, t.key_at + len(t.key)))
    assert len(set(places)) == t.missing + AGREEING and not key & set(places)
    assert all(t.words[i] not in t.words[:20] for i in places)


def test_a_text_that_cannot_be_looked_up(spark):
    with pytest.raises(ValueError, match="short"):
        scan_licenses(spark.createDataFrame([], SCHEMA), (), (Template.of("short", "a b c", "a b"),))
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
