"""Licences by a positional index of rare words, on built-in functions alone.

Lines stand word by word at exact places; whole texts may have words left out, put in or
changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattfold.llm.license_texts import TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a template are looked up the rarest words of its key phrase, so many, and the
#: rarest of its other words; so many of them must agree on where the template starts.
#: The key's words must all stand, so no start is lost that could be verified.
FROM_KEY, AGREEING = 2, 2
#: Share of a template's words that must stand at their places.
LEAST_SHARE = 0.7
#: A word of a whole text may stand so many places before or after its own, counted from
#: the key phrase; so many percent of the words must stand like that.
SHIFT, LEAST_PERCENT = 12, 80
#: Starts that words suggest are counted in windows that overlap by half, so that one of
#: them holds all starts within SHIFT of the true one.
WINDOW = 2 * SHIFT + 1
#: Bits of a place in a text template, and the first number of a window: a start may lie
#: before the document.
PLACE_BITS, WINDOW_BITS = 18, 34
FIRST_WINDOW = 1 << 20


@dataclass(frozen=True)
class Template:
    """Words of a licence line in order; ``key`` is a run of them that may not be missing."""

    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]

    @staticmethod
    def of(label: str, words: str, key: str) -> Template:
        return Template(label, tuple(words.split()), tuple(key.split()))

    @staticmethod
    def of_text(label: str, text: str, key: str) -> Template:
        return Template.of(label, " ".join(re.findall(WORD, text.lower())), key)

    @property
    def missing(self) -> int:
        """Words that a whole text may lack."""
        return len(self.words) * (100 - LEAST_PERCENT) // 100

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


#: Phrases that count wherever their words stand consecutively.
PHRASES = (
    ("cc-by", ("cc", "by")),
    ("gpl", ("general", "public", "license")),
    ("reserved", ("all", "rights", "reserved")),
)
#: Lines of well-known licences.
TEMPLATES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template.of("mit", "released under the mit license", "mit license"),
    Template.of("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template.of(
        "gpl-3.0",
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license",
    ),
    Template.of(
        "bsd", "redistribution and use in source and binary forms", "source and binary forms"
    ),
    Template.of(
        "mpl-2.0", "subject to the terms of the mozilla public license", "mozilla public license"
    ),
)
TEXT_TEMPLATES = tuple(Template.of_text(*entry) for entry in TEXTS)


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def _vocabulary(templates: Iterable[Template]) -> list[str]:
    words = {w for _, phrase in PHRASES for w in phrase}
    return sorted(words | {w for t in templates for w in t.words})


def rarity(words: DataFrame, templates: Iterable[Template]) -> dict[str, int]:
    """Documents that hold each word of the templates; a row per such word is collected."""
    vocabulary = F.array(*map(F.lit, _vocabulary(templates)))
    found = words.select(F.explode(F.array_intersect("words", vocabulary)).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counts.collect()}


def _rarest(words: Iterable[str], documents: dict[str, int]) -> list[str]:
    """Words by falling inverse document frequency, ties by the alphabet."""
    return sorted(set(words), key=lambda w: (documents.get(w, 0), w))


def _looked_up(template: Template, documents: dict[str, int]) -> list[str]:
    own = _rarest(template.key, documents)[:FROM_KEY]
    return own + _rarest(set(template.words) - set(template.key), documents)[:1]


def _starts(word: str, words: tuple[str, ...]) -> Column:
    """Where a template would start for each place of one of its words in ``hits``."""
    offsets = [i for i, w in enumerate(words) if w == word]
    return F.flatten(
        F.transform(
            F.filter("hits", lambda h: h["word"] == word),
            lambda h: F.array(*(h["at"] - i for i in offsets)),
        )
    )


def _stand(start: Column, words: tuple[str, ...], skip: int = 0) -> Column:
    """Whether words stand consecutively from a place on; null counts as no."""
    same = [F.get("words", start + (skip + i)) == w for i, w in enumerate(words)]
    return F.coalesce(reduce(lambda a, b: a & b, same), F.lit(False))


def _standing(starts: Column, words: tuple[str, ...], skip: int = 0) -> Column:
    return F.filter(starts, lambda s: _stand(s, words, skip))


def _share(start: Column, template: Template) -> Column:
    found = [
        F.when(F.get("words", start + i) == w, 1).otherwise(0)
        for i, w in enumerate(template.words)
    ]
    return reduce(lambda a, b: a + b, found) / F.lit(float(len(template.words)))


def _best(template: Template, documents: dict[str, int]) -> Column:
    """Largest share over verified starts on which enough rare words agree."""
    rare = _looked_up(template, documents)
    enough = min(AGREEING, len(set(template.key)))
    starts = F.concat(*(F.array_distinct(_starts(w, template.words)) for w in rare))
    agreed = F.filter(
        F.array_distinct(starts),
        lambda s: F.size(F.filter(starts, lambda x: x == s)) >= enough,
    )
    verified = _standing(agreed, template.key, template.key_at)
    best = F.array_max(F.transform(verified, lambda s: _share(s, template)))
    return F.coalesce(best, F.lit(0.0))


def text_postings(template: Template, documents: dict[str, int]) -> list[int]:
    """Places of the rarest words outside the key phrase that are looked up.

    They are ``AGREEING`` more than the words that may be missing, so a text with enough
    of the words has at least ``AGREEING`` of these, whichever others it lacks.
    """
    key = range(template.key_at, template.key_at + len(template.key))
    places = [i for i in range(len(template.words)) if i not in key]
    places.sort(key=lambda i: (documents.get(template.words[i], 0), template.words[i], i))
    return places[: template.missing + AGREEING]


def _windows(texts: tuple[Template, ...], postings: list[list[int]]) -> Column:
    """A number per looked-up word of ``hits``, template, window and place in the template."""
    by_word: dict[str, list[tuple[int, int]]] = {}
    for k, (template, places) in enumerate(zip(texts, postings, strict=True)):
        for i in places:
            by_word.setdefault(template.words[i], []).append((k, i))
    entries = []
    for word, found in sorted(by_word.items()):
        pairs = (F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for k, i in found)
        entries += [F.lit(word), F.array(*pairs)]
    index = F.create_map(*entries)

    def votes(hit: Column) -> Column:
        def of(p: Column) -> Column:
            own = F.floor((hit["at"] - p["i"]) / WINDOW)
            first = p["k"].cast("bigint") * (1 << WINDOW_BITS) + FIRST_WINDOW + own
            return F.array(*((first + n) * (1 << PLACE_BITS) + p["i"] for n in (0, 1)))

        return F.flatten(F.transform(F.element_at(index, hit["word"]), of))

    return F.array_sort(F.array_distinct(F.flatten(F.transform("text_hits", votes))))


def _agreed() -> Column:
    """Windows of ``votes``, sorted, for which enough places vote: equal to one further on."""
    window = lambda code: F.shiftright(code, PLACE_BITS)
    enough = F.filter(
        "votes", lambda v, i: window(F.get("votes", i + (AGREEING - 1))) == window(v)
    )
    return F.array_distinct(F.transform(enough, window))


def _text_share(template: Template, k: int) -> Column:
    """Largest share of a template's words near their places, over its agreed windows.

    A window stands for the starts of which it holds all votes; those with the key phrase
    at its place are looked at, word by word.
    """
    first = (k << WINDOW_BITS) + FIRST_WINDOW
    mine = F.filter("agreed", lambda w: F.shiftright(w, WINDOW_BITS) == k)
    windows = F.transform(mine, lambda w: (w - first).cast("int"))
    starts = F.flatten(
        F.transform(
            windows,
            lambda w: F.filter(
                F.sequence((w - 1) * WINDOW + SHIFT, w * WINDOW + SHIFT - 1),
                lambda s: _stand(s, template.key, template.key_at),
            ),
        )
    )

    def near(s: Column, word: Column, i: Column) -> Column:
        begin = F.greatest(s + i - SHIFT, F.lit(0))
        around = F.slice("words", begin + 1, F.greatest(s + i + SHIFT + 1 - begin, F.lit(0)))
        return F.array_contains(around, word)

    own = F.array(*map(F.lit, template.words))
    found = F.array_max(
        F.transform(starts, lambda s: F.size(F.filter(own, lambda w, i: near(s, w, i))))
    )
    share = F.when(found * 100 >= len(template.words) * LEAST_PERCENT, found)
    return F.coalesce(share / F.lit(float(len(template.words))), F.lit(0.0))


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    texts: tuple[Template, ...] = TEXT_TEMPLATES,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    One pass counts in how many documents each licence word stands. A text with a phrase
    or template holds its rarest words, so only texts with one of those are looked at
    further: the places of licence words in it give where a template would start, the
    starts on which rare words agree are kept, and the key phrase is verified there.
    A template gives its label if its key phrase and ``LEAST_SHARE`` of its words stand at
    their places. ``score`` is 1 with a base phrase, else the largest such share, or 0.

    A whole text of ``texts`` gives its label where its key phrase stands and
    ``LEAST_PERCENT`` of its words lie within ``SHIFT`` of their places, so some words may
    be left out, put in or changed. Postings of its rarest words (word, template, place)
    meet their places in a document; each such pair votes for a start, and only windows of
    starts with enough votes are verified. No text with enough words is lost by that, see
    ``text_postings``, so how rare words are changes the cost alone. A text must have more
    words outside its key than may be missing, by ``AGREEING`` or more.

    A null or empty text has no words and no labels: counts 0, places null, labels empty.
    All places count, also when phrases overlap. A null doc_id stays null, equal rows
    give equal rows, an empty table gives none; other columns play no role.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    rows = docs.select(doc_id, lower_words(text).alias("words"))
    for t in texts:
        if len(t.words) - len(t.key) < t.missing + AGREEING or len(t.words) >= 1 << PLACE_BITS:
            raise ValueError(f"not a text that can be looked up: {t.label}")
    documents = rarity(rows, (*templates, *texts))
    anchors = [_rarest(phrase, documents)[0] for _, phrase in PHRASES]
    looked_up = {w for t in templates for w in _looked_up(t, documents)}
    sought = sorted(looked_up | set(anchors))
    needed = set(anchors) | {_rarest(t.key, documents)[0] for t in templates}
    some = F.arrays_overlap("words", F.array(*map(F.lit, sorted(needed))))
    no_hits = F.array().cast("array<struct<word:string,at:int>>")
    places = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    hits = F.when(some, F.filter(places, lambda h: h["word"].isin(sought))).otherwise(no_hits)
    rows = rows.withColumn("hits", hits)
    rows = _with_text_shares(rows, places, texts, documents)
    bases = [
        _standing(_starts(anchor, phrase), phrase)
        for (_, phrase), anchor in zip(PHRASES, anchors, strict=True)
    ]
    rows = rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        *(b.alias(f"base{i}") for i, b in enumerate(bases)),
        *(_best(t, documents).alias(f"share{i}") for i, t in enumerate(templates)),
        *(f"text{i}" for i in range(len(texts))),
    )
    base = F.concat(*(F.col(f"base{i}") for i in range(len(PHRASES))))
    base_labels = [F.when(F.size(f"base{i}") > 0, label) for i, (label, _) in enumerate(PHRASES)]
    own_labels = [
        F.when(F.col(f"share{i}") >= LEAST_SHARE, t.label) for i, t in enumerate(templates)
    ]
    own_labels += [F.when(F.col(f"text{i}") > 0, t.label) for i, t in enumerate(texts)]
    shares = [f"share{i}" for i in range(len(templates))] + [f"text{i}" for i in range(len(texts))]
    best = F.array_max(F.array(F.lit(0.0), *shares))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).cast("bigint").alias("first_word"),
        F.array_max(base).cast("bigint").alias("last_word"),
        _listed(base_labels).alias("base_labels"),
        _listed([*base_labels, *own_labels]).alias("labels"),
        F.when(F.size(base) > 0, 1.0).when(best >= LEAST_SHARE, best).otherwise(0.0).alias("score"),
    )


def _with_text_shares(
    rows: DataFrame, places: Column, texts: tuple[Template, ...], documents: dict[str, int]
) -> DataFrame:
    """``rows`` with a column ``text<k>`` per whole text: its share, or 0 if that is too small.

    Only documents that hold the rarest word of some key are looked at.
    """
    if not texts:
        return rows
    postings = [text_postings(t, documents) for t in texts]
    sought = {t.words[i] for t, own in zip(texts, postings, strict=True) for i in own}
    anchors = sorted({_rarest(t.key, documents)[0] for t in texts})
    some = F.arrays_overlap("words", F.array(*map(F.lit, anchors)))
    hits = F.when(some, F.filter(places, lambda h: h["word"].isin(sorted(sought))))
    own = rows.withColumn("text_hits", hits).withColumn("votes", _windows(texts, postings))
    own = own.withColumn("agreed", _agreed())
    shares = (_text_share(t, k).alias(f"text{k}") for k, t in enumerate(texts))
    return own.select("doc_id", "words", "hits", *shares)


def _listed(labels: list[Column]) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")
