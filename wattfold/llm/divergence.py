"""How far the sources of a language differ in their terms, by in-mapper stripes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattfold.llm.common import stored

#: Documents that must hold a term, and terms listed for a source.
LEAST_DOCS, LISTED = 3, 200
#: A share of a group's terms is a whole number of parts of this.
UNIT = 10**9
#: Entries, and bytes of text, that a task folds before it spills its stripes.
SPILL_ENTRIES, SPILL_BYTES = 600_000, 128 << 20
#: Rows of a spilled batch, stripes of a block, and sources whose pairs are summed at once.
SPILL_ROWS, BLOCK, TILE = 1 << 15, 1 << 13, 128
STRIPES = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"
PARTIAL = "lang string, source string, part string, item string, value bigint"

#: Terms are runs of ASCII letters and of bytes above ASCII; only A-Z are lower-cased.
_TERM_BYTES = bytes(i | 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


class Stripes:
    """Term to (documents that hold it, occurrences by source), for each language.

    The counts lie by source, so that a document is folded in by two sums over its terms;
    ``spill`` reads them across, as a stripe for each term.
    """

    def __init__(self):
        self.entries = self.size = 0
        self.df: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def fold(self, lang: str, source: str, text: bytes) -> None:
        df = self.df.setdefault(lang, Counter())
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(df) + len(counts)
        terms = terms_of(text)
        counts.update(terms)
        df.update(set(terms))
        self.entries += len(df) + len(counts) - before
        self.size += len(text)

    def full(self, entries: int, size: int) -> bool:
        return self.entries >= entries or self.size >= size

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, df in self.df.items():
            if df:
                yield from self._of_lang(lang, df)
        self.__init__()

    def _of_lang(self, lang: str, df: Counter) -> Iterator[pa.RecordBatch]:
        number = dict(zip(df, range(len(df)), strict=True))
        names = list(self.counts[lang])
        own = list(self.counts[lang].values())
        row = [np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in own]
        n = [np.fromiter(c.values(), np.int64, len(c)) for c in own]
        source = np.repeat(np.arange(len(own)), [len(c) for c in own])
        row, n = np.concatenate(row), np.concatenate(n)
        order = np.argsort(row, kind="stable")
        source, n = pa.array(names).take(pa.array(source[order])), n[order]
        begins = np.searchsorted(row[order], np.arange(len(df) + 1))
        terms = pa.array(list(df), pa.binary()).cast(pa.string())
        dfs = pa.array(list(df.values()), pa.int64())
        for a in range(0, len(df), SPILL_ROWS):
            b = min(a + SPILL_ROWS, len(df))
            lo, hi = begins[a], begins[b]
            offsets = pa.array((begins[a : b + 1] - lo).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (b - a), pa.string()),
                    terms.slice(a, b - a),
                    dfs.slice(a, b - a),
                    pa.ListArray.from_arrays(offsets, source.slice(lo, hi - lo)),
                    pa.ListArray.from_arrays(offsets, pa.array(n[lo:hi])),
                ],
                ["lang", "term", "df", "sources", "counts"],
            )


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(UNIT * (count + 1) / (total + terms))``, exact for totals below 9e15."""
    whole, rest = total + terms, count + 1
    out = np.zeros(np.broadcast(whole, rest).shape, np.int64)
    for _ in range(3):  # three digits of the quotient at a time
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Block:
    """Some merged stripes of a language, with the totals of all its sources."""

    def __init__(self, stripes: pa.StructArray, groups: pa.StructArray, terms: int, total: int):
        self.terms, self.total = terms, total
        self.names = groups.field("source")
        self.totals = groups.field("n").to_numpy()
        self.term = stripes.field("term").cast(pa.binary())
        self.count = stripes.field("total").to_numpy()
        lists = stripes.field("stripe")
        cells = lists.flatten()
        self.row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        self.source = pc.index_in(cells.field("source"), value_set=self.names).to_numpy()
        self.n = cells.field("n").to_numpy()

    def _shares(self, a: int, b: int) -> np.ndarray:
        """Of each term in each of the sources from ``a`` to ``b``, zero counts included."""
        counts = np.zeros((len(self.count), b - a), np.int64)
        mine = (self.source >= a) & (self.source < b)
        counts[self.row[mine], self.source[mine] - a] = self.n[mine]
        return shares(counts, self.totals[a:b], self.terms)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Source, other source and the block's part of the sum, tile by tile."""
        n = len(self.names)
        for a in range(0, n, TILE):
            p = self._shares(a, min(a + TILE, n)) if self.terms else None
            for b in range(0, n, TILE):
                width, high = min(TILE, n - b), min(TILE, n - a)
                sums = np.zeros((high, width), np.int64)
                if self.terms:
                    q = p if a == b else self._shares(b, b + width)
                    for i in range(high):
                        sums[i] = divergence(p[:, i : i + 1], q).sum(axis=0)
                i, j = np.indices(sums.shape).reshape(2, -1)
                other = i + a != j + b
                yield (i + a)[other], (j + b)[other], sums.ravel()[other]

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, row and value of the terms that can be among a source's first ones."""
        p = shares(self.n, self.totals[self.source], self.terms)
        q = shares(self.count, np.int64(self.total), self.terms)[self.row]
        more = np.flatnonzero(p > q)
        value, source, row = divergence(p[more], q[more]), self.source[more], self.row[more]
        place = np.empty(len(self.term), np.int64)
        place[pc.array_sort_indices(self.term).to_numpy()] = np.arange(len(self.term))
        order = np.lexsort((place[row], -value, source))
        own = source[order]
        begins = np.searchsorted(own, own)
        order = order[np.arange(len(order)) - begins < LISTED]
        return source[order], row[order], value[order]


def _rows(lang: str, part: str, source: pa.Array, item: pa.Array, value: np.ndarray):
    fixed = [pa.array([x] * len(value), pa.string()) for x in (lang, part)]
    columns = [fixed[0], source, fixed[1], item, pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            lang, terms, total = (batch[c][row].as_py() for c in ("lang", "terms", "total"))
            own = _Block(batch["stripes"][row].values, batch["groups"][row].values, terms, total)
            for i, j, value in own.pairs():
                source, item = (own.names.take(pa.array(x)) for x in (i, j))
                yield _rows(lang, "pair", source, item, value)
            if terms:
                i, j, value = own.listed()
                item = own.term.take(pa.array(j)).cast(pa.string())
                yield _rows(lang, "term", own.names.take(pa.array(i)), item, value)


def merged_stripes(
    docs: DataFrame, entries: int = SPILL_ENTRIES, size: int = SPILL_BYTES
) -> DataFrame:
    """``lang, term, df, total, stripe``: each term's documents and occurrences by source.

    A task folds whole documents into stripes and spills them whenever they are full. The
    spilled stripes meet by language and term; one shuffle serves both sums.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                held.fold(lang.as_py(), source.as_py(), text.as_py())
                if held.full(entries, size):
                    yield from held.spill()
        yield from held.spill()

    spilled = docs.select(*_groups_of(), _text("text").cast("binary").alias("text"))
    spilled = spilled.mapInArrow(fold, STRIPES).repartition("lang", "term")
    cells = spilled.select(
        "lang",
        "term",
        "df",
        F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "cell"),
    )
    # A spilled stripe's documents count once, at its first source.
    docs_here = F.when(F.col("place") == 0, F.col("df")).otherwise(0)
    cells = cells.groupBy("lang", "term", F.col("cell.sources").alias("source")).agg(
        F.sum("cell.counts").alias("n"), F.sum(docs_here).alias("df")
    )
    return cells.groupBy("lang", "term").agg(
        F.sum("df").alias("df"),
        F.sum("n").alias("total"),
        F.collect_list(F.struct("source", "n")).alias("stripe"),
    )


def _text(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _groups_of():
    return [_text(name).alias(name) for name in ("lang", "source")]


def source_divergences(docs: DataFrame, block: int = BLOCK, **spill) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others
    of its language (``pair``), and the terms it uses more than the language (``term``).

    A language keeps the terms of at least ``LEAST_DOCS`` of its documents. A kept term's
    share ``p`` of a source, or of the language, is in parts of ``UNIT`` with one added to
    each count; a divergence from ``q`` is ``(p - q)**2 // q``. All sums are whole numbers.
    ``pair`` sums over all kept terms, those that neither source holds too.

    Merged stripes meet their language's totals in blocks, which emit their part of the
    sums and the first ``LISTED`` terms of each source; a sum or a rank over blocks ends it.
    Rows per block are pairs of sources and listed terms, never documents. A stripe is as
    wide as its language has sources with the term, and there are as many result rows as
    pairs of sources, so the number of sources is what must stay moderate; sums of pairs are
    taken for ``TILE`` sources at a time. A language or source with a third of all
    rows costs each task a stripe per term, as any other.

    A null text, lang or source is the empty one. A text without terms, or an empty one,
    still makes its group occur: it has all pairs of its language, of value zero where the
    language keeps no term. Rows alike count as often as they occur. Equal values go by
    the item's bytes. An empty table gives no rows; other columns play no role.
    """
    kept = merged_stripes(docs, **spill).where(F.col("df") >= LEAST_DOCS)
    kept = stored(kept.select("lang", "term", "total", "stripe"))
    totals = kept.select("lang", F.explode("stripe").alias("cell")).groupBy(
        "lang", F.col("cell.source").alias("source")
    )
    totals = totals.agg(F.sum("cell.n").alias("n"))
    groups = docs.select(*_groups_of()).distinct().join(totals, ["lang", "source"], "left")
    group = F.struct("source", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(group)).alias("groups"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    langs = stored(langs.join(sizes, "lang", "left").fillna(0, ["terms", "total"]))

    # The totals go to each block of their language, so no block waits for a hot language.
    blocks = F.ceil(F.col("terms") / block).cast("bigint")
    own = kept.join(langs.select("lang", blocks.alias("blocks")), "lang")
    own = own.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    stripe = F.struct("term", "total", "stripe")
    own = own.groupBy("lang", "block").agg(F.collect_list(stripe).alias("stripes"))
    none = F.array().cast(own.schema["stripes"].dataType)
    places = F.sequence(F.lit(0).cast("bigint"), F.greatest(blocks, F.lit(1).cast("bigint")) - 1)
    own = langs.withColumn("block", F.explode(places)).join(own, ["lang", "block"], "left")
    own = own.select("lang", "terms", "total", "groups", F.coalesce("stripes", none).alias("stripes"))
    parts = stored(own.mapInArrow(_emit, PARTIAL))

    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item")
    pairs = pairs.agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value)
    terms = parts.where("part = 'term'").withColumn("rank", rank)
    terms = terms.where(F.col("rank") <= LISTED)
    return pairs.withColumn("rank", rank).unionByName(terms)
