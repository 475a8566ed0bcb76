"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfold.llm.common import id_and_text, slabs

#: Documents that are timed, on average. They steer the order of the rules alone, which
#: changes the cost and never the verdict.
SAMPLE_ROWS = 2000
#: Characters whose trigrams are counted at once.
CHARS = 1 << 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes that are neither white space nor part of a letter (A-Z, a-z, beyond ASCII).
_NO_LETTER = bytes(
    b for b in range(128) if not chr(b).isalpha() and chr(b) not in SPACES
)


class Measures:
    """Metrics of one text, each computed when a rule or the result asks for it.

    ``words`` and ``pairs`` are what several metrics share.
    """

    def __init__(self, text: str):
        self.text = text
        self.known: dict = {}

    def __getitem__(self, name: str):
        if name not in self.known:
            self.known[name] = getattr(self, f"_{name}")()
        return self.known[name]

    def _words(self) -> list[bytes]:
        return self.text.encode().split()

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the words and of their pairs, equal where they are, and of how many."""
        words = self["words"]
        number: dict[bytes, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
        _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
        return w, pair, len(number)

    def _n_words(self) -> int:
        return len(self["words"])

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _n_lines(self) -> int:
        return sum(1 for line in self.text.split("\n") if line.strip(SPACES))

    def _n_dup_lines(self) -> int:
        lines = [line for line in self.text.split("\n") if line.strip(SPACES)]
        return len(lines) - len(set(lines))

    def _n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more, first ones included."""
        n = self["n_words"] - 2
        if n < 2:
            return 0
        w, pair, distinct = self["pairs"]
        _, nth, count = np.unique(
            pair[:-1] * distinct + w[2:], return_inverse=True, return_counts=True
        )
        again = count[nth] > 1
        covered = np.zeros(n + 2, bool)
        for i in range(3):
            covered[i : n + i] |= again
        return int(covered.sum())


    def _n_top_pair(self) -> int:
        """Places of the most frequent pair of neighbouring words."""
        return int(np.bincount(self["pairs"][1]).max()) if self["n_words"] > 1 else 0

    def _n_lettered(self) -> int:
        """Words with a letter; without all else but white space, the others vanish."""
        return len(self.text.encode().translate(None, _NO_LETTER).split())

    def _n_trigrams(self) -> int:
        return max(len(self.text) - 2, 0)

    def _trigram_squares(self) -> int:
        """Sum of the squared frequencies of the text's strings of three characters."""
        found, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, self["n_trigrams"], CHARS):
            part = self.text[start : start + CHARS + 2].encode("utf-32-le")
            c = np.frombuffer(part, np.uint32).astype(np.int64)
            own, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
            if start:
                own, at = np.unique(np.concatenate([found, own]), return_inverse=True)
                n = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
            found, counts = own, n
        return int(counts @ counts)

    def _n_bytes(self) -> int:
        return len(self.text.encode())

    def _n_compressed(self) -> int:
        return len(zlib.compress(self.text.encode(), 1))


class _Timed(Measures):
    """Notes the seconds of each metric, without those of the metrics that it asks for."""

    def __init__(self, text: str):
        super().__init__(text)
        self.seconds: dict[str, float] = {}
        self.inner = [0.0]

    def __getitem__(self, name: str):
        if name in self.known:
            return self.known[name]
        self.inner.append(0.0)
        began = time.perf_counter()
        value = super().__getitem__(name)
        spent = time.perf_counter() - began
        self.seconds[name] = spent - self.inner.pop()
        self.inner[-1] += spent
        return value


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures of a text."""

    name: str
    rejects: Callable[[Measures], bool]


BASE = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
#: Beside the base rules: a symbol for every fifth word or more, over half of the lines
#: repeated, words far too short or too long on average, a letter in less than 80 percent
#: of the words, over a fifth of the words in one pair of words, and strings of three
#: characters so few that two places hold the same with a chance above 1 in 50.
OWN = (
    Rule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("few_letters", lambda m: 5 * m["n_lettered"] < 4 * m["n_words"]),
    Rule("frequent_pair", lambda m: 10 * m["n_top_pair"] > m["n_words"]),
    Rule("few_trigrams", lambda m: 50 * m["trigram_squares"] > m["n_trigrams"] ** 2),
)
RULES = (*BASE, *OWN)
#: Over ten bytes for one of deflate's, at its fastest level. No SQL can say that, so it is
#: not among the rules above.
COMPRESSION = Rule("compression", lambda m: 10 * m["n_compressed"] < m["n_bytes"])


@dataclass
class Pattern:
    """Sampled texts that the same rules reject: how many, and seconds by metric."""

    n: int = 0
    seconds: dict[str, float] = field(default_factory=dict)


def _sample(docs: DataFrame, sample_of: int | None) -> DataFrame:
    texts = id_and_text(docs)
    if sample_of:
        return texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample_of)) == 0)
    n = texts.count()
    return texts if n <= SAMPLE_ROWS else texts.sample(SAMPLE_ROWS / n, seed=7)


def rule_patterns(
    docs: DataFrame, rules: tuple[Rule, ...], sample_of: int | None = None
) -> tuple[dict[int, Pattern], list[set[str]]]:
    """How the sampled texts fare under all rules, and the metrics each rule asks for.

    A pattern's key has bit ``i`` set if rule ``i`` rejects its texts. About
    ``SAMPLE_ROWS`` documents are read, or one in ``sample_of`` by the hash of its id. The
    driver gets a row per pattern and metric, so no more than the sample has; the
    patterns take at most 63 rules.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By pattern and metric (none: the texts): seconds, texts, the rules that ask.
        sums: dict[tuple[int, str | None], list] = {}
        for _, own in slabs(batches):
            for text in own:
                seen = [_Timed(text) for _ in rules]
                pattern = sum(bool(r.rejects(m)) << i for i, (r, m) in enumerate(zip(rules, seen)))
                sums.setdefault((pattern, None), [0.0, 0, 0])[1] += 1
                for metric in {name for m in seen for name in m.seconds}:
                    askers = [i for i, m in enumerate(seen) if metric in m.seconds]
                    spent = sums.setdefault((pattern, metric), [0.0, 0, 0])
                    spent[0] += min(seen[i].seconds[metric] for i in askers)
                    spent[2] |= sum(1 << i for i in askers)
        columns = [
            pa.array([p for p, _ in sums], pa.int64()),
            pa.array([m for _, m in sums], pa.string()),
            *(
                pa.array([x[i] for x in sums.values()], kind)
                for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))
            ),
        ]
        names = ["pattern", "metric", "seconds", "n", "askers"]
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = _sample(docs, sample_of).mapInArrow(
        measure, "pattern bigint, metric string, seconds double, n bigint, askers bigint"
    )
    rows = rows.groupBy("pattern", "metric").agg(
        F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.bit_or("askers").alias("askers")
    )
    patterns: dict[int, Pattern] = {}
    needs: list[set[str]] = [set() for _ in rules]
    for row in rows.collect():
        pattern = patterns.setdefault(row["pattern"], Pattern())
        pattern.n += row["n"]
        if row["metric"]:
            pattern.seconds[row["metric"]] = row["seconds"]
            for i, own in enumerate(needs):
                if row["askers"] >> i & 1:
                    own.add(row["metric"])
    return patterns, needs


def _spent(patterns: dict[int, Pattern], metrics: set[str]) -> float:
    return sum(p.seconds.get(m, 0.0) for p in patterns.values() for m in metrics)


def best_order(patterns: dict[int, Pattern], needs: list[set[str]]) -> list[int]:
    """Rules by rejections per second, each counted on what those before it leave.

    So a rule that rejects the same texts as an earlier one moves back, and one whose
    metrics are known by then costs little. Ties go to the cheaper rule, then as given; an
    empty sample leaves the given order.
    """
    order, left, known = [], dict(patterns), set()

    def worth(i: int) -> tuple[float, float, int]:
        rejected = sum(p.n for pattern, p in left.items() if pattern >> i & 1)
        seconds = _spent(left, needs[i] - known)
        return -rejected / max(seconds, 1e-9), seconds, i

    while len(order) < len(needs):
        i = min((i for i in range(len(needs)) if i not in order), key=worth)
        order.append(i)
        known |= needs[i]
        left = {pattern: p for pattern, p in left.items() if not pattern >> i & 1}
    return order


def cascade_seconds(
    patterns: dict[int, Pattern], needs: list[set[str]], order: list[int], stop: bool = True
) -> float:
    """Seconds on the sample in that order, done at a text's first rejection if ``stop``."""
    seconds, left, known = 0.0, dict(patterns), set()
    for i in order:
        seconds += _spent(left, needs[i] - known)
        known |= needs[i]
        if stop:
            left = {pattern: p for pattern, p in left.items() if not pattern >> i & 1}
    return seconds


def cascade_order(
    docs: DataFrame, rules: tuple[Rule, ...], sample_of: int | None = None
) -> list[Rule]:
    """The rules in the order that ``best_order`` gives on a sample."""
    return [rules[i] for i in best_order(*rule_patterns(docs, rules, sample_of))]


def quality_verdicts(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, measured: bool = True
) -> DataFrame:
    """Each row of ``docs`` with ``kept``; if ``measured``, with all metrics as well.

    The rules run in the order that their cost and what they reject beyond each other on a
    sample suggest, and a text is done at the first that rejects it. A text is kept if no
    rule rejects it, whatever the order. ``base_failed`` tells whether a base rule rejects
    it.

    A null or empty text has no words, so ``few_words`` rejects it. Rows alike get the
    same verdict; an empty table gives no rows; a null doc_id is kept as it is. Other
    columns are passed on; the new columns replace those of the same name.
    """
    order = cascade_order(docs, rules)
    metrics = list(METRICS) if measured else []
    new = [*metrics, *(["base_failed"] if measured else []), "kept"]
    own = docs.drop(*new)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = own.select(
        F.lit(0).alias("place"),
        text.alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("row"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, failed, kept = {m: [] for m in metrics}, [], []
            for text in batch.column(1).to_pylist():
                m = Measures(text)
                kept.append(not any(rule.rejects(m) for rule in order))
                if measured:
                    failed.append(any(rule.rejects(m) for rule in BASE))
                    for name in metrics:
                        values[name].append(m[name])
            columns = [pa.array(values[m], pa.int64()) for m in metrics]
            columns += [pa.array(failed, pa.bool_())] if measured else []
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.bool_()), batch.column(2)], [*new, "row"]
            )

    schema = T.StructType()
    for name in new:
        schema.add(name, T.LongType() if name in metrics else T.BooleanType())
    schema.add("row", rows.schema["row"].dataType)
    return rows.mapInArrow(judge, schema).select("row.*", *new)
