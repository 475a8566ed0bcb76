"""Small awkward tables."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names operators use themselves.
CLASHING = ("piece", "kept", "row", "spans", "anchor", "n", "component", "words", "shard", "rank")


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéßñ", k=rng.randint(2, 9))) for _ in range(n))


def texts():
    """Texts with nulls, repeats, ties, odd characters, and one that is very long."""
    base = words(1, 200)
    near = base.split()
    near[50] = "changed"
    long = words(2, 12_000)
    out = [base, base, " ".join(near), None, "", " ", "\n\t", "one", "one", "two words"]
    out += [long, words(3, 120) + " " + base[:400], words(4, 80) + "\n" + words(4, 80)]
    out += ["ab" * 300, "a" * 500, "😀 漢字 \u0000 x y 'll  \n\n 123 ½" * 9, "<|endoftext|> a <|endoftext|>"]
    out += ["spam " * 120, "# $ % & | < > *\n" * 40, "CC-BY all rights reserved " * 20]
    return out


def documents(spark, clashing=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    rows += [(5, texts()[5], "en", "s", 1), (12, "another text of document twelve " + words(9, 60), None, None, None)]
    rows += [(None, texts()[0], None, "s", None), (-3, words(3, 120), "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        for i, name in enumerate(CLASHING):
            df = df.withColumn(name, F.lit(i))
    return df


def unique_documents(spark):
    """The same without repeated or missing ids."""
    return documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


def no_documents(spark):
    return spark.createDataFrame([], DOCS)
