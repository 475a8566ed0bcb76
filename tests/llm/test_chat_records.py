"""One table that mixes layouts of chat records, against plain Python."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from wattfold.llm.chat import chat_digests, format_chat, read_chat
from wattfold.llm.chat_records import (
    LAYOUTS,
    canonical_records,
    fingerprint_of,
    record_turns,
    shape_of,
    unknown_layouts,
)
from wattfold.llm.queries import op5_chat_format


def mixed(n=400):
    """JSON records and what they say; None where no layout is known."""
    rng = random.Random(11)

    def text():
        return rng.choice(["plain", "a\nb", "</turn> \\l <turn user>", "", "😀 漢", '{"prompt": "x"}', None])

    out = []
    for i in range(n):
        a, b, c = text(), text(), text()
        e = [x or "" for x in (a, b, c)]
        own = [
            ({"prompt": a, "response": b}, [("user", e[0]), ("assistant", e[1])]),
            ({"completion": b, "prompt": a}, [("user", e[0]), ("assistant", e[1])]),
            ({"system": c, "prompt": a, "response": b}, [("system", e[2])] * (c is not None) + [("user", e[0]), ("assistant", e[1])]),
            ({"instruction": a, "output": b}, [("user", e[0]), ("assistant", e[1])]),
            ({"instruction": a, "input": c, "output": b}, [("user", e[0] + ("\n" + e[2] if e[2] else "")), ("assistant", e[1])]),
            ({"messages": [{"role": "user", "content": a}, {"content": b, "role": "assistant"}]}, [("user", e[0]), ("assistant", e[1])]),
            ({"conversations": [{"from": "human", "value": a}, {"from": "gpt", "value": b}, {"from": "tool", "value": c}]}, [("user", e[0]), ("assistant", e[1]), ("tool", e[2])]),
            ({"messages": [{"role": "user", "content": [{"type": "text", "text": a}, {"type": "image", "text": "no"}, {"type": "text", "text": b}]}]}, [("user", e[0] + e[1])]),
            ({"conversation": [{"human": a, "assistant": b}, {"human": c, "assistant": a}]}, [("user", e[0]), ("assistant", e[1]), ("user", e[2]), ("assistant", e[0])]),
            ({"messages": []}, []),
            ({"messages": None}, []),
            ({"turn": 4, "role": "assistant", "text": a}, [("assistant", e[0])]),
            ({"prompt": a, "response": b, "score": 1.5}, None),  # a field too many
            ({"prompt": a}, None),
            ({"prompt": {"text": a}, "response": b}, None),  # the same names, other paths
            ({"messages": {"role": a, "content": b}}, None),
            ([a], None),
        ][i % 17]
        out.append((i, json.dumps(own[0], ensure_ascii=i % 2 == 0), own[1]))
    return [*out, (n, "not json {", None), (n + 1, None, None), (n + 2, "{}", None)]


def test_one_table_of_many_layouts(spark):
    rows = mixed()
    df = spark.createDataFrame([r[:2] for r in rows], "id bigint, record string").withColumn("turns", F.lit(1))
    got = {}
    for r in record_turns(df, "id", "record").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {i: [(a, b) for _, a, b in sorted(turns)] for i, turns in got.items()}
    assert got == {i: turns for i, _, turns in rows if turns}
    own = canonical_records(df, "id", "record").collect()
    assert {r.conv_id for r in own if r.layout is None} == {i for i, _, turns in rows if turns is None}
    assert len({r.fingerprint for r in own if r.layout}) >= 10
    unknown = {r.shape: r.n for r in unknown_layouts(df, "id", "record").collect()}
    assert sum(unknown.values()) == sum(turns is None for *_, turns in rows)
    assert unknown["unreadable"] == 2 and unknown["OBJECT<prompt: *, response: *, score: *>"] == 23
    # Round trip through the template.
    text = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_chat(format_chat(record_turns(df, "id", "record"))).collect()}
    assert text == got
    assert record_turns(df.limit(0), "id", "record").count() == 0


def test_ignored_fields_and_variants(spark):
    rows = [(1, '{"prompt": "q", "response": "a", "id": 7, "tags": [1, "x"]}'), (2, '{"prompt": "q", "response": "a"}'), (3, '{"prompt": "q", "other": 1}')]
    df = spark.createDataFrame(rows, "id bigint, record string").withColumn("record", F.try_parse_json("record"))
    got = canonical_records(df, "id", "record", ignored=("id", "tags")).collect()
    assert {r.conv_id: r.layout for r in got} == {1: "prompt-response", 2: "prompt-response", 3: None}
    assert len({r.fingerprint for r in got}) == 2


def test_shapes():
    assert shape_of(("b[].c", "a", "b[].a[]")) == "OBJECT<a: *, b: ARRAY<OBJECT<a: ARRAY<*>, c: *>>>"
    prints = Counter(f for x in LAYOUTS for f in x.fingerprints)
    assert max(prints.values()) == 1
    assert fingerprint_of("a") != fingerprint_of("b")


def test_the_query_reads_rows_by_their_fingerprints(spark):
    df = op5_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "schema_of_variant" in plan.lower() and "python" not in plan.lower()
    assert chat_digests and df.count() > 0
