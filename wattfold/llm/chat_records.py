"""Chat records of many layouts in one table: a fingerprint of each record's field paths
selects the declarative mapping that turns it into canonical turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<turn:bigint,role:string,text:string>"
TURNS = f"array<{TURN}>"
#: Types of leaves, as Spark spells them, which a fingerprint doesn't tell apart.
_LEAF = (
    r"(?<=: |<)(STRING|BIGINT|BOOLEAN|VOID|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|DATE|BINARY|UUID"
    r"|TIMESTAMP_NTZ|TIMESTAMP)(?=[,>]|$)"
)


def shape_of(paths: tuple[str, ...]) -> str:
    """The shape of a record with just these leaves; ``[]`` stands for an array's elements."""
    tree: dict = {}
    for path in paths:
        at = tree
        for step in path.replace("[]", ".[]").split("."):
            at = at.setdefault(step, {})

    def spelled(node: dict) -> str:
        if not node:
            return "*"
        if "[]" in node:
            return f"ARRAY<{spelled(node['[]'])}>"
        fields = (f"{name}: {spelled(node[name])}" for name in sorted(node))
        return f"OBJECT<{', '.join(fields)}>"

    return spelled(tree)


def fingerprint_of(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()[:16]


def record_shape(record: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Nested field paths of a record, a variant, without the ``ignored`` top-level fields."""
    own = F.schema_of_variant(record)
    if ignored:
        fields = F.try_variant_get(record, "$", "map<string,variant>")
        fields = F.map_entries(F.map_filter(fields, lambda name, _: ~name.isin(*ignored)))
        spelled = F.transform(
            fields, lambda x: F.concat(x["key"], F.lit(": "), F.schema_of_variant(x["value"]))
        )
        inner = F.array_join(F.array_sort(spelled), ", ")
        own = F.coalesce(F.concat(F.lit("OBJECT<"), inner, F.lit(">")), own)
    return F.coalesce(F.regexp_replace(own, _LEAF, "*"), F.lit("unreadable"))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _turn(nth: Column | int, role: Column | str, text: Column) -> Column:
    nth = F.lit(nth) if isinstance(nth, int) else nth
    role = F.lit(role) if isinstance(role, str) else _text(role)
    return F.struct(
        nth.cast("bigint").alias("turn"), role.alias("role"), _text(text).alias("text")
    ).cast(TURN)


def _leaf(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "string")


def _exchange(ask: str, answer: str, system: str | None = None) -> Callable[[Column], Column]:
    def turns(record: Column) -> Column:
        own = F.array(
            _turn(1, "user", _leaf(record, ask)), _turn(2, "assistant", _leaf(record, answer))
        )
        if system is None:
            return own
        text = _leaf(record, system)
        first = F.array(_turn(0, "system", text))
        return F.concat(F.when(text.isNotNull(), first).otherwise(F.array().cast(TURNS)), own)

    return turns


def _task(record: Column) -> Column:
    ask, more = _text(_leaf(record, "instruction")), _text(_leaf(record, "input"))
    ask = F.when(more == "", ask).otherwise(F.concat(ask, F.lit("\n"), more))
    return F.array(_turn(1, "user", ask), _turn(2, "assistant", _leaf(record, "output")))


def _elements(name: str, role: str, text: str, kind: str = "string"):
    """Turns of an array of objects, by the place in it."""

    def turns(record: Column, of=lambda x: x[text], who=lambda x: x[role]) -> Column:
        kinds = f"array<struct<`{role}`:string,`{text}`:{kind}>>"
        own = F.try_variant_get(record, f"$.{name}", kinds)
        return F.transform(own, lambda x, i: _turn(i, who(x), of(x)))

    return turns


def _shared(record: Column) -> Column:
    def who(x: Column) -> Column:
        name = x["from"]
        return F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name)

    return _elements("conversations", "from", "value")(record, who=who)


def _parts(record: Column) -> Column:
    """Messages whose content is a list of parts; the text parts are joined."""
    kind = "array<struct<type:string,text:string>>"

    def of(x: Column) -> Column:
        texts = F.filter(x["content"], lambda p: p["type"] == "text")
        return F.array_join(F.transform(texts, lambda p: _text(p["text"])), "")

    return _elements("messages", "role", "content", kind)(record, of=of)


def _pairs(record: Column) -> Column:
    own = F.try_variant_get(
        record, "$.conversation", "array<struct<human:string,assistant:string>>"
    )
    turns = F.transform(
        own,
        lambda x, i: F.array(
            _turn(2 * i, "user", x["human"]), _turn(2 * i + 1, "assistant", x["assistant"])
        ),
    )
    return F.flatten(turns)


def _row(record: Column) -> Column:
    """A record that is one turn and tells its place."""
    nth = F.try_variant_get(record, "$.turn", "bigint")
    return F.array(_turn(nth, _leaf(record, "role"), _leaf(record, "text")))


@dataclass(frozen=True)
class Layout:
    """Leaf paths, in all spellings that a record of the layout may have, and its turns."""

    name: str
    spellings: tuple[tuple[str, ...], ...]
    turns: Callable[[Column], Column]

    @property
    def fingerprints(self) -> list[str]:
        return [fingerprint_of(shape_of(paths)) for paths in self.spellings]


def _none(record: Column) -> Column:
    return F.array().cast(TURNS)


LAYOUTS = [
    Layout("prompt-response", (("prompt", "response"),), _exchange("prompt", "response")),
    Layout("prompt-completion", (("prompt", "completion"),), _exchange("prompt", "completion")),
    Layout("question-answer", (("question", "answer"),), _exchange("question", "answer")),
    Layout(
        "system-prompt-response",
        (("system", "prompt", "response"),),
        _exchange("prompt", "response", "system"),
    ),
    Layout(
        "instruction", (("instruction", "output"), ("instruction", "input", "output")), _task
    ),
    Layout(
        "messages",
        (("messages[].role", "messages[].content"),),
        _elements("messages", "role", "content"),
    ),
    Layout("shared", (("conversations[].from", "conversations[].value"),), _shared),
    Layout(
        "parts",
        (("messages[].role", "messages[].content[].type", "messages[].content[].text"),),
        _parts,
    ),
    Layout("pairs", (("conversation[].human", "conversation[].assistant"),), _pairs),
    Layout("row", (("turn", "role", "text"),), _row),
    # An empty or missing array has no element whose fields could tell more.
    Layout(
        "no turns",
        (("messages",), ("messages[]",), ("conversations",), ("conversations[]",), ("conversation[]",)),
        _none,
    ),
]


def canonical_records(
    records: DataFrame, key: str, record: str | Column, ignored: tuple[str, ...] = ()
) -> DataFrame:
    """``conv_id, shape, fingerprint, layout, turns`` of each row.

    ``record`` is a variant, or JSON text. Its nested field paths, whatever their types and
    order, are hashed, and the hash selects the mapping; names alone select nothing. Of the
    top-level fields, ``ignored`` ones take no part. A record whose hash is unknown, a
    null and text that isn't JSON have a null layout and null turns: they are counted
    (``unknown_layouts``), not guessed at.

    Nulls in roles and texts become empty. A record without messages has no turns. Rows
    alike give rows alike, an empty table none; other columns play no role.
    """
    own = F.col(record) if isinstance(record, str) else record
    rows = records.select(F.col(f"`{key}`").alias("conv_id"), own.alias("record"))
    if rows.schema["record"].dataType.simpleString() != "variant":
        rows = rows.withColumn("record", F.try_parse_json(F.col("record").cast("string")))
    rows = rows.withColumn("shape", record_shape(F.col("record"), ignored))
    rows = rows.withColumn("fingerprint", F.substring(F.sha2("shape", 256), 1, 16))
    known = [(x, F.col("fingerprint").isin(x.fingerprints)) for x in LAYOUTS]
    layout = reduce(lambda c, x: c.when(x[1], F.lit(x[0].name)), known, F)
    turns = reduce(lambda c, x: c.when(x[1], x[0].turns(F.col("record"))), known, F)
    return rows.select(
        "conv_id", "shape", "fingerprint", layout.alias("layout"), turns.alias("turns")
    )


def record_turns(
    records: DataFrame, key: str, record: str | Column, ignored: tuple[str, ...] = ()
) -> DataFrame:
    """Canonical turns as rows ``conv_id, turn, role, text``, of records of known layouts."""
    own = canonical_records(records, key, record, ignored)
    return own.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


def unknown_layouts(
    records: DataFrame, key: str, record: str | Column, ignored: tuple[str, ...] = ()
) -> DataFrame:
    """``fingerprint, shape, n``: how many records have each unknown layout."""
    own = canonical_records(records, key, record, ignored).where("layout IS NULL")
    return own.groupBy("fingerprint").agg(F.min("shape").alias("shape"), F.count("*").alias("n"))
