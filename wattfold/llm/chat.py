"""Chat records of several layouts as canonical turns, and a reversible template."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A turn is OPEN, role, CLOSE, text, END. Role and text are escaped, so that "<" stands in
#: neither and ">" not in a role: what looks like a mark in a text can't be read as one.
OPEN, CLOSE, END = "<turn ", ">", "</turn>\n"
#: Applied in this order, undone in the other. After each "\" of an escaped string stands
#: one of the letters.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
TRAINED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, prefix: str = "") -> Iterator[str]:
    """Paths of all leaves of a schema; ``[]`` stands for an array's elements."""
    if isinstance(schema, T.StructType):
        for field in schema.fields:
            path = f"{prefix}.{field.name}" if prefix else field.name
            yield from field_paths(field.dataType, path)
    elif isinstance(schema, T.ArrayType):
        yield from field_paths(schema.elementType, f"{prefix}[]")
    else:
        yield prefix


def fingerprint(paths) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def _turn(role: str | Column, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(_text(role).alias("role"), _text(text).alias("text"))


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _elements(column: str, role: str, text: str) -> Column:
    turns = F.transform(column, lambda x: _turn(x[role], x[text]))
    return F.coalesce(turns, F.array().cast(TURNS))


def _with_system(*turns: Column) -> Column:
    """A system turn only where the record has a system text."""
    return F.concat(
        F.when(F.col("system").isNotNull(), F.array(_turn("system", F.col("system")))).otherwise(
            F.array().cast(TURNS)
        ),
        F.array(*turns),
    )


def _instruction(with_input: bool) -> Column:
    ask = _text(F.col("instruction"))
    if with_input:
        more = _text(F.col("input"))
        ask = F.when(more == "", ask).otherwise(F.concat(ask, F.lit("\n"), more))
    return F.array(_turn("user", ask), _turn("assistant", F.col("output")))


#: Leaf paths of a layout, and its canonical turns. A layout with one row per turn has no
#: mapping to an array; its rows are turns already.
LAYOUTS: dict[tuple[str, ...], Callable[[], Column] | None] = {
    ("prompt", "response"): lambda: F.array(
        _turn("user", F.col("prompt")), _turn("assistant", F.col("response"))
    ),
    ("prompt", "completion"): lambda: F.array(
        _turn("user", F.col("prompt")), _turn("assistant", F.col("completion"))
    ),
    ("system", "prompt", "response"): lambda: _with_system(
        _turn("user", F.col("prompt")), _turn("assistant", F.col("response"))
    ),
    ("instruction", "output"): lambda: _instruction(False),
    ("instruction", "input", "output"): lambda: _instruction(True),
    ("messages[].role", "messages[].content"): lambda: _elements("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): lambda: F.transform(
        _elements("conversations", "from", "value"),
        lambda x: F.struct(
            F.when(x["role"] == "human", "user")
            .when(x["role"] == "gpt", "assistant")
            .otherwise(x["role"])
            .alias("role"),
            x["text"].alias("text"),
        ),
    ),
    ("turn", "role", "text"): None,
}
_BY_FINGERPRINT = {fingerprint(paths): mapping for paths, mapping in LAYOUTS.items()}


def _layout_columns(paths: tuple[str, ...]) -> set[str]:
    return {p.split("[")[0].split(".")[0] for p in paths}


def find_layout(df: DataFrame, key: str) -> Callable[[], Column] | None:
    """The mapping of the largest known layout among a table's columns but its key.

    Columns that belong to no layout are passed over: the fingerprint is taken of the
    paths below a layout's own columns, which must be exactly the layout's.
    """
    for paths in sorted(LAYOUTS, key=len, reverse=True):
        own = _layout_columns(paths)
        if own <= set(df.columns) - {key}:
            schema = T.StructType([f for f in df.schema.fields if f.name in own])
            found = fingerprint(field_paths(schema))
            if found in _BY_FINGERPRINT:
                return _BY_FINGERPRINT[found]
    raise ValueError(f"no known chat layout in {df.schema.simpleString()}")


def turn_rows(df: DataFrame, key: str) -> DataFrame:
    """Canonical turns as rows ``conv_id, turn, role, text`` of a table of any known layout.

    Nulls in roles and texts become empty. A record without messages has no rows.
    """
    mapping = find_layout(df, key)
    conv = F.col(f"`{key}`").alias("conv_id")
    if mapping is None:
        turn = F.col("turn").cast("bigint").alias("turn")
        role, text = (_text(F.col(c)).alias(c) for c in ("role", "text"))
        return df.select(conv, turn, role, text)
    return df.select(conv, F.posexplode(mapping()).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text"
    )


def escape(text: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(
        lambda x, pair: F.replace(x, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text
    )


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of each conversation.

    Turns are put together in the order of ``turn``, ties by role and text; equal rows
    count as often as they occur. A null turn comes first, rows without conv_id form one
    conversation, an empty table gives none. ``loss_spans`` are start and end, in code
    points of ``formatted``, of the texts of the trained role.

    Lengths are added up by a window before turns are gathered, so a long conversation
    costs one sort of its turns.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"))
    rows = rows.withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("nth"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        (F.sum("size").over(upto) - F.length("body") - len(END)).alias("start"),
        F.length("body").alias("n"),
        (F.col("role") == TRAINED_ROLE).alias("trained"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "piece", "start", "n", "trained"))).alias("t")
    )
    spans = F.transform(
        F.filter("t", lambda x: x["trained"]),
        lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"]).alias("end")),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_chat(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text`` read back from ``format_chat``'s output alone."""
    pieces = F.filter(F.split("formatted", END), lambda x: x != "")

    parts = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, CLOSE, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, CLOSE, 1)) + 2)).alias("text"),
        ),
    )

    def masked(span: Column) -> Column:
        start, end = span["start"].cast("int"), span["end"].cast("int")
        return unescape(F.substr("formatted", start + 1, end - start))

    loss = F.array_join(F.transform("loss_spans", masked), "").alias("loss_text")
    return formatted.select("conv_id", "formatted", parts.alias("turns"), loss)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back: turns, and the text under the loss mask."""
    joined = F.array_join(
        F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""
    )
    return read_chat(formatted).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
