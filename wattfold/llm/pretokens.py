"""Splits text as the pattern of the public byte-level tokenizers does, and maps pieces."""

from __future__ import annotations

import base64
import re
from functools import cache

import public_tokenizers
import tiktoken


@cache
def _class(one: str, top: int) -> str:
    """A class as tiktoken's engine sees it, spelled out for code points below ``top``.

    An encoding whose pattern is the class alone drops all other code points. What
    Python's engines hold for letters depends on their own Unicode version.
    """
    bytes_only = {bytes([i]): i for i in range(256)}
    encoding = tiktoken.Encoding(
        "class", pat_str=one, mergeable_ranks=bytes_only, special_tokens={}
    )
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, top)]))
    spans: list[list[int]] = []
    for c in map(ord, bytes(encoding.encode_ordinary(points)).decode()):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)


@cache
def _pattern(top: int) -> re.Pattern:
    classes = (r"\p{L}", r"\p{N}", r"\s")
    letters, numbers, spaces = (_class(one, top) for one in classes)
    text = public_tokenizers.PATTERN
    text = text.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    text = text.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(text.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


def split(text: str) -> list[str]:
    """The matches of ``public_tokenizers.PATTERN``, cut as tiktoken cuts them.

    ``re`` is quick with sets of the basic plane; a text with a higher code point takes
    the slower pattern that holds all of them.
    """
    basic = len(text.encode("utf-16-le")) == 2 * len(text)
    return _pattern(0x10000 if basic else 0x110000).findall(text)


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def word_encoding(path: str) -> tiktoken.Encoding:
    """Encodes one pre-token at a time, of any length.

    The library's engine runs out of stack where the public pattern meets a million blanks.
    """
    return tiktoken.Encoding(
        "word", pat_str=r"(?s).+", mergeable_ranks=ranks(path), special_tokens={}
    )
