"""Types as a checker spells them: unions, literals and callables taken apart.

Strings are short and grammar nests, so these are Python functions; the columns
below them run on Arrow batches and read each distinct spelling once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPENING, CLOSING, QUOTES = "[(", "])", "'\""
OPAQUE = ("Any", "Unknown")
INTEGER = re.compile(r"-?\d+\Z")


def split_top(text: str, sep: str) -> list[str]:
    """The parts between separators outside brackets and quotes."""
    cuts, depth, quote, skip = [0], 0, "", 0
    for k, c in enumerate(text):
        if k < skip:
            continue
        if quote:
            skip = k + 2 if c == "\\" else skip
            quote = "" if c == quote else quote
        elif c in QUOTES:
            quote = c
        else:
            depth += (c in OPENING) - (c in CLOSING)
            if depth == 0 and text.startswith(sep, k):
                cuts += [k, k + len(sep)]
                skip = k + len(sep)
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]


def split_union(text: str) -> list[str]:
    return [x.strip() for x in split_top(text, " | ") if x.strip()]


def _base_of(value: str, member: str) -> str:
    if value in ("True", "False"):
        return "bool"
    if value[:1] in QUOTES and value:
        return "str"
    if value[:2] in ("b'", 'b"'):
        return "bytes"
    return "int" if INTEGER.match(value) else member


def deliteral(member: str) -> list[str]:
    """``Literal[...]`` as the types of its values; other members as they are."""
    if not (member.startswith("Literal[") and member.endswith("]")):
        return [member]
    values = [x.strip() for x in split_top(member[8:-1], ",")]
    return [_base_of(x, member) for x in (values[:-1] if values[-1] == "" else values)]


def generic_base(member: str) -> str:
    return member.partition("[")[0]


def union_members(text: str) -> list[str] | None:
    """Members with literals lowered; None if one says nothing about the type."""
    members = [x for m in split_union(text) for x in deliteral(m)]
    return None if any(generic_base(m) in OPAQUE for m in members) else members


def join(members: Iterable[str]) -> list[str]:
    """The members sorted, once each; an empty tuple goes where a longer one stands."""
    out = sorted(set(members))
    longer = any(m.startswith("tuple[") and m.endswith(", ...]") for m in out)
    return [m for m in out if not (longer and m == "tuple[()]")]


def return_of(signature: str) -> str | None:
    """What a callable returns, outer parentheses taken off."""
    parts = split_top(signature, " -> ")
    if len(parts) < 2 or not signature.startswith("("):
        return None
    out = parts[-1].strip()
    while out.startswith("(") and out.endswith(")") and _level(out[:-1]) >= 1:
        out = out[1:-1].strip()
    return out or None


def _level(text: str) -> int:
    """The least depth of brackets behind any character of text."""
    depth, least = 0, len(text)
    for c in text:
        depth += (c in OPENING) - (c in CLOSING)
        least = min(least, depth)
    return least


def _column(fn: Callable, kind: T.DataType):
    def run(text: pd.Series) -> pd.Series:
        known = {x: None if x is None else fn(x) for x in text.unique()}
        return text.map(lambda x: known.get(x))

    run.__annotations__ = {"text": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


union_members_of = _column(union_members, T.ArrayType(T.StringType()))
return_type_of = _column(return_of, T.StringType())
joined_union = _column(lambda x: None if (m := union_members(x)) is None else " | ".join(join(m)), T.StringType())
