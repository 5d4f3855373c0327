"""Strings as Python sees them, as built-in column functions where that is possible."""

from __future__ import annotations

import ast
import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what Python's str.strip and str.splitlines take for white space and line ends
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0  -     　"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+\\z", "")


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def words(text: Column) -> Column:
    """``str.split()``: the runs between white space."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def splitlines(text: Column) -> Column:
    """``str.splitlines()``: what follows the last line end counts if there is any."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def partition(text: Column, sep: str) -> Column:
    """(head, sep, tail) at the first separator; all is head without one."""
    at = F.instr(text, sep)
    head, tail = F.substring_index(text, sep, 1), F.substr(text, at + F.lit(len(sep)))
    return F.when(at > 0, _three(head, F.lit(sep), tail)).otherwise(_three(text, F.lit(""), F.lit("")))


def rpartition(text: Column, sep: str) -> Column:
    """(head, sep, tail) at the last separator; all is tail without one."""
    tail = F.substring_index(text, sep, -1)
    head = F.substr(text, F.lit(1), F.length(text) - F.length(tail) - F.lit(len(sep)))
    return F.when(F.instr(text, sep) > 0, _three(head, F.lit(sep), tail)).otherwise(_three(F.lit(""), F.lit(""), text))


def _three(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.alias("head"), b.alias("sep"), c.alias("tail"))


def removeprefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def is_digit(text: Column) -> Column:
    return text.rlike(r"^\p{Nd}+\z")


def is_upper_first(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}")


@F.pandas_udf(T.BooleanType())
def is_identifier(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.isidentifier())


@F.pandas_udf(T.StringType())
def literal_repr(source: pd.Series) -> pd.Series:
    """The repr of a literal as written in source; null if it is none."""

    def one(text: str | None) -> str | None:
        try:
            return repr(ast.literal_eval(text)) if text is not None else None
        except (ValueError, SyntaxError, MemoryError):
            return None

    return source.map(one)


@F.pandas_udf(T.StringType())
def format_g(value: pd.Series) -> pd.Series:
    """A number as ``%g`` writes it."""
    return value.map(lambda x: None if x is None or pd.isna(x) else f"{x:g}")


@F.pandas_udf(T.StringType())
def normpath(path: pd.Series) -> pd.Series:
    """A path without ``.``, ``..`` and empty parts; one leading slash at most."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out = posixpath.normpath(text)
        return out[1:] if out.startswith("//") else out

    return path.map(one)


def posix_join(base: Column, rest: Column) -> Column:
    """rest on its own if it is rooted or base is empty, else both with one slash."""
    between = F.when(base.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(rest.startswith("/") | (base == ""), rest).otherwise(F.concat(base, between, rest))


def epoch_days(later: Column, earlier: Column) -> Column:
    """Whole days between two epoch seconds."""
    return F.floor((later - earlier) / F.lit(86_400)).cast("long")
