"""Path and name predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_DIRS = ("tests", "test", "testing")
BENCH_DIRS = ("tests", "benches", "examples")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses slashes."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def fnmatch(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Any whole segment equals a pattern, or the path matches it as a shell
    pattern, or it is a leading directory."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.array_contains(F.split(rel, "/"), p) | fnmatch(rel, p) | rel.startswith(p.rstrip("/") + "/")
    return out


def under(rel: Column, prefixes: list[str]) -> Column:
    """True if there are no prefixes, or one equals or leads the path."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        p = p.rstrip("/")
        out = out | (rel == p) | rel.startswith(p + "/")
    return out


def is_test_path(rel: Column) -> Column:
    """A test directory among the folders, or a test file name."""
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, TEST_DIRS))) | name.rlike(r"^test_.*|.*_test\.py$|^conftest\.py$")


def is_bench_path(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, BENCH_DIRS)))


def dotted_prefixes(name: Column, sep: str = ".") -> Column:
    """All prefixes of a dotted name, longest first."""
    parts = F.split(name, re.escape(sep))
    upto = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.transform(upto, lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def owner_list(names: Column, most: int = 3) -> Column:
    """The first few names, then how many more there are."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" +"), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def digest(text: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, size)
