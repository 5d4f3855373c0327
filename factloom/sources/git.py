"""Change lists and line ages from a git repository, as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pytext import epoch_days
from ..operators.lookup import group_max_in_spans

BLAME = "rel string, line long, ts long"


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=False)
    except OSError:
        return None
    return done.stdout if done.returncode == 0 else None


def changed_files(spark: SparkSession, root: str, since: str | None = None) -> DataFrame | None:
    """(rel): files that differ from ``since`` or from the index, and untracked ones;
    None outside a repository."""
    asked = [("diff", "--name-only", "--cached"), ("diff", "--name-only"), ("ls-files", "--others", "--exclude-standard")]
    if since:
        asked[0] = ("diff", "--name-only", since)
    told = [_git(root, *a) for a in asked]
    if told[0] is None and told[1] is None:
        return None
    names = sorted({x.strip() for t in told if t for x in t.splitlines() if x.strip()})
    return spark.createDataFrame([(x,) for x in names], "rel string")


def blame_lines(text: str, rel: str) -> list[tuple[str, int, int]]:
    """(rel, line, commit time) of ``git blame --line-porcelain`` output."""
    out, line, ts = [], 0, 0
    for row in text.split("\n"):
        head = row.split(" ")
        if row.startswith("\t"):
            out.append((rel, line, ts))
        elif head[0] == "committer-time":
            ts = int(head[1])
        elif len(head) >= 3 and len(head[0]) == 40 and head[2].isdigit():
            line = int(head[2])
    return out


def blame(spark: SparkSession, root: str, rels: Sequence[str]) -> DataFrame:
    """(rel, line, ts) of some files; a file without history has no rows."""
    rows = [r for rel in rels if (t := _git(root, "blame", "--line-porcelain", "--", rel)) is not None for r in blame_lines(t, rel)]
    return spark.createDataFrame(rows, BLAME)


def youngest_ages(spans: DataFrame, lines: DataFrame, now: int, cell: int = 64) -> DataFrame:
    """(group, days): whole days since the newest commit in any span of a group; null
    if a span has a line without history.  spans (group, rel, lo, hi)."""
    newest = group_max_in_spans(lines, spans, "rel", "line", "lo", "hi", "ts", cell)
    per = newest.groupBy("group").agg(F.max("ts").alias("ts"), F.bool_and(F.col("ts").isNotNull()).alias("known"))
    return per.select("group", F.when(F.col("known"), epoch_days(F.lit(now), F.col("ts"))).alias("days"))
