"""Operators over a findings-shaped table: order, baseline, suppression, fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "within") -> DataFrame:
    """0-based position in a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows with their 1-based ``rank``, and how many were ``cut``."""
    total = df.agg(F.count("*").alias("total"))
    first = df.orderBy(*order).limit(n)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.crossJoin(F.broadcast(total)).withColumn("cut", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def snapshot(df: DataFrame, key: Sequence[str], shape: str, order: str) -> DataFrame:
    """Count per key, and the shape of its first row."""
    return df.groupBy(*key).agg(F.count("*").alias("count"), F.min_by(shape, order).alias("shape"))


def prune(baseline: DataFrame, now: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of both, the smaller count, today's shape."""
    new = now.select(*key, F.col("count").alias("__n"), F.col("shape").alias("__s"))
    return baseline.join(new, list(key)).select(*key, F.least("count", "__n").alias("count"), F.col("__s").alias("shape"))


def merge_baseline(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key of a merged file: the one with the larger count."""
    return rows.groupBy(*key).agg(F.max_by(F.struct("count", "shape"), F.struct("count", "shape")).alias("r")).select(*key, "r.*")


def moved_budget(missing: DataFrame, pool: DataFrame, shape: Sequence[str], order: str) -> DataFrame:
    """Pairs keys missing from the baseline with unclaimed entries of one shape,
    both in order: the k-th of one side takes the k-th of the other."""
    rank = lambda df: df.where(F.col(shape[-1]).isNotNull()).withColumn("__k", F.row_number().over(Window.partitionBy(*shape).orderBy(order)))
    left, right = rank(missing), rank(pool)
    extra = [c for c in right.columns if c not in (*shape, "__k")]
    return left.join(right.select(*shape, "__k", *(F.col(c).alias(f"from_{c}") for c in extra)), [*shape, "__k"]).drop("__k")


def budgeted_diff(df: DataFrame, budgets: DataFrame, key: Sequence[str], order: Sequence[Column], line: str | None = None) -> DataFrame:
    """Rows beyond their key's budget, with the ``budget``; ``lines`` lists all
    places of the key when its budget is above 0."""
    by_key = Window.partitionBy(*key)
    ranked = df.withColumn("place", F.row_number().over(by_key.orderBy(*order)))
    if line:
        ranked = ranked.withColumn("lines", F.sort_array(F.collect_list(line).over(by_key)))
    joined = ranked.join(budgets.select(*key, F.col("count").alias("budget")), list(key), "left")
    joined = joined.withColumn("budget", F.coalesce("budget", F.lit(0)))
    return joined.where(F.col("place") > F.col("budget"))


def absorbed(df: DataFrame, budgets: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many rows the budgets take, in one row."""
    n = df.groupBy(*key).agg(F.count("*").alias("__n")).join(budgets, list(key))
    return n.agg(F.coalesce(F.sum(F.least("__n", "count")), F.lit(0)).alias("absorbed"))


def marker_table(lines: DataFrame, prefix: str, comment: str, tag: str = "allow") -> DataFrame:
    """Suppression markers ``<prefix> tag: a, b`` or ``tag-file:``.  lines has
    (rel, line, text); out comes (rel, line, name): line 0 covers the file, a
    comment-only line the next line, any other its own.  The first marker of a
    line counts."""
    pattern = rf"{prefix}\s*{tag}(-file)?:\s*([A-Za-z0-9_, -]+)"
    hit = lines.where(F.col("text").rlike(pattern))
    whole = F.regexp_extract("text", pattern, 1) == "-file"
    alone = F.regexp_replace("text", r"^[ \t]+", "").startswith(comment)
    at = F.when(whole, 0).when(alone, F.col("line") + 1).otherwise(F.col("line"))
    names = F.split(F.trim(F.regexp_extract("text", pattern, 2)), r"[\s,]+")
    return hit.select("rel", at.alias("line"), F.explode(names).alias("name")).where("name <> ''").distinct()


def suppress(findings: DataFrame, markers: DataFrame, symbols: DataFrame) -> DataFrame:
    """findings with ``suppressed``: a marker names the rule for the whole file,
    for the line, or on the line of a definition that holds the symbol.  Each
    way is one equi-join; none compares all pairs."""
    m = markers.select("rel", F.col("line").alias("__line"), F.col("name").alias("rule")).distinct()
    on_line = m.withColumn("__hit", F.lit(True))
    by_file = findings.join(m.where("__line = 0").select("rel", "rule").distinct(), ["rel", "rule"], "left_semi").select("ord")
    by_line = findings.withColumn("__line", F.col("line")).join(on_line.drop("__hit"), ["rel", "rule", "__line"], "left_semi").select("ord")
    opened = symbols.select("rel", F.col("line").alias("__line"), F.col("qname").alias("__owner")).join(m.where("__line > 0"), ["rel", "__line"]).select("rule", "__owner").distinct()
    # every enclosing name of the symbol, by . and by ::
    owners = F.array_union(_prefixes("symbol", "."), _prefixes("symbol", "::"))
    by_def = findings.select("ord", "rule", F.explode(owners).alias("__owner")).join(opened, ["rule", "__owner"], "left_semi").select("ord")
    hits = by_file.union(by_line).union(by_def).distinct().withColumn("suppressed", F.lit(True))
    return findings.join(hits, "ord", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def _prefixes(column: str, sep: str) -> Column:
    parts = F.split(F.col(column), sep.replace(".", r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep))


def rollup_order(df: DataFrame, file: Sequence[str], symbol: Sequence[str], rank: str, late: Column) -> DataFrame:
    """Position in a report: files by their best rank, late ones last, symbols
    inside by their best rank."""
    best_file = F.min(rank).over(Window.partitionBy(*file))
    best_symbol = F.min(rank).over(Window.partitionBy(*file, *symbol))
    both = df.withColumn("file_rank", best_file).withColumn("symbol_rank", best_symbol).withColumn("is_late", late)
    return both.orderBy("is_late", "file_rank", "symbol_rank", rank)


def compose_fixes(edits: DataFrame) -> DataFrame:
    """Fixes that can be applied together.  edits: (fix, rel, line, deletes).  A
    fix falls if it edits a line that another one deletes, or if the lines it
    deletes are a strict subset of another's.  Decided at once, not in turn."""
    gone = edits.where("deletes").select("fix", "rel", "line").distinct()
    touched = edits.where("not deletes").select(F.col("fix").alias("__f"), "rel", "line").distinct()
    clash = touched.join(gone, ["rel", "line"]).where("__f <> fix").select(F.col("__f").alias("fix"))
    size = gone.groupBy("fix").agg(F.count("*").alias("n"))
    other = gone.select(F.col("fix").alias("other"), "rel", "line")
    shared = gone.join(other, ["rel", "line"]).where("fix <> other").groupBy("fix", "other").agg(F.count("*").alias("both"))
    inside = (
        shared.join(size, "fix").join(size.select(F.col("fix").alias("other"), F.col("n").alias("m")), "other").where("both = n and n < m").select("fix")
    )
    return edits.select("fix").distinct().join(clash.union(inside).distinct(), "fix", "left_anti")
