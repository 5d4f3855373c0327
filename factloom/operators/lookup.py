"""Joins beyond equality, each turned into an equi-join on a small key set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dotted_prefixes


def longest_prefix(df: DataFrame, name: str, table: DataFrame, key: str, value: str, sep: str = ".") -> DataFrame:
    """df with the value of the longest listed prefix of ``name``; null if none.
    Each distinct name is looked up once."""
    names = df.select(F.col(name).alias("__n")).distinct()
    cut = names.select("__n", F.posexplode(dotted_prefixes(F.col("__n"), sep)).alias("__k", key))
    best = cut.join(table.select(key, value), key).groupBy("__n").agg(F.min_by(F.struct(key, value), "__k").alias("__b"))
    return df.join(best, F.col(name) == F.col("__n"), "left").select(*df.columns, F.col(f"__b.{key}").alias(key), F.col(f"__b.{value}").alias(value))


def innermost_interval(points: DataFrame, spans: DataFrame, group: Sequence[str], at: str, lo: str, hi: str, cell: int) -> DataFrame:
    """Each point with the shortest span of its group that holds it; ties to the
    smaller start.  Spans are cut into cells so that only an equi-join is needed."""
    p = points.select(*group, at).distinct().withColumn("__cell", F.expr(f"floor({at} / {cell})"))
    s = spans.withColumn("__cell", F.explode(F.expr(f"sequence(floor({lo} / {cell}), floor({hi} / {cell}))")))
    keep = [c for c in spans.columns if c not in group]
    hit = p.join(s, [*group, "__cell"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))
    best = hit.groupBy(*group, at).agg(F.min_by(F.struct(*keep), F.struct(F.col(hi) - F.col(lo), F.col(lo))).alias("__b"))
    return points.join(best, [*group, at], "left").select(*points.columns, *(F.col(f"__b.{c}").alias(c) for c in keep))


def group_max_in_spans(points: DataFrame, spans: DataFrame, group: str, at: str, lo: str, hi: str, value: str, cell: int) -> DataFrame:
    """Per span its greatest value, null if any position of it has none.  A span
    meets the points of its cells, of ``cell`` positions each."""
    keys = spans.columns
    cells = spans.distinct().withColumn("__cell", F.explode(F.expr(f"sequence(floor({lo} / {cell}), floor({hi} / {cell}))")))
    p = points.select(group, F.col(at).alias("__at"), F.col(value).alias("__v"), F.expr(f"floor({at} / {cell})").alias("__cell"))
    inside = cells.join(p, [group, "__cell"]).where((F.col("__at") >= F.col(lo)) & (F.col("__at") <= F.col(hi)))
    found = inside.groupBy(*keys).agg(F.max("__v").alias("__max"), F.bool_and(F.col("__v").isNotNull()).alias("__all"), F.countDistinct("__at").alias("__n"))
    whole = F.col("__all") & (F.col("__n") == F.col(hi) - F.col(lo) + 1)
    return spans.distinct().join(found, keys, "left").select(*keys, F.when(whole, F.col("__max")).alias(value))


def pattern_semi(df: DataFrame, name: str, patterns: DataFrame) -> DataFrame:
    """Rows whose name starts and ends as some (prefix, suffix) says.  The join
    key is the prefix; its lengths are few and known."""
    sizes = [r[0] for r in patterns.select(F.length("prefix")).distinct().collect()]
    if not sizes:
        return df.limit(0)
    names = df.select(F.col(name).alias("__n")).distinct()
    cut = names.select("__n", F.explode(F.array(*(F.substring("__n", 1, n) for n in sorted(sizes)))).alias("prefix"))
    hit = cut.join(patterns, "prefix")
    hit = hit.where(F.col("__n").endswith(F.col("suffix")) & (F.length("__n") >= F.length("prefix") + F.length("suffix")))
    return df.join(hit.select("__n").distinct(), F.col(name) == F.col("__n"), "left_semi")


def only_from(refs: DataFrame, target: str, allowed: Column) -> DataFrame:
    """Targets all of whose references are allowed; there is at least one."""
    return refs.groupBy(target).agg(F.count("*").alias("refs"), F.bool_and(F.coalesce(allowed, F.lit(False))).alias("__all")).where("__all").drop("__all")


def unique_or_null(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A lookup that answers only where the key has one distinct value."""
    return df.groupBy(*key).agg(F.countDistinct(value).alias("__n"), F.first(value).alias(value)).where("__n = 1").drop("__n")


def resolve_all(sites: DataFrame, site: str, targets: str, definitions: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(site, resolution, answers): a site is resolved if all its targets have one
    answer each and these agree, ambiguous if they differ, else unresolved."""
    one = unique_or_null(definitions, key, value)
    each = sites.select(site, F.explode_outer(targets).alias("__t")).select(site, *(F.col(f"__t.{k}").alias(k) for k in key))
    found = each.join(one, list(key), "left").groupBy(site)
    out = found.agg(F.bool_and(F.col(value).isNotNull()).alias("__all"), F.sort_array(F.collect_set(value)).alias("answers"))
    status = F.when(~F.col("__all"), "unresolved").when(F.size("answers") == 1, "resolved").otherwise("ambiguous")
    return out.select(site, status.alias("resolution"), F.when(F.col("__all"), F.col("answers")).alias("answers"))


def carry(now: DataFrame, before: DataFrame, key: Sequence[str], site: Sequence[str], value: str) -> DataFrame:
    """Values carried over by exact key, else by the site if it names one
    unclaimed row on each side."""
    key, site = list(key), list(site)
    old = before.select(*dict.fromkeys([*key, *site]), F.col(value).alias("__v"))
    exact = now.join(old.select(*key, "__v"), key).select(*now.columns, F.col("__v").alias(value), F.lit("key").alias("carried"))
    alone = lambda df, other: df.join(other.select(*key).distinct(), key, "left_anti").withColumn("__c", F.count("*").over(Window.partitionBy(*site)))
    left = alone(old, now).where("__c = 1").select(*site, "__v", F.lit(True).alias("__one"))
    rest = alone(now, old).join(left, site, "left")
    one = (F.col("__c") == 1) & F.col("__one")
    moved = rest.select(*now.columns, F.when(one, F.col("__v")).alias(value), F.when(one, "site").alias("carried"))
    return exact.union(moved)
