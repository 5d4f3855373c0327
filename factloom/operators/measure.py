"""Operators of the measuring side: samples, tallies, rates, profiles, buckets."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import rank_in_ranges


def stratified_sample(df: DataFrame, stratum: str, order: Sequence[Column], each: int = 20, seed: int = 20260851) -> DataFrame:
    """``each`` rows of every stratum, all of a small one.  One generator is
    advanced across the strata in name order; small strata draw nothing.  Only
    stratum sizes and chosen positions pass through the driver; positions come from
    a sort in ranges, so a stratum of any size is spread over tasks."""
    sizes = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    rng = random.Random(seed)
    picks = []
    for name in sorted(sizes, key=lambda x: (x is None, x)):
        n = sizes[name]
        chosen = range(n) if n <= each else rng.sample(range(n), each)
        picks += [(name, k) for k in chosen]
    schema = f"`{stratum}` {df.schema[stratum].dataType.simpleString()}, __k int"
    wanted = df.sparkSession.createDataFrame(picks, schema)
    wanted = F.broadcast(wanted.select(F.col(stratum).alias("__s"), (F.col("__k") + 1).alias("__p")))
    ranked = rank_in_ranges(df, [stratum], order, "__k")
    return ranked.join(wanted, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__k") == F.col("__p")), "left_semi").drop("__k")


def tally(df: DataFrame, sets: Sequence[Sequence[str]], verdict: str) -> DataFrame:
    """Verdict counts by each of several key sets, in one pass."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets([[F.col(c) for c in (*s, verdict)] for s in sets], *(F.col(c) for c in (*keys, verdict))).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n")
    )


def judged(counts: DataFrame, bar: float, least: int) -> DataFrame:
    """PASS, FAIL above the bar's share of false ones, THIN below ``least``."""
    rate = F.col("tp") / F.col("n")
    return counts.withColumn("verdict", F.when(F.col("n") < least, "THIN").when(rate < bar, "FAIL").otherwise("PASS"))


def fire_rates(df: DataFrame, rule: str, place: str, places: Sequence) -> DataFrame:
    """Counts by rule and place, zero where a rule never fires."""
    return df.groupBy(rule).pivot(place, list(places)).agg(F.count(F.lit(1))).na.fill(0)


def grown(now: DataFrame, before: DataFrame, label: str, value: str, times: float = 2.0, plus: float = 0.1) -> DataFrame:
    """Labels whose value exceeds the larger of ``times`` and ``plus`` more."""
    old = before.select(label, F.col(value).alias("before"))
    both = now.select(label, F.col(value).alias("now")).join(old, label)
    return both.where(F.col("now") > F.greatest(F.col("before") * times, F.col("before") + plus))


def line_buckets(df: DataFrame, rules: Sequence[tuple[str, Column]], rest: str, lines: Column) -> DataFrame:
    """Files and lines by the first rule that holds."""
    bucket = F.lit(rest)
    for name, cond in reversed(list(rules)):
        bucket = F.when(cond, name).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.sum(lines).alias("lines"))


def world_diff(base: DataFrame, now: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of now whose key base does not have."""
    return now.join(base.select(*key).distinct(), list(key), "left_anti")
