"""Preference pairs from chosen and rejected conversations.

Method: the longest common turn prefix of the two conversations is found, turn
by turn on (role, text); it is rendered once as the prompt.  What follows in each
becomes its completion, with a mask: the character ranges of the completion that
belong to assistant turns, the only ones to learn from.  The prompt is all
masked.  Only built-in functions are used.

Turns are gathered per conversation; a conversation is one training example, so
its turns fit a row.  A completion must hold an assistant turn on both sides,
and the two must differ; ``status`` says why a pair is not usable.

Edge cases: turns are ordered by number, then role, then text; repeated turns stay; a null role
is ``user`` and a null text empty; a conversation that is missing on one side,
or has no turns, gives ``missing``; equal conversations give ``equal``; one
being a prefix of the other, or no assistant turn left, gives ``no_completion``.
Rows without a conversation id belong to no conversation and are left out; an empty
table gives no pairs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CLOSE = "\n<|end|>\n"


def gathered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): the ordered turns of each conversation."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = conversations.where(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return rows.select("conv", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def following(rows: DataFrame, key: str) -> DataFrame:
    """(key, next): each distinct key with the next greater one, null for the last.

    Keys are sorted in ranges; what crosses a range's border is looked up among the
    first keys of the ranges, one row for each of them."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key).distinct().repartitionByRange(parts, key).withColumn("__range", F.spark_partition_id())
    dealt = Scratch(spark, "following").table(dealt, "ranges")
    first = dealt.groupBy("__range").agg(F.min(key).alias("__first"))
    later = Window.orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    border = first.select("__range", F.min("__first").over(later).alias("__border"))
    inside = F.lead(key).over(Window.partitionBy("__range").orderBy(key))
    found = dealt.withColumn("__next", inside).join(F.broadcast(border), "__range")
    return found.select(key, F.coalesce("__next", "__border").alias("next"))


def _shown(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def mask(turns: Column) -> Column:
    """[start, stop) code-point ranges of assistant texts, end mark included."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + F.length(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")))
        stop = head + F.length(t["text"]) + F.lit(len(CLOSE))
        own = F.array(F.struct(head.cast("int").alias("start"), stop.cast("int").alias("stop")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct(stop.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of (role, text)) to one row each:
    prompt, chosen, rejected, their masks, prefix turns and a status."""
    c, r = F.col("chosen"), F.col("rejected")
    short = F.least(F.size(c), F.size(r))
    # the first place where the two differ, or the end of the shorter one
    same = F.transform(F.arrays_zip(F.slice(c, 1, short).alias("a"), F.slice(r, 1, short).alias("b")), lambda x: x["a"] == x["b"])
    gap = F.array_position(same, False)
    prefix = F.when(gap > 0, gap - 1).otherwise(short).cast("int")
    base = pairs.where("chosen is not null and rejected is not null").withColumn("prefix_turns", prefix)
    rest = {k: F.expr(f"slice({k}, prefix_turns + 1, greatest(size({k}) - prefix_turns, 0))") for k in ("chosen", "rejected")}
    cut = base.select(
        "pair_id", "prefix_turns", F.slice("chosen", 1, F.col("prefix_turns")).alias("head"), rest["chosen"].alias("c"), rest["rejected"].alias("r")
    )
    answers = [F.exists(x, lambda t: t["role"] == "assistant") for x in ("c", "r")]
    status = (
        F.when((F.size("c") == 0) & (F.size("r") == 0), "equal").when(~answers[0] | ~answers[1], "no_completion").otherwise("ok")
    )
    good = cut.select(
        "pair_id",
        "prefix_turns",
        rendered(F.col("head")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        rendered(F.col("r")).alias("rejected"),
        mask(F.col("c")).alias("chosen_mask"),
        mask(F.col("r")).alias("rejected_mask"),
        status.alias("status"),
    )
    lost = pairs.where("chosen is null or rejected is null").select(
        "pair_id",
        F.lit(0).alias("prefix_turns"),
        *(F.lit("").alias(x) for x in ("prompt", "chosen", "rejected")),
        *(F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias(x) for x in ("chosen_mask", "rejected_mask")),
        F.lit("missing").alias("status"),
    )
    return good.union(lost)
