"""Mixing sources to target weights, with DataFrame functions only.

Method: hierarchical budgeting.  Documents hang on a tree of levels, say domain,
language, source.  The token budget flows from the root down.  Among siblings it
is split by weight, but no node gets more than its subtree can give in
``max_epochs`` epochs; what a short node leaves is shared by its siblings in
proportion to their weights, so ancestors only see a shortage when all siblings
are exhausted.  The split has a closed form: with siblings sorted by supply per
weight, a node is exhausted while the spent supply plus its ratio times the
remaining weight fits the budget.  All arithmetic is on integers.

Each leaf then takes whole epochs and a prefix of one more, in the order of a
seeded hash of epoch and id.  The prefix is found by sums over hash buckets
first, then inside one bucket, so no task orders a whole leaf.

Weights come as {(level, name): integer}; a name not listed has weight 1.

Edge cases: null keys are nodes named like ``NULL_NAME``; null or empty texts
have no tokens: they cost nothing and go with their place in the order; rows
with the same id share one place and stand or fall together; a weight of 0 or
less drops the subtree; an empty table gives an empty mix.  Columns mix_<level>,
mix_tokens, mix_epoch and mix_taken are replaced; names that start with __mix_ are
reserved; all further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

NULL_NAME = "(null)"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


class MixtureBudget:
    """Budgets and selection for a tree of ``levels`` (column expressions by name)."""

    def __init__(
        self,
        levels: Mapping[str, Column],
        weights: Mapping[tuple[str, str], int] | None = None,
        max_epochs: int = 4,
        seed: int = 11,
        bucket_rows: int = 20_000,
    ):
        self.levels, self.weights = dict(levels), dict(weights or {})
        self.max_epochs, self.seed, self.bucket_rows = max_epochs, seed, bucket_rows

    def keyed(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """docs with mix_<level> keys, mix_tokens and __mix_id."""
        cols = {f"mix_{k}": F.coalesce(v.cast("string"), F.lit(NULL_NAME)) for k, v in self.levels.items()}
        return docs.withColumns({**cols, "mix_tokens": word_count(text), "__mix_id": F.coalesce(F.col(doc).cast("string"), F.lit(""))})

    def place(self, epoch: Column | str) -> Column:
        """The seeded place of a document in an epoch's order."""
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), epoch.cast("string") if isinstance(epoch, Column) else F.col(epoch).cast("string"), "__mix_id"))

    def _weight(self, level: str, key: str) -> Column:
        out = F.lit(1)
        for (lv, name), w in sorted(self.weights.items()):
            if lv == level:
                out = F.when(F.col(key) == name, max(0, w)).otherwise(out)
        return out.cast("long")

    def budgets(self, leaves: DataFrame, total: Column) -> DataFrame:
        """leaves (mix_<level>..., tokens) with ``budget`` for each leaf."""
        keys = [f"mix_{k}" for k in self.levels]
        nodes = leaves.withColumn("supply", F.col("tokens") * self.max_epochs)
        # a weightless node can give nothing, so its ancestors cannot count on it
        for level in self.levels:
            nodes = nodes.withColumn("supply", F.when(self._weight(level, f"mix_{level}") > 0, F.col("supply")).otherwise(0))
        frame = nodes.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        parent: DataFrame | None = None
        for k, level in enumerate(self.levels):
            own = keys[: k + 1]
            tier = frame.groupBy(*own).agg(F.sum("supply").alias("supply"))
            tier = tier.withColumn("w", self._weight(level, own[-1]))
            if parent is None:
                tier = tier.withColumn("given", F.least(total, F.sum("supply").over(Window.partitionBy(F.lit(0)))))
            else:
                tier = tier.join(parent, own[:-1])
            parent = self._split(tier, own).select(*own, F.col("got").alias("given"))
        return frame.join(parent, keys).select(*keys, "tokens", F.col("given").alias("budget"))

    def _split(self, tier: DataFrame, own: list[str]) -> DataFrame:
        """Share ``given`` among siblings by weight, capped by supply."""
        up = own[:-1] or [F.lit(0)]
        live = tier.withColumn("ratio", F.when(F.col("w") > 0, F.col("supply").cast("double") / F.col("w")))
        by_ratio = Window.partitionBy(*up).orderBy(F.asc_nulls_first("ratio"), own[-1])
        before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
        after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
        live = live.withColumn("spent", F.coalesce(F.sum("supply").over(before), F.lit(0))).withColumn("rest_w", F.sum("w").over(after))
        big = "decimal(38,0)"
        full = (F.col("w") <= 0) | (
            F.col("supply").cast(big) * F.col("rest_w").cast("decimal(18,0)")
            <= (F.col("given") - F.col("spent")).cast(big) * F.col("w").cast("decimal(18,0)")
        )
        live = live.withColumn("full", full)
        every = Window.partitionBy(*up)
        left = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(every), F.lit(0))
        pool = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
        upto = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
        live = live.withColumn("left", left).withColumn("pool", pool).withColumn("upto", upto)
        return live.withColumn("got", F.expr("case when full then supply else (left * upto) div pool - (left * (upto - w)) div pool end"))

    def plan(self, docs: DataFrame, scratch: Scratch, total: int | None = None, percent: int = 100) -> tuple[DataFrame, DataFrame]:
        """(slim, cuts): slim has a row per document, cuts one per leaf with
        tokens, budget, full epochs, and the place where the last epoch ends."""
        keys = [f"mix_{k}" for k in self.levels]
        slim = scratch.table(docs.groupBy(*keys, "__mix_id").agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows")), "slim")
        leaves = slim.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
        leaves = scratch.table(leaves, "leaves")
        spread = self.budgets(leaves, F.lit(total) if total is not None else F.lit((leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100))
        cuts = spread.join(leaves.select(*keys, "docs"), keys).withColumn("epochs", F.expr("case when tokens > 0 then budget div tokens else 0 end"))
        cuts = cuts.withColumn("part", F.col("budget") - F.col("epochs") * F.col("tokens"))
        cuts = scratch.table(cuts.withColumn("buckets", F.expr(f"1 + docs div {self.bucket_rows}")), "cuts")
        # the first place whose tokens reach the budget's rest
        at = self.place("epochs")
        spot = slim.join(cuts.where("part > 0").select(*keys, "epochs", "part", "buckets"), keys).withColumn("at", at)
        spot = spot.withColumn("bucket", F.expr("(cast(conv(substring(at, 1, 8), 16, 10) as bigint) * buckets) div 4294967296"))
        spot = scratch.table(spot.select(*keys, "part", "bucket", "at", "n"), "places")
        sums = spot.groupBy(*keys, "part", "bucket").agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).where("base < part and base + n >= part")
        inside = Window.partitionBy(*keys, "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        held = spot.drop("part").join(sums.select(*keys, "bucket", "base", "part"), [*keys, "bucket"])
        held = held.withColumn("start", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("start < part")
        ends = held.groupBy(*keys).agg(F.max("at").alias("last"), F.max_by(F.col("part") - F.col("start"), "at").alias("last_tokens"))
        return slim, scratch.table(cuts.join(ends, keys, "left"), "ends")

    def select(self, docs: DataFrame, total: int | None = None, percent: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
        """docs in the mix: one row per document and epoch, with ``mix_epoch``
        and ``mix_taken`` (tokens that the leaf's budget takes of it)."""
        scratch = Scratch(docs.sparkSession, "mixing")
        keyed = self.keyed(docs, doc, text)
        keys = [f"mix_{k}" for k in self.levels]
        _, cuts = self.plan(keyed.select(*keys, "__mix_id", "mix_tokens"), scratch, total, percent)
        ends = cuts.select(*keys, *(F.col(c).alias(f"__mix_{c}") for c in ("epochs", "last", "last_tokens")))
        joined = keyed.join(ends, keys)
        at = self.place("__mix_epochs")
        part = F.when(F.col("__mix_last").isNotNull() & (at <= F.col("__mix_last")), 1).otherwise(0)
        times = F.expr("__mix_epochs").cast("int") + part
        out = joined.withColumn("__mix_at", at).withColumn("__mix_times", times).where("__mix_times > 0")
        out = out.withColumn("mix_epoch", F.explode(F.expr("sequence(0, __mix_times - 1)")))
        cut = (F.col("mix_epoch") == F.col("__mix_epochs")) & (F.col("__mix_at") == F.col("__mix_last"))
        taken = F.when(cut, F.least("mix_tokens", "__mix_last_tokens")).otherwise(F.col("mix_tokens"))
        new = [*keys, "mix_tokens", "mix_epoch", "mix_taken"]
        rest = [f"`{c}`" for c in docs.columns if c not in new]
        return out.withColumn("mix_taken", taken).select(*rest, *new)
