"""Mining of repeats, combinations and runs."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import digest
from .lineage import settled


def duplicate_groups(df: DataFrame, text: str, member: str, least: int = 2) -> DataFrame:
    """Digest, size and first member of each group of equal texts."""
    keyed = df.where(F.col(text).isNotNull()).select(digest(F.col(text)).alias("key"), F.col(member).alias("member"))
    return keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("member").alias("first")).where(F.col("copies") >= least)


def repeated_windows(seqs: DataFrame, seq: str, pos: str, value: str, size: int = 5) -> DataFrame:
    """(key, seq, start) of value windows that occur twice or more."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(0, size - 1)
    rows = seqs.withColumn("__w", F.collect_list(value).over(w)).where(F.size("__w") == size)
    keyed = rows.select(F.sha2(F.array_join("__w", "\n"), 256).alias("key"), F.col(seq).alias("seq"), F.col(pos).alias("start"))
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("runs")).where("runs > 1"), "key")


class FactorIndex:
    """All factors of several sequences as an automaton: a state stands for factors
    that end at the same places, and ``longest`` is the length of the longest."""

    def __init__(self, sequences: Sequence[Sequence[str]]):
        self.sequences = sequences
        self.moves: list[dict[str, int]] = [{}]
        self.parent, self.longest = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for s, words in enumerate(sequences):
            at = 0
            for p, word in enumerate(words):
                at = self._step(at, word)
                self.ends[at].append((s, p))

    def _state(self, longest: int, moves: dict[str, int], parent: int) -> int:
        self.moves.append(moves)
        self.parent.append(parent)
        self.longest.append(longest)
        self.ends.append([])
        return len(self.moves) - 1

    def _step(self, at: int, word: str) -> int:
        there = self.moves[at].get(word)
        if there is not None:
            return there if self.longest[there] == self.longest[at] + 1 else self._split(at, word, there)
        new = self._state(self.longest[at] + 1, {}, 0)
        while at >= 0 and word not in self.moves[at]:
            self.moves[at][word] = new
            at = self.parent[at]
        if at >= 0:
            there = self.moves[at][word]
            self.parent[new] = there if self.longest[there] == self.longest[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: str, there: int) -> int:
        new = self._state(self.longest[at] + 1, dict(self.moves[there]), self.parent[there])
        self.parent[there] = new
        while at >= 0 and self.moves[at].get(word) == there:
            self.moves[at][word] = new
            at = self.parent[at]
        return new

    def repeats(self, size: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """(length, [(sequence, start)]) of every repeat of ``size`` or more that can
        be extended neither to the left nor to the right at all of its places.  The
        longest factor of a state cannot to the left; it can to the right if each
        place goes on, and with the same move."""
        found = []
        places = [list(x) for x in self.ends]
        for v in sorted(range(1, len(self.moves)), key=self.longest.__getitem__, reverse=True):
            n, at = self.longest[v], places[v]
            if n < size:
                continue
            whole = len(self.moves[v]) == 1 and all(p + 1 < len(self.sequences[s]) for s, p in at)
            if len(at) > 1 and not whole:
                found.append((n, [(s, p - n + 1) for s, p in at]))
            places[self.parent[v]] += at
        return found


def maximal_repeats(
    seqs: DataFrame, seq: str, pos: str, value: str, prod: str | None = None, size: int = 5, nodes: str | None = None, floor: int = 0, whole: str | None = None
) -> DataFrame:
    """(key, length, seq, start) of maximal repeats of ``size`` or more values.

    Runs of less than ``floor`` nodes do not count, nor repeats all of whose runs are
    ``whole`` sequences.  Of runs that overlap in a sequence the earliest stay; two
    must be left, one of them in production code.  A repeat falls if each of its runs
    lies inside a run of a longer one: being inside carries over, so it does not
    matter whether that one falls itself.

    Only sequences that share a window with another matter: they are grouped by
    connected component of shared windows, and each component's automaton finds its
    repeats.  Their choice is a plan of aggregates and windows over all of them."""
    from .graph_undirected import undirected_components

    windows = repeated_windows(seqs, seq, pos, value, size).select("key", "seq")
    first = windows.groupBy("key").agg(F.min("seq").alias("a"))
    links = windows.join(first, "key").select(F.col("seq").alias("src"), F.col("a").alias("dst")).distinct()
    comp = undirected_components(links).withColumnRenamed("node", seq)
    order = F.struct(F.col(pos).alias("p"), F.col(value).alias("v"), (F.col(nodes) if nodes else F.lit(1)).cast("long").alias("n"))
    flags = [F.max(F.col(c) if c else F.lit(default)).alias(k) for k, c, default in (("prod", prod, True), ("body", whole, False))]
    rows = seqs.join(comp, seq).groupBy("root", seq).agg(F.sort_array(F.collect_list(order)).alias("t"), *flags)
    rows = rows.select("root", F.col(seq).alias("seq"), F.col("t.p").alias("ps"), F.col("t.v").alias("vs"), F.col("t.n").alias("ns"), "prod", "body")

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [list(x) for x in pdf["vs"]]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in pdf["ns"]]
        out = []
        for n, runs in FactorIndex(values).repeats(size):
            s, p = runs[0]
            key = hashlib.sha256("\n".join(values[s][p : p + n]).encode()).hexdigest()[:12]
            for s, p in runs:
                full = bool(pdf["body"].iat[s]) and n == len(values[s])
                out.append((key, n, pdf["seq"].iat[s], p, int(pdf["ps"].iat[s][p]), int(sums[s][p + n] - sums[s][p]), full, bool(pdf["prod"].iat[s])))
        return pd.DataFrame(out, columns=["key", "length", "seq", "place", "start", "nodes", "full", "prod"])

    kind = dict(seqs.dtypes)[seq]
    found = settled(rows.groupBy("root").applyInPandas(mine, f"key string, length long, seq {kind}, place long, start long, nodes long, full boolean, prod boolean"))
    big = found.where(F.col("nodes") >= floor)
    partial = big.groupBy("key", "length").agg(F.bool_and("full").alias("f"), F.count("*").alias("n")).where("not f and n > 1").select("key", "length")
    apart = big.join(partial, ["key", "length"]).groupBy("key", "length", "seq", "prod").agg(F.sort_array(F.collect_list(F.struct("place", "start"))).alias("r"))
    free = F.aggregate(
        "r",
        F.slice("r", 1, 0),
        lambda kept, x: F.when((F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["place"] + F.col("length") <= x["place"]), F.concat(kept, F.array(x))).otherwise(kept),
    )
    apart = apart.select("key", "length", "seq", "prod", F.explode(free).alias("x")).select("key", "length", "seq", "prod", "x.*")
    enough = apart.groupBy("key", "length").agg(F.count("*").alias("n"), F.bool_or("prod").alias("some")).where("n > 1 and some").select("key", "length")
    runs = apart.join(enough, ["key", "length"])
    before = Window.partitionBy("seq").orderBy("place", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.col("place") + F.col("length")).over(before) >= F.col("place") + F.col("length"), F.lit(False))
    marked = runs.withColumn("inside", inside)
    covered = marked.groupBy("key", "length").agg(F.bool_and("inside").alias("all")).where("all").select("key", "length")
    return marked.join(covered, ["key", "length"], "left_anti").select("key", "length", "seq", "start")


def combination_groups(df: DataFrame, owner: str, item: str, size: int = 3, least: int = 3, most_items: int = 15) -> DataFrame:
    """Item sets shared by the same owners: combinations of ``size`` items of
    owners with size..most_items items, found in ``least`` owners or more; those
    with identical owner sets are united."""
    sets = df.select(owner, item).distinct().groupBy(owner).agg(F.sort_array(F.collect_set(item)).alias("items"))
    sets = sets.where(F.size("items").between(size, most_items))
    level = sets.select(owner, "items", F.explode("items").alias("x")).select(owner, "items", F.array("x").alias("combo"))
    for _ in range(size - 1):
        after = F.filter("items", lambda y: y > F.element_at("combo", -1))
        level = level.select(owner, "items", "combo", F.explode(after).alias("x")).select(owner, "items", F.concat("combo", F.array("x")).alias("combo"))
    # owners are counted first, so that no list is made of a combination that one owner has
    shared = level.groupBy("combo").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("combo")
    owners = level.join(shared, "combo").groupBy("combo").agg(F.sort_array(F.collect_set(owner)).alias("owners"))
    return owners.groupBy("owners").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("combo")))).alias("items"))


def best_per_anchor(groups: DataFrame) -> DataFrame:
    """For each first owner the group with most owners, then most items, then the
    greatest joined names."""
    names = F.concat_ws(",", F.col("items").cast("array<string>"))
    w = Window.partitionBy(F.element_at("owners", 1)).orderBy(F.size("owners").desc(), F.size("items").desc(), names.desc())
    return groups.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def runs(df: DataFrame, group: Sequence[str], at: str) -> DataFrame:
    """Consecutive positions of a group as runs: start, stop and length."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*group).orderBy(at))
    rows = df.select(*group, at).distinct().withColumn("__i", island)
    return rows.groupBy(*group, "__i").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("length")).drop("__i")
