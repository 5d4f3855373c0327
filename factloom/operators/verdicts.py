"""Verdicts over call graphs and symbols: overrides, closed worlds, counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import class_closure
from .lineage import settled


def override_expansion(sites: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(site, resolution, candidates): a call to a method of a class may reach that
    class's method or one of any subclass that has it.  sites (site, owner, name),
    classes (child, base), methods (owner, name)."""
    below = class_closure(classes.select(F.col("base").alias("child"), F.col("child").alias("base")), sites.select(F.col("owner").alias("src")).distinct())
    targets = sites.join(below.select(F.col("src").alias("owner"), F.col("dst").alias("holder")), "owner")
    held = targets.join(methods.select(F.col("owner").alias("holder"), "name"), ["holder", "name"])
    out = held.groupBy("site").agg(F.sort_array(F.collect_set("holder")).alias("candidates"))
    joined = sites.select("site").distinct().join(out, "site", "left")
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return joined.select("site", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"), "candidates")


def first_in_chain(start: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, holder): the nearest class up the base chain that has the method;
    ties to the smaller name.  start (src), methods (owner)."""
    up = class_closure(classes, start)
    held = up.join(methods.select(F.col("owner").alias("dst")).distinct(), "dst", "left_semi")
    return held.groupBy("src").agg(F.min_by("dst", F.struct("depth", "dst")).alias("holder"))


def reaches_effect(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, own): nodes that are marked, or reach a marked one: a walk back from
    the marked ones that meets each node once."""
    own = settled(marked.select("node").distinct().withColumn("own", F.lit(True)))
    steps = settled(edges.select("src", "dst").distinct())
    seen = front = own
    while not front.isEmpty():
        back = steps.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        front = settled(back.join(seen, "node", "left_anti").withColumn("own", F.lit(False)))
        seen = settled(seen.union(front))
    return seen


def closed_world(symbols: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """symbols with ``passed`` and the ``reasons`` that keep a world open, in the
    given order."""
    found = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in reasons)), lambda x: x.isNotNull())
    return symbols.withColumn("reasons", found).withColumn("passed", F.size("reasons") == 0)


def live_outside(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """Definitions (qname, name) that a scope outside their own body names."""
    own = (F.col("scope") == F.col("qname")) | F.col("scope").startswith(F.concat("qname", F.lit(".")))
    return defs.join(uses.select(F.col("name"), "scope"), "name").where(~own).select(*defs.columns).distinct()


def unspoken(sites: DataFrame) -> DataFrame:
    """Per spelled name its unresolved sites and the guesses made for it."""
    rows = sites.where("resolution <> 'resolved'")
    return rows.groupBy("name").agg(F.count("*").alias("sites"), F.array_sort(F.collect_set("guess")).alias("guesses"))


def counters(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row of conditional counts."""
    return rows.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in named.items()))


def subset_holders(lists: DataFrame, universe: DataFrame, least: int = 2) -> DataFrame:
    """Lists (owner, item) that name some but not all of the universe: what they
    ``name`` and what they ``lack``."""
    every = universe.agg(F.array_sort(F.collect_set("item")).alias("every"))
    named = lists.join(universe.select("item").distinct(), "item", "left_semi").groupBy("owner").agg(F.array_sort(F.collect_set("item")).alias("named"))
    # the universe is one row: the modules of one repository
    both = named.join(F.broadcast(every), F.lit(True)).withColumn("lacks", F.array_except("every", "named"))
    return both.where((F.size("named") >= least) & (F.size("lacks") > 0)).select("owner", "named", "lacks")


def group_testing(proposals: Sequence[tuple], check: Callable[[list], set], most: int = 64) -> tuple[list, list]:
    """(kept, vetoed) proposal ids by group testing.

    proposals: (id, place); ``check`` takes a list of proposals and returns the ids
    blamed for what breaks, or an empty set while something unattributable breaks
    (None for a clean pass).  A dirty group without blame is halved."""
    kept, vetoed = [], []
    stack = [list(proposals[k : k + most]) for k in range(0, len(proposals), most)][::-1]
    while stack:
        group = stack.pop()
        if not group:
            continue
        blamed = check(group)
        if blamed is None:
            kept += [p[0] for p in group]
        elif blamed:
            vetoed += [p[0] for p in group if p[0] in blamed]
            stack.append([p for p in group if p[0] not in blamed])
        elif len(group) == 1:
            vetoed.append(group[0][0])
        else:
            half = len(group) // 2
            stack += [group[half:], group[:half]]
    return kept, vetoed
