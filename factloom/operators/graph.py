"""Graph and fixpoint operators over edge tables (src, dst).

Loops run on the driver, each round is one semi-naive DataFrame step, and every
round's result is written to the shared folder; what a later round replaces is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import forget, settled


def reach(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst): all nodes reached by one edge or more.  A source reaches
    itself only on a cycle.  Without sources: from every node."""
    steps = edges.select("src", "dst").distinct()
    start = steps if sources is None else steps.join(sources.select("src").distinct(), "src", "left_semi")
    steps = settled(steps)
    seen = frontier = settled(start)
    while not frontier.isEmpty():
        nxt = frontier.select("src", F.col("dst").alias("mid")).join(steps.select(F.col("src").alias("mid"), "dst"), "mid")
        old, frontier = (seen, frontier), settled(nxt.select("src", "dst").distinct().join(seen, ["src", "dst"], "left_anti"))
        seen = settled(seen.union(frontier))
        forget(*old)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components, named by their least node.

    Colours spread forward (the least node that reaches me), then backwards
    inside a colour from the node that gave it; what is met both ways is a
    component and leaves the graph.  Every round settles at least one component
    per colour; nodes without an edge in or out are trimmed first."""
    pairs = settled(edges.select("src", "dst").distinct())
    nodes = settled(pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct())
    done: DataFrame | None = None
    live = pairs.where("src <> dst")
    while True:
        if live.isEmpty():
            rest = nodes.withColumn("scc", F.col("node"))
            return rest if done is None else done.union(rest)
        both = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
        trimmed = nodes.join(both, "node", "left_anti")
        kept = settled(nodes.join(both, "node", "left_semi"))
        alone = trimmed.withColumn("scc", F.col("node"))
        done = settled(alone if done is None else done.union(alone))
        inner = settled(_inside(live, kept))
        if kept.isEmpty():
            return done
        if not trimmed.isEmpty():
            nodes, live = kept, inner
            continue
        colour = _spread(kept, inner)
        same = inner.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src")
        same = settled(same.join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst"))
        met = settled(colour.where("node = colour").select("node", F.col("colour").alias("scc")))
        front = met
        while not front.isEmpty():
            back = front.select(F.col("node").alias("dst"), "scc").join(same, "dst").select(F.col("src").alias("node"), "scc").distinct()
            old, front = (met, front), settled(back.join(met, "node", "left_anti"))
            met = settled(met.union(front))
            forget(*old)
        done = settled(done.union(met))
        nodes = settled(kept.join(met, "node", "left_anti"))
        live = settled(_inside(inner, nodes))


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    colour, new = nodes.withColumn("colour", F.col("node")), None
    while True:
        sent = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("c"))
        old, new = new, settled(colour.join(sent, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("was")))
        forget(old)
        colour = new.select("node", "colour")
        if new.where("colour <> was").isEmpty():
            return colour


def condensation(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, scc, level) and the edges between components.  A component's level
    is the longest path to it, so callers come before callees."""
    scc = settled(components(edges))
    a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("s")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("d"))
    between = settled(edges.join(a, "src").join(b, "dst").where("s <> d").select("s", "d").distinct())
    level, new = settled(scc.select("scc").distinct().withColumn("level", F.lit(0))), None
    while True:
        sent = between.join(level.withColumnRenamed("scc", "s"), "s").groupBy(F.col("d").alias("scc")).agg((F.max("level") + 1).alias("l"))
        old, new = new, settled(level.join(sent, "scc", "left").select("scc", F.greatest("level", F.coalesce("l", "level")).alias("level"), F.col("level").alias("was")))
        forget(old)
        level = new.select("scc", "level")
        if new.where("level <> was").isEmpty():
            return scc.join(level, "scc").select("node", "scc", "level"), between


def hot_amplification(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, amp): the loop depth at which a node can run.

    edges: (src, dst, depth); roots: (node), which start at 0.  Components are
    taken callers first.  All members of a reached one start from its greatest
    value; an edge inside raises its callee to that entry value plus its depth,
    once, never chained; an edge that leaves passes on its caller's raised value
    plus its depth."""
    placed, _ = condensation(edges)
    placed = settled(placed)
    deepest = placed.agg(F.max("level")).first()[0]
    e = edges.groupBy("src", "dst").agg(F.max("depth").alias("depth"))
    e = e.join(placed.select(F.col("node").alias("src"), F.col("scc").alias("s"), F.col("level").alias("sl")), "src")
    e = settled(e.join(placed.select(F.col("node").alias("dst"), F.col("scc").alias("d")), "dst"))
    given = settled(roots.select("node").distinct().withColumn("amp", F.lit(0).cast("long")))
    final: DataFrame | None = None
    for level in range((deepest if deepest is not None else -1) + 1):
        here = placed.where(F.col("level") == level)
        entry = here.join(given, "node").groupBy("scc").agg(F.max("amp").alias("entry"))
        own = here.join(entry, "scc").select("node", F.col("entry").alias("amp"), "scc", "entry")
        inner = e.where((F.col("sl") == level) & (F.col("s") == F.col("d"))).join(entry, F.col("s") == F.col("scc"))
        raised = inner.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("entry") + F.col("depth")).alias("r"))
        out = settled(own.join(raised, "node", "left").select("node", F.greatest("amp", F.coalesce("r", "amp")).alias("amp")))
        final = out if final is None else settled(final.union(out))
        leave = e.where((F.col("sl") == level) & (F.col("s") != F.col("d"))).join(out.withColumnRenamed("node", "src"), "src")
        sent = leave.select(F.col("dst").alias("node"), (F.col("amp") + F.col("depth")).alias("amp"))
        given = settled(given.union(sent).groupBy("node").agg(F.max("amp").alias("amp")))
    lone = given.join(placed, "node", "left_anti")
    return lone if final is None else final.union(lone)


def effect_fold(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(node, atoms, unknown): each node's component's own effects with those of
    all it calls, callees first.  own: (node, atoms array, unknown); edges may
    hold ``taint``: a call through which effects cannot be named, so that any
    effect of the callee makes the caller unknown instead.  Edges inside a
    component are skipped: its members share one summary."""
    calls = edges if "taint" in edges.columns else edges.withColumn("taint", F.lit(False))
    placed, _ = condensation(calls)
    every = placed.select("node").union(own.select("node")).distinct()
    base = every.join(placed, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"), F.coalesce("level", F.lit(0)).alias("level"))
    base = settled(base.join(own, "node", "left"))
    deepest = base.agg(F.max("level")).first()[0]
    of = base.select("node", "scc")
    e = calls.select("src", "dst", "taint").join(of.select(F.col("node").alias("src"), F.col("scc").alias("s")), "src")
    e = settled(e.join(of.select(F.col("node").alias("dst"), F.col("scc").alias("d")), "dst").where("s <> d").groupBy("s", "d").agg(F.bool_or("taint").alias("taint"), F.bool_or(~F.col("taint")).alias("plain")))
    atoms = base.select("scc", "level", F.explode("atoms").alias("atom")).distinct()
    flags = base.groupBy("scc", "level").agg(F.bool_or(F.coalesce("unknown", F.lit(False))).alias("unknown"))
    known_atoms, known_flags = settled(atoms.select("scc", "atom")), settled(flags.select("scc", "unknown"))
    for level in range((deepest if deepest is not None else -1), -1, -1):
        up = e.join(flags.where(F.col("level") == level).select(F.col("scc").alias("s")), "s")
        new = up.where("plain").join(known_atoms.withColumnRenamed("scc", "d"), "d").select(F.col("s").alias("scc"), "atom")
        some = known_atoms.select(F.col("scc").alias("d")).distinct().withColumn("any", F.lit(True))
        worse = up.join(known_flags.withColumnRenamed("scc", "d"), "d").join(some, "d", "left")
        worse = worse.select(F.col("s").alias("scc"), (F.col("unknown") | (F.col("taint") & F.coalesce("any", F.lit(False)))).alias("unknown"))
        known_atoms = settled(known_atoms.union(new).distinct())
        known_flags = settled(known_flags.union(worse).groupBy("scc").agg(F.bool_or("unknown").alias("unknown")))
    sets = known_atoms.groupBy("scc").agg(F.sort_array(F.collect_set("atom")).alias("atoms"))
    out = base.select("node", "scc").join(known_flags, "scc").join(sets, "scc", "left")
    return out.select("node", F.coalesce("atoms", F.expr("cast(array() as array<string>)")).alias("atoms"), "unknown")


def hidden_cycles(top: DataFrame, full: DataFrame) -> DataFrame:
    """(members, hidden): cycles of the top-level edges, and those of all edges
    whose member set is no cycle of the top-level ones."""

    def cycles(edges: DataFrame) -> DataFrame:
        sets = components(edges).groupBy("scc").agg(F.sort_array(F.collect_set("node")).alias("members"))
        return sets.where(F.size("members") > 1).select("members")

    first = settled(cycles(top))
    more = cycles(full).join(first, "members", "left_anti")
    return first.withColumn("hidden", F.lit(False)).union(more.withColumn("hidden", F.lit(True)))


def class_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, dst, depth): what a class reaches along (child, base) edges, itself
    at depth 0, each at its least depth."""
    steps = edges.select(F.col("child").alias("mid"), F.col("base").alias("dst")).distinct()
    seen = front = settled(start.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")).distinct())
    while not front.isEmpty():
        nxt = front.select("src", F.col("dst").alias("mid"), "depth").join(steps, "mid").select("src", "dst", (F.col("depth") + 1).alias("depth")).distinct()
        old, front = (seen, front), settled(nxt.join(seen, ["src", "dst"], "left_anti"))
        seen = settled(seen.union(front))
        forget(*old)
    return seen


def follow_aliases(aliases: DataFrame) -> DataFrame:
    """(name, target): each alias followed to its end; cycles have none."""
    hop = aliases.select(F.col("target").alias("mid"), F.col("name"))
    now = settled(aliases.select("name", "target"))
    links = aliases.select(F.col("name").alias("target"), F.col("target").alias("next"))
    n = hop.count()
    for _ in range(max(1, n.bit_length() + 1)):
        doubled = now.join(links, "target", "left").select("name", F.coalesce("next", "target").alias("target"))
        links = settled(doubled.select(F.col("name").alias("target"), F.col("target").alias("next")))
        now = settled(doubled)
    ends = aliases.select(F.col("name").alias("target")).distinct()
    return now.join(ends, "target", "left_anti").select("name", "target")
