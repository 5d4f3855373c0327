"""Name resolution over the fact table: what a call names, and the call graph.

A dotted name is looked up by its first part: in the functions around the call,
in the module, in its imports, and for ``self`` and ``cls`` in the class and its
bases.  What an import names is followed through packages that hand it on.  Each
step is an equi-join; nothing is looked up by its last part alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dotted_prefixes
from .graph import class_closure, follow_aliases
from .lineage import settled


def _head(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def _up(name: Column) -> Column:
    """A dotted name without its last part."""
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def _kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def symbols(facts: DataFrame) -> DataFrame:
    """(symbol, module, what): every definition once."""
    return _kind(facts, "symbol").groupBy("symbol").agg(F.min("module").alias("module"), F.min("value").alias("what"))


def bindings(facts: DataFrame) -> DataFrame:
    """(name, target): what a module's own names stand for, imports followed."""
    named = _kind(facts, "import").where("value <> '*'")
    direct = named.select(F.concat_ws(".", "module", "value").alias("name"), F.col("name").alias("target"))
    whole = named.select(F.col("name").alias("full"), F.concat_ws(".", "module", "value").alias("name"), "value")
    # import a.b.c binds a; import a.b.c as x binds all of it
    plain = whole.where(_head("full") == F.col("value")).select("name", _head("full").alias("target"))
    starred = _kind(facts, "import").where("value = '*'").select("module", F.col("name").alias("source"))
    public = symbols(facts).where(_up("symbol") == F.col("module")).select(F.col("module").alias("source"), F.substring_index("symbol", ".", -1).alias("own"), "symbol")
    spread = starred.join(public.where(~F.col("own").startswith("_")), "source").select(F.concat_ws(".", "module", "own").alias("name"), F.col("symbol").alias("target"))
    every = direct.join(plain.select("name"), "name", "left_anti").union(plain).union(spread)
    # of several bindings of one name only a single target is an answer
    one = every.distinct().groupBy("name").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1 and name <> target")
    links = settled(one.select("name", "target"))
    ends = follow_aliases(links)
    return settled(ends.select("name", "target"))


def bases(facts: DataFrame, bound: DataFrame) -> DataFrame:
    """(child, base) of the classes of the repository, by full name."""
    rows = _kind(facts, "class").select("module", F.col("symbol").alias("child"), F.explode("items").alias("b"))
    rows = rows.withColumn("b", F.regexp_replace("b", r"\[.*$", ""))
    local = F.concat_ws(".", "module", "b")
    far = rows.withColumn("name", F.concat_ws(".", "module", _head("b"))).join(bound, "name", "left")
    rest = F.regexp_replace("b", r"^[^.]*", "")
    full = F.when(F.col("target").isNotNull(), F.concat("target", rest)).otherwise(local)
    known = _kind(facts, "class").select(F.col("symbol").alias("base")).distinct()
    return far.select("child", full.alias("base")).join(known, "base", "left_semi").select("child", "base").distinct()


def call_sites(facts: DataFrame) -> DataFrame:
    """Named calls: (module, rel, scope, line, col, name, args, given)."""
    c = _kind(facts, "call").where("name <> ''")
    return c.select("module", "rel", F.col("symbol").alias("scope"), "line", "col", "name", F.col("n").alias("args"), F.col("items").alias("given"))


def resolve(facts: DataFrame) -> DataFrame:
    """Call sites with ``target`` (a symbol of the repository, or an outside name)
    and ``resolution``: resolved, external or unresolved."""
    known = settled(symbols(facts))
    bound = bindings(facts)
    sites = settled(call_sites(facts).distinct().withColumn("head", _head("name")).withColumn("rest", F.regexp_replace("name", r"^[^.]*", "")))
    keys = ["module", "rel", "scope", "line", "col", "name"]
    functions = known.where("what in ('function', 'method')").select(F.col("symbol").alias("around"))
    # the innermost enclosing function or module that defines or binds the head
    steps = sites.select(*keys, "head", "rest", F.posexplode(dotted_prefixes(F.col("scope"))).alias("depth", "around"))
    inside = steps.join(functions, "around", "left_semi").union(steps.where("around = module").select("around", *keys, "head", "rest", "depth"))
    inside = inside.withColumn("local", F.concat_ws(".", "around", "head"))
    defined = inside.join(known.select(F.col("symbol").alias("local")), "local", "left_semi").select(*keys, "depth", F.concat("local", "rest").alias("full"))
    handed = inside.join(bound.select(F.col("name").alias("local"), "target"), "local").select(*keys, "depth", F.concat("target", "rest").alias("full"))
    nearest = defined.union(handed).groupBy(*keys).agg(F.min_by("full", F.struct("depth", "full")).alias("full"))
    found = _followed(nearest, bound)
    # self.x and cls.x: the class around, then its bases
    own = sites.where("head in ('self', 'cls') and rest <> ''").select(*keys, F.expr("substring(rest, 2)").alias("member"), F.posexplode(dotted_prefixes(F.col("scope"))).alias("depth", "owner"))
    classes = known.where("what = 'class'").select(F.col("symbol").alias("owner"))
    own = own.join(classes, "owner", "left_semi").groupBy(*keys).agg(F.min_by("owner", "depth").alias("owner"), F.min("member").alias("member"))
    up = class_closure(bases(facts, bound), own.select(F.col("owner").alias("src")).distinct())
    held = own.join(up.withColumnRenamed("src", "owner"), "owner").withColumn("full", F.concat_ws(".", "dst", "member"))
    held = held.join(known.select(F.col("symbol").alias("full")), "full", "left_semi").groupBy(*keys).agg(F.min_by("full", F.struct("depth", "dst")).alias("full"))
    both = found.join(held.select(*keys), keys, "left_anti").union(held.select(*found.columns))
    named = both.join(known.select(F.col("symbol").alias("full"), "what"), "full", "left")
    init = known.where("symbol like '%.\\\\_\\\\_init\\\\_\\\\_'").select(_up(F.col("symbol")).alias("full"), F.col("symbol").alias("made"))
    named = named.join(init, "full", "left")
    target = F.when(F.col("what") == "class", F.coalesce("made", "full")).otherwise(F.col("full"))
    modules = _kind(facts, "module").select(F.col("module").alias("top")).distinct().withColumn("ours", F.lit(True))
    placed = named.withColumn("top", _head("full")).join(modules.select(_head(F.col("top")).alias("top"), "ours").distinct(), "top", "left")
    state = F.when(F.col("what").isNotNull(), "resolved").when(F.col("ours").isNull(), "external").otherwise("unresolved")
    out = placed.select(*keys, target.alias("target"), state.alias("state"))
    builtin = F.when(F.col("rest") == "", F.col("head"))
    done = sites.join(out, keys, "left")
    return done.select(
        *keys, "args", "given",
        F.coalesce("target", F.when(F.col("state").isNull(), builtin)).alias("target"), F.coalesce("state", F.lit("unresolved")).alias("resolution"),
    )


def _followed(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """Rows whose full name passes through a package's binding, by its target: the
    longest bound prefix is replaced, twice at most."""
    out = rows
    for _ in range(2):
        keys = [c for c in out.columns if c != "full"]
        cut = out.select(*keys, "full", F.posexplode(dotted_prefixes(F.col("full"))).alias("k", "__from"))
        best = cut.join(bound.select(F.col("name").alias("__from"), F.col("target").alias("__to")), "__from")
        best = best.groupBy(*keys, "full").agg(F.min_by(F.struct("__from", "__to"), "k").alias("b"))
        moved = best.select(*keys, "full", F.concat("b.__to", F.expr("substring(full, length(b.__from) + 1)")).alias("new"))
        out = out.join(moved, [*keys, "full"], "left").select(*keys, F.coalesce("new", "full").alias("full"))
    return out


def call_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst): who calls whom inside the repository."""
    return resolved.where("resolution = 'resolved'").select(F.col("scope").alias("src"), F.col("target").alias("dst")).distinct()


def judged(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Sites with a checker's verdict in place of an untyped one.

    sites (rel, line, col, end_line, end_col, resolution, target), edges (the same
    span, ``targets`` array, ``external`` array).  A site that has a resolution
    keeps it; an outside verdict makes it external, one target resolved, several
    ambiguous."""
    span = ["rel", "line", "col", "end_line", "end_col"]
    one = edges.groupBy(*span).agg(F.array_distinct(F.flatten(F.collect_list("targets"))).alias("__t"), F.array_distinct(F.flatten(F.collect_list("external"))).alias("__e"))
    both = sites.join(one, span, "left")
    open_ = F.col("resolution") != "resolved"
    outside, n = open_ & (F.size("__e") > 0), F.size("__t")
    state = F.when(outside, "external").when(open_ & (n == 1), "resolved").when(open_ & (n > 1), "ambiguous").otherwise(F.col("resolution"))
    target = F.when(outside, F.lit(None)).when(open_ & (n == 1), F.element_at("__t", 1)).when(open_ & (n > 1), F.lit(None)).otherwise(F.col("target"))
    rest = [c for c in sites.columns if c not in ("resolution", "target")]
    return both.select(*rest, state.alias("resolution"), target.alias("target"))


def ambiguous_names(facts: DataFrame) -> DataFrame:
    """(name): last parts that several definitions share, so that an attribute call
    on an unknown receiver may mean any of them."""
    own = symbols(facts).where("what in ('function', 'method')").select(F.substring_index("symbol", ".", -1).alias("name"))
    return own.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
