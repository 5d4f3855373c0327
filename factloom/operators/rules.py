"""Rule readings over the fact table, and their registry.

A rule is a function from the facts to findings rows (rel, line, col, symbol,
message, cause, salience).  ``run`` adds the registry's columns, joins nothing
but what a rule asks for, and unites all rules in registry order.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, owner_list
from ..sources.python_facts import idiom_shapes, parses_as_code
from . import checker, effects, graph, resolve, world
from .findings_rows import Rule, finding, text
from .lineage import settled
from .mining import best_per_anchor, combination_groups, maximal_repeats, runs


REGISTRY: dict[int, Rule] = {}
COMPLEXITY_LIMIT = 15  # fixed values from here on: the thresholds of the readings
COMMENTED, PRAGMAS, PRAGMA_LINES = 3, 3, 100
BIG_MODULE, HOT_REFS, HOT_MODULE, WIDE_IMPORTS, READERS = 150, 3, 500, 10, 2
CLONE_NODES, LAMBDA_NODES, COPIES, WIDTH, WRITERS, BLOCK, AMBIENT = 20, 5, 3, 5, 3, 5, 8
TIERS = {"AST": "MODERATE", "IDX": "STRONG", "WP": "STRONG", "ORACLE": "PROVEN"}


def rule(ident: int, slug: str, posture: str = "ratchet", scope: str = "file", engine: str = "AST"):
    def add(fn):
        if ident in REGISTRY:
            raise ValueError(f"rule {ident} is registered twice")
        REGISTRY[ident] = Rule(ident, slug, posture, scope, engine, fn)
        return fn

    return add


class Facts:
    """Named views of the fact table."""

    def __init__(self, facts: DataFrame, roots: tuple[str, ...] = (), told: dict[str, DataFrame] | None = None):
        self.all = facts.withColumn("is_test", is_test_path(F.col("rel")))
        self.patterns, told = roots, told or {}
        empty = facts.sparkSession.createDataFrame
        self.diagnostics = told.get("diagnostics", empty([], checker.DIAGNOSTICS))
        self.arg_types = told.get("arg_types", empty([], "symbol string, name string, type string"))
        self.return_types = told.get("return_types", empty([], "symbol string, type string"))

    @cached_property
    def calls(self) -> DataFrame:
        """Call sites with their targets, resolved once for all rules that ask."""
        return settled(resolve.resolve(self.all).withColumn("is_test", is_test_path(F.col("rel"))))

    @cached_property
    def bound(self) -> DataFrame:
        return resolve.bindings(self.all)

    @cached_property
    def catalog(self) -> DataFrame:
        return effects.catalog(self.all.sparkSession)

    @cached_property
    def summaries(self) -> DataFrame:
        """(node, atoms, unknown): effects of every function and what it calls."""
        return settled(effects.summaries(self.all, self.calls, self.catalog))

    @cached_property
    def hot(self) -> DataFrame:
        """(symbol, amp): functions that hot roots reach, and the loop depth there."""
        inside = self("call", prod=False).select("rel", F.col("symbol").alias("scope"), "line", "col", F.col("value").cast("long").alias("depth"))
        at = ["rel", "scope", "line", "col"]
        edges = self.calls.where("resolution = 'resolved'").join(inside, at).select(F.col("scope").alias("src"), F.col("target").alias("dst"), "depth")
        roots, _ = world.hot_roots(self.functions(prod=False).select("symbol", "rel"), self("docstring", prod=False).select("symbol", "value"), self.patterns)
        return settled(graph.hot_amplification(edges, roots.select(F.col("symbol").alias("node"))).withColumnRenamed("node", "symbol"))

    def __call__(self, kind: str, prod: bool = True) -> DataFrame:
        rows = self.all.where(F.col("kind") == kind)
        return rows.where(~F.col("is_test")) if prod else rows

    def sites(self, *names: str, prod: bool = True) -> DataFrame:
        return self("site", prod).where(F.col("name").isin(*names))

    def functions(self, prod: bool = True) -> DataFrame:
        return self("symbol", prod).where("value in ('function', 'method')")


@rule(1, "weak-boundary-types", scope="repo")
def weak_boundary(f: Facts) -> DataFrame:
    lying = finding(f.sites("lying-default"), text("default contradicts its annotation: %s", F.col("value")))
    loose = f("param").where("value in ('Any', 'typing.Any', 'dict', 'Dict') and not name like '\\\\_%'").where(~F.element_at(F.split("symbol", "\\."), -1).startswith("_"))
    return lying.union(finding(loose, text("parameter %s is %s at a public boundary", F.col("name"), F.col("value"))))


@rule(2, "locally-redundant-check", scope="repo", engine="ORACLE")
def redundant_check(f: Facts) -> DataFrame:
    rows = checker.grounded_checks(f.diagnostics, f.all.where("not is_test"))
    return finding(rows, text("the type of %s makes this check needless: %s", F.col("name"), F.col("message")), F.concat(F.lit("redundant:"), F.col("rule")))


@rule(5, "proof-lifting", scope="repo", engine="ORACLE")
def proof_lifting(f: Facts) -> DataFrame:
    at = f("param").select("symbol", "name", "rel", "line", "col")
    rows = checker.lifted_types(f.arg_types, f.all.where("not is_test")).join(at, ["symbol", "name"])
    return finding(rows, text("every call gives %s a value of type %s", F.col("name"), F.col("type")), F.concat_ws(":", F.lit("lift"), "symbol", "name"))


@rule(10, "over-constrained-param", scope="repo")
def over_constrained(f: Facts) -> DataFrame:
    rows = checker.wide_enough(f.all.where("not is_test"))
    return finding(rows, text("%s: %s is used as a %s only", F.col("name"), F.col("annotation"), F.col("protocol")), F.concat_ws(":", F.lit("over-constrained"), "symbol", "name"))


@rule(3, "contract-implied-guard", scope="repo")
def needless_guard(f: Facts) -> DataFrame:
    nullable = f("param", prod=False).where(F.col("value").rlike("None|Optional") | (F.element_at("items", 2) == "None")).select("symbol", F.col("name").alias("value"))
    return finding(f.sites("needless-guard").join(nullable, ["symbol", "value"], "left_anti"), text("what is guarded tolerates an empty %s", F.col("value")))


@rule(6, "dishonest-accessor", scope="repo", engine="WP")
def dishonest_accessor(f: Facts) -> DataFrame:
    named = f.functions().where(F.col("name").rlike("^(get|is|has|find|fetch|compute)_"))
    writes = f.summaries.select(F.col("node").alias("symbol"), F.filter("atoms", lambda a: a.startswith("gw:")).alias("gs")).where(F.size("gs") > 0)
    hit = named.join(writes, "symbol").withColumn("gs", F.transform("gs", lambda a: F.substring_index(a, ".", -1)))
    return finding(hit, text("%s rebinds %s", F.col("name"), owner_list(F.col("gs"))), salience=F.size("gs"))


@rule(7, "comment-borne-protocol")
def comment_protocol(f: Facts) -> DataFrame:
    docs = f("docstring").where(F.lower("value").rlike(r"callers? (must|should|has to|have to|need to)")).where("name <> '__init__'")
    checked = f("verdict").where("name = 'assert'").select("symbol").distinct()
    return finding(docs.join(checked, "symbol", "left_anti"), text("%s asks its caller for what its signature could say", F.col("name")))


@rule(9, "shared-mutable-state", scope="repo", engine="IDX")
def shared_state(f: Facts) -> DataFrame:
    writers = f("global").select("module", "name", "symbol", "rel", "line", "col").distinct()
    many = writers.groupBy("module", "name").agg(F.countDistinct("symbol").alias("k"), F.min(F.struct("rel", "line", "col", "symbol")).alias("at"))
    hit = many.where(F.col("k") >= WRITERS).select("name", "k", "at.*")
    local = finding(hit, text("global %s is rebound by %d functions", F.col("name"), F.col("k")), salience=F.col("k"))
    # an attribute of something that another module owns
    base = F.element_at("items", 1)
    stores = f("ref").where("value = 'attr-store'").withColumn("bound", F.concat_ws(".", "module", F.substring_index(base, ".", 1)))
    owners = f("symbol", prod=False).select(F.col("symbol").alias("target"), F.col("module").alias("home")).union(f("module", prod=False).select(F.col("module").alias("target"), F.col("module").alias("home"))).distinct()
    foreign = stores.join(f.bound.select(F.col("name").alias("bound"), "target"), "bound").join(owners, "target").where("home <> module")
    patched = F.concat_ws(".", "target", "name")
    patch = finding(foreign, text("%s is set from another module", patched), F.concat(F.lit("monkeypatch:"), patched))
    # process-wide effects of an import
    at_import = effects.classified(f.calls.where("not is_test and scope = module and resolution = 'external'"), f.catalog).where(F.array_contains("effects", "writes-process"))
    read = import_edges(f).select(F.col("dst").alias("module")).distinct()
    rows = at_import.join(read, "module", "left_semi").withColumn("symbol", F.col("module"))
    return local.union(patch).union(finding(rows, text("importing the module calls %s", F.col("target")), F.concat(F.lit("import-time-effect:"), "target")))


@rule(11, "structural-clones", scope="repo", engine="IDX")
def clones(f: Facts) -> DataFrame:
    bodies = f("body", prod=False).where(F.col("n") + 1 >= CLONE_NODES)
    w = Window.partitionBy("value")
    order = Window.partitionBy("value").orderBy("is_test", "rel", "line")
    hit = bodies.withColumn("copies", F.count("*").over(w)).withColumn("k", F.row_number().over(order)).where("copies > 1 and k > 1 and not is_test")
    whole = finding(hit, text("%s has %d copies", F.col("name"), F.col("copies") - 1), F.concat(F.lit("clone:"), "value"), F.col("copies"))
    said = f("statement", prod=False).withColumn("nodes", F.element_at("items", 1).cast("int")).withColumn("prod", ~F.col("is_test")).withColumn("body", F.lit(True))
    found = maximal_repeats(said.select("symbol", F.col("n").alias("pos"), "value", "prod", "nodes", "body"), "symbol", "pos", "value", "prod", BLOCK, "nodes", CLONE_NODES, "body")
    at = said.where("prod").select("symbol", F.col("n").alias("start"), "rel", "line", "col")
    placed = found.withColumnRenamed("seq", "symbol").join(at, ["symbol", "start"])
    # the first copy of a block stands
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("rel", "line"))).withColumn("copies", F.count("*").over(Window.partitionBy("key")))
    block = finding(placed.where("k > 1"), text("%d statements that stand in %d places", F.col("length"), F.col("copies")), F.concat(F.lit("clone-block:"), "key"), F.col("copies"))
    return whole.union(block)


@rule(12, "idiom-catalog")
def idioms(f: Facts) -> DataFrame:
    nodes = finding(f.sites("range-len", "identity-comprehension", "bool-ternary", "keys-membership"), text("idiom: %s", F.col("name")), F.col("name"))
    shapes = f.all.sparkSession.createDataFrame(idiom_shapes(), "value string, idiom string, instead string")
    whole = f("body").drop("idiom").join(F.broadcast(shapes), "value")
    return nodes.union(finding(whole, text("%s is %s written out: use %s", F.col("name"), F.col("idiom"), F.col("instead")), F.concat(F.lit("idiom:"), "idiom")))


def ambient_free(groups: DataFrame, params: DataFrame) -> DataFrame:
    """Groups (symbol, owners, items) none of whose names stands in far more
    signatures than the group: such a name drags its neighbours in.  A group that
    falls has no second best in its place."""
    held = params.groupBy("name").agg(F.count("*").alias("held"))
    wide = groups.select("symbol", F.size("owners").alias("n"), F.explode("items").alias("name")).join(held, "name").where(F.col("held") > AMBIENT * F.col("n"))
    return groups.join(wide.select("symbol").distinct(), "symbol", "left_anti")


def one_fact(groups: DataFrame) -> DataFrame:
    """Keys of groups whose production members agree on declared types and home.
    groups (key, types, home, is_test), a row for each member."""
    kinds = groups.where("not is_test").groupBy("key").agg(F.countDistinct(F.to_json("types")).alias("t"), F.countDistinct("home").alias("h"))
    apart = kinds.where("t > 1 or h > 1").select("key")
    return groups.select("key").distinct().join(apart, "key", "left_anti")


@rule(14, "data-clump", scope="repo", engine="IDX")
def data_clump(f: Facts) -> DataFrame:
    params = f("param").where(~F.element_at("items", 1).isin("self", "star", "double-star"))
    groups = best_per_anchor(combination_groups(params, "symbol", "name", 3, 3, 15)).withColumn("symbol", F.element_at("owners", 1))
    groups = ambient_free(groups, params.select("symbol", "name").distinct())
    at = f.functions().groupBy("symbol").agg(F.min(F.struct("rel", "line", "col")).alias("at"))
    hit = groups.join(at, "symbol").select("symbol", "owners", "items", "at.*")
    names = F.array_join("items", ", ")
    return finding(hit, F.concat(F.lit("parameters "), names, F.lit(" travel together in "), owner_list(F.col("owners"))), names, F.size("owners"))


@rule(18, "section-comments")
def section_comments(f: Facts) -> DataFrame:
    labels = f("comment").where("n = 1").where(F.col("value").rlike(r"(?i)^#+\s*[-=]*\s*(step|phase|part|stage)?\s*\d+[.:)]|^#\s*[-=]{3,}"))
    span = f.functions().select("rel", F.col("symbol").alias("owner"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    inside = labels.join(span, "rel").where("line > lo and line <= hi").groupBy("rel", F.col("owner").alias("symbol")).agg(F.count("*").alias("k"), F.min(F.struct("line", "col")).alias("at"))
    return finding(inside.where("k >= 2").select("rel", "symbol", "k", "at.*"), text("%d phase labels in one function", F.col("k")), salience=F.col("k"))


@rule(20, "repeated-lambda")
def repeated_lambda(f: Facts) -> DataFrame:
    rows = f("lambda").where(F.col("n") >= LAMBDA_NODES).groupBy("module", "value").agg(F.count("*").alias("k"), F.min(F.struct("rel", "line", "col", "symbol")).alias("at"))
    return finding(rows.where(F.col("k") >= COPIES).select("value", "k", "at.*"), text("one lambda %d times", F.col("k")), F.col("value"), F.col("k"))


@rule(21, "distributed-invariant")
def invariant(f: Facts) -> DataFrame:
    rows = f("decision").withColumn("owner", F.regexp_replace("symbol", r"\.[^.]*$", ""))
    many = rows.groupBy("owner", "name").agg(F.countDistinct("symbol").alias("k"), F.min(F.struct("symbol", "rel", "line", "col")).alias("at"))
    return finding(many.where(F.col("k") >= COPIES).select("name", "k", "at.*"), text("decided in %d methods: %s", F.col("k"), F.col("name")), F.col("name"), F.col("k"))


@rule(23, "cognitive-complexity", "report")
def complexity(f: Facts) -> DataFrame:
    return finding(f.functions(prod=False).where(F.col("n") > COMPLEXITY_LIMIT), text("cognitive complexity %d", F.col("n")), F.lit("complexity"), F.col("n"))


@rule(24, "dynamic-identifiers")
def dynamic(f: Facts) -> DataFrame:
    return finding(f.sites("dynamic-attribute", "dynamic-import"), text("identifier known only at run time: %s", F.col("value")))


@rule(26, "declaration-literalness")
def literalness(f: Facts) -> DataFrame:
    return finding(f.sites("computed-all", "star-import", "assembled-constant"), text("declaration must be executed to be read: %s", F.col("name")))


def inbound(f: Facts) -> DataFrame:
    """(symbol, refs): references from other modules, by imported name."""
    names = f("import", prod=False).where("value <> '*'").select("module", F.col("name").alias("target"), "value")
    used = f("ref", prod=False).select("module", F.col("name").alias("value"))
    return names.join(used, ["module", "value"]).groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("refs"))


def import_edges(f: Facts, top: bool = False) -> DataFrame:
    """(src, dst) between modules: an import names a module or something in one."""
    mods = f("module", prod=False).select(F.col("module").alias("dst"))
    rows = f("import", prod=False).where(F.size("items") == 0)
    rows = rows.where("n = 1") if top else rows
    own = rows.select(F.col("module").alias("src"), "name")
    inner = own.select("src", F.regexp_replace("name", r"\.[^.]*$", "").alias("dst"))
    return own.withColumnRenamed("name", "dst").union(inner).join(mods, "dst", "left_semi").select("src", "dst").where("src <> dst").distinct()


@rule(27, "purchase-price", scope="repo", engine="IDX")
def price(f: Facts) -> DataFrame:
    hot = inbound(f).where(F.col("refs") >= HOT_REFS)
    owned = f("symbol").select("symbol", "module").distinct().join(hot, "symbol").groupBy("module").agg(
        F.sum("refs").alias("refs"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("refs")).alias("m"), "symbol"))), 1, 3).alias("t")
    )
    big = f("module").where(F.col("n") >= HOT_MODULE).join(owned, "module")
    names = F.array_join(F.transform("t", lambda x: x["symbol"]), ", ")
    costly = finding(big, F.concat(text("%d lines to read for ", F.col("n")), names), F.lit("price"), F.col("n") * F.col("refs"))
    edges = import_edges(f)
    out = edges.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("out"))
    read = edges.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("readers"))
    wide = f("module").where(~F.col("rel").endswith("__init__.py")).join(out, "module").join(read, "module").where((F.col("out") >= WIDE_IMPORTS) & (F.col("readers") >= READERS))
    return costly.union(finding(wide, text("imports %d modules and has %d readers", F.col("out"), F.col("readers")), F.lit("fan-out"), F.col("out")))


@rule(29, "top-loading")
def top_loading(f: Facts) -> DataFrame:
    return finding(f("module").where((F.col("n") >= BIG_MODULE) & (F.col("value") == "")), text("%d lines without an opening word", F.col("n")), F.lit("no-header"), F.col("n"))


@rule(32, "dead-symbols", scope="repo", engine="IDX")
def dead_symbols(f: Facts) -> DataFrame:
    used = f("ref", prod=False).where("value not in ('store', 'attr-store')").select("name", F.col("symbol").alias("scope")).distinct()
    named = f("import", prod=False).select(F.element_at(F.split("name", "\\."), -1).alias("name"), F.lit("").alias("scope")).distinct()
    live = used.union(named)
    defs = f("symbol").where("not name like '\\\\_\\\\_%' and size(items) = 0")
    own = (F.col("scope") == F.col("symbol")) | F.col("scope").startswith(F.concat("symbol", F.lit(".")))
    dead = defs.join(live.select(F.col("name").alias("n2"), "scope"), (F.col("name") == F.col("n2")) & ~own, "left_anti")
    gone = finding(dead, text("%s %s is never named", F.col("value"), F.col("name")), F.lit("dead-symbol"))
    loads = f("ref", prod=False).where("value = 'load'").select("module", F.col("name").alias("value")).distinct()
    idle = f("import").where(~F.col("rel").endswith("__init__.py")).where("value <> '*'").join(loads, ["module", "value"], "left_anti")
    # parameters that a body of some length never loads; an override must take what its base takes
    read = f("ref", prod=False).where("value = 'load'").select(F.col("symbol").alias("scope"), "name").distinct()
    long = f("docstring").where("n > 1").select("symbol")
    free = f.functions().where("size(items) = 0 and not name like '\\\\_\\\\_%' and value = 'function'").select("symbol")
    params = f("param").where((F.element_at("items", 1) == "positional") & ~F.col("name").startswith("_"))
    inner = (F.col("scope") == F.col("symbol")) | F.col("scope").startswith(F.concat("symbol", F.lit(".")))
    mine = params.join(long, "symbol", "left_semi").join(free, "symbol", "left_semi")
    unread = mine.join(read.withColumnRenamed("name", "n2"), (F.col("name") == F.col("n2")) & inner, "left_anti")
    params_gone = finding(unread, text("parameter %s is never read", F.col("name")), F.concat(F.lit("dead-param:"), "name"))
    return gone.union(finding(idle, text("import %s is unused", F.col("value")), F.lit("dead-import"))).union(params_gone)


@rule(33, "return-honesty", scope="repo")
def return_honesty(f: Facts) -> DataFrame:
    rows = f("returns").where("n = 0 and value <> ''").where(F.array_contains("items", "value"))
    some = F.array_contains("items", "none") | F.array_contains("items", "bare") | F.array_contains("items", "fall")
    bad = rows.where(some & ~F.col("value").rlike("None|Optional|Any|object"))
    return finding(bad, text("annotated %s but can return None", F.col("value")), F.lit("undeclared-optional"))


@rule(34, "noop-code")
def noop(f: Facts) -> DataFrame:
    sites = finding(f.sites("noop-reraise", "swallowed-exception"), text("code without effect: %s", F.col("name")))
    lines = f("comment").where("n = 1")
    blocks = runs(lines, ["rel", "col"], "line").where(F.col("length") >= COMMENTED)
    held = lines.select("rel", "col", "module", "line", "value").join(blocks, ["rel", "col"]).where("line between start and stop")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: F.regexp_replace(x["value"], "^# ?", "")), "\n")
    code = held.groupBy("rel", "col", "module", "start", "length").agg(joined.alias("code")).where(parses_as_code("code"))
    rows = code.select("rel", F.col("start").alias("line"), "col", F.col("module").alias("symbol"), "length")
    return sites.union(finding(rows, text("%d comment lines are code", F.col("length")), F.lit("commented-code"), F.col("length")))


@rule(35, "import-topology", scope="repo", engine="IDX")
def topology(f: Facts) -> DataFrame:
    cycles = graph.hidden_cycles(import_edges(f, top=True), import_edges(f)).withColumn("module", F.element_at("members", 1))
    hit = cycles.join(f("module", prod=False), "module")
    kind = F.when(F.col("hidden"), "hidden-cycle").otherwise("cycle")
    cycle = finding(hit, F.concat(F.lit("modules import each other: "), owner_list(F.col("members"))), kind, F.size("members"))
    # an import inside a function that would close no cycle at the top
    mods = f("module", prod=False).select(F.col("module").alias("dst"))
    late = f("import").where("n = 0 and size(items) = 0")
    exact = late.withColumn("dst", F.col("name"))
    outer = late.withColumn("dst", F.regexp_replace("name", r"\.[^.]*$", ""))
    named = exact.union(outer).join(mods, "dst", "left_semi").where("dst <> module")
    back = graph.reach(import_edges(f, top=True), named.select(F.col("dst").alias("src")).distinct()).select(F.col("src").alias("dst"), F.col("dst").alias("module"))
    free = named.join(back, ["dst", "module"], "left_anti")
    return cycle.union(finding(free, text("import of %s can stand at the top", F.col("dst")), F.concat(F.lit("hoistable-import:"), "dst")))


@rule(36, "type-lie-density", scope="repo")
def type_lies(f: Facts) -> DataFrame:
    dense = checker.pragma_density(f.all.where("not is_test")).where((F.col("pragmas") >= PRAGMAS) & (F.col("pragmas") * PRAGMA_LINES >= F.col("lines")))
    rows = dense.select("rel", "line", F.lit(0).alias("col"), F.col("module").alias("symbol"), "pragmas", "lines")
    lies = finding(rows, text("%d pragmas silence the checker in %d lines", F.col("pragmas"), F.col("lines")), F.lit("type-lies"), F.col("pragmas"))
    loose = checker.laundered(f.return_types, f.calls.where("resolution = 'resolved'").select("scope", "target"), f.all)
    given = f.functions().join(loose, "symbol", "left_semi")
    return lies.union(finding(given, text("%s returns Any to callers that promise types", F.col("name")), F.concat(F.lit("any-laundering:"), "symbol")))


@rule(37, "speculative-generality", scope="repo", engine="WP")
def speculative(f: Facts) -> DataFrame:
    last = F.element_at(F.split("name", "\\."), -1)
    calls = f("call").select(last.alias("fn"), "n", "items")
    once = f.functions().groupBy("name").agg(F.count("*").alias("d")).where("d = 1").select(F.col("name").alias("fn"))
    given = f("param").where((F.element_at("items", 2) != "") & (F.element_at("items", 1) == "positional"))
    given = given.withColumn("fn", F.element_at(F.split("symbol", "\\."), -1)).withColumn("place", F.col("n")).drop("n", "items").join(once, "fn", "left_semi")
    met = given.join(calls.withColumnRenamed("n", "args"), "fn")
    named = F.exists("items", lambda x: x.startswith(F.concat(F.col("name"), F.lit("="))) | x.startswith("**") | x.startswith("*"))
    said = met.withColumn("said", (F.col("args") > F.col("place")) | named)
    idle = said.groupBy("rel", "line", "col", "symbol", "name").agg(F.count("*").alias("k"), F.bool_or("said").alias("any")).where(~F.col("any") & (F.col("k") >= COPIES))
    unused = finding(idle, text("no call overrides the default of %s", F.col("name")), F.lit("never-overridden"), F.col("k"))
    # a parameter that every resolved call gives the same constant
    bound_calls = f.calls.where("not is_test and resolution = 'resolved'").select(F.col("target").alias("symbol"), "args", "given", F.struct("rel", "line", "col").alias("site"))
    plain = f("param").where(F.element_at("items", 1).isin("positional", "keyword")).select("rel", "line", "col", "symbol", "name", "n")
    methods = f.functions(prod=False).where("value = 'method'").select("symbol").distinct().withColumn("bound", F.lit(1))
    held = plain.join(methods, "symbol", "left").withColumn("place", F.col("n") - F.coalesce("bound", F.lit(0)))
    sent = held.join(bound_calls, "symbol")
    value = F.coalesce(F.expr("substring(try_element_at(filter(given, x -> startswith(x, concat(name, '='))), 1), length(name) + 2)"), F.when((F.col("place") >= 0) & (F.col("place") < F.col("args")), F.get("given", F.col("place").cast("int"))))
    constant = F.col("v").rlike(r"^(-?[0-9][0-9._]*|True|False|None|[bru]?'[^']*'|[bru]?\"[^\"]*\")$")
    per = sent.withColumn("v", value).groupBy("rel", "line", "col", "symbol", "name").agg(F.count("*").alias("k"), F.bool_and(F.coalesce(constant, F.lit(False))).alias("same"), F.min("v").alias("a"), F.max("v").alias("b"))
    single_valued = per.where((F.col("k") >= COPIES) & F.col("same") & (F.col("a") == F.col("b")))
    mono = finding(single_valued, text("every call gives %s the value %s", F.col("name"), F.col("a")), F.concat(F.lit("monomorphic:"), "name"), F.col("k"))
    base = f("class").where(F.exists("items", lambda x: x.rlike("(^|\\.)(ABC|Protocol)(\\[|$)")))
    subs = f("class", prod=False).select(F.explode("items").alias("b"), F.col("symbol").alias("sub")).select(F.element_at(F.split("b", "\\."), -1).alias("name"), "sub")
    single = base.join(subs.groupBy("name").agg(F.countDistinct("sub").alias("k")).where("k = 1"), "name")
    return unused.union(mono).union(finding(single, text("%s has one implementation", F.col("name")), F.lit("single-implementation")))


@rule(38, "value-duplication", scope="repo", engine="IDX")
def duplicated_values(f: Facts) -> DataFrame:
    rows = f("literal")
    many = rows.groupBy("value").agg(F.countDistinct("module").alias("k")).where(F.col("k") >= COPIES)
    return finding(rows.join(many, "value"), text("one value in %d modules", F.col("k")), F.substring(F.sha2("value", 256), 1, 12), F.col("k"))


@rule(39, "comment-discipline")
def comments(f: Facts) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("value", r"[^A-Za-z0-9]+", " ")), " "), lambda x: F.length(x) > 2))
    own = F.array_distinct(F.split(F.lower("name"), "_"))
    docs = f("docstring").where("value <> ''").where(~F.col("value").contains("\n")).withColumn("w", words)
    said = docs.where((F.size("w") > 0) & (F.size(F.array_except("w", F.concat(own, F.array(F.lit("the"), F.lit("and"))))) == 0))
    return finding(said, text("docstring repeats the name %s", F.col("name")), F.lit("echo"))


@rule(40, "naming-proxies", scope="repo")
def naming(f: Facts) -> DataFrame:
    rows = f("returns").where(F.col("name").rlike("^(is|has|can)_")).where("value <> ''")
    return finding(rows.where(~F.col("value").rlike("bool|TypeGuard|TypeIs|Any")), text("%s returns %s", F.col("name"), F.col("value")), F.lit("annotation"))


@rule(41, "perf-catalog", "report", "repo", "WP")
def perf(f: Facts) -> DataFrame:
    shapes = f.sites("costly-in-loop").join(f.hot, "symbol")
    depth = F.col("amp") + F.col("n")
    return finding(shapes, text("%s at loop depth %d of hot code", F.col("value"), depth), F.concat(F.lit("perf:"), "value"), depth)


def tests_of(f: Facts) -> DataFrame:
    return f.functions(prod=False).where(F.col("is_test") & F.col("name").startswith("test"))


@rule(42, "assertion-free-test", scope="repo", engine="IDX")
def assertion_free(f: Facts) -> DataFrame:
    proven = f("verdict", prod=False).select("symbol").distinct()
    calls = f("call", prod=False)
    method = F.element_at(F.split("name", "\\."), -1)
    said = calls.where(method.rlike("^assert|^fail$|^raises$|^verify|^check")).select("symbol")
    # a helper of the repository one call away
    deciding = proven.union(said).select(F.col("symbol").alias("target")).distinct()
    via = f.calls.where("resolution = 'resolved'").join(deciding, "target", "left_semi").select(F.col("scope").alias("symbol"))
    rest = tests_of(f).join(proven.union(said).union(via).distinct(), "symbol", "left_anti")
    return finding(rest, text("test %s decides nothing", F.col("name")), F.lit("no-verdict"))


@rule(44, "tautological-assertion", "report")
def tautology(f: Facts) -> DataFrame:
    return finding(f.sites("tautology", prod=False), text("always true: %s", F.col("value")))


@rule(47, "sleepy-test")
def sleepy(f: Facts) -> DataFrame:
    return finding(f.sites("sleep", prod=False).where("is_test"), text("%s in a test", F.col("value")))


@rule(48, "fold-candidate", scope="repo", engine="WP")
def fold(f: Facts) -> DataFrame:
    uses = f("ref", prod=False).groupBy("name").agg(F.count("*").alias("refs"))
    calls = f.calls.where("not is_test and resolution = 'resolved'").groupBy(F.col("target").alias("symbol")).agg(F.count("*").alias("calls"))
    short = f("docstring").where("n = 1").select("symbol")
    private = f.functions().where("name like '\\\\_%' and not name like '\\\\_\\\\_%' and size(items) = 0").join(short, "symbol", "left_semi")
    hit = private.join(uses, "name").join(calls, "symbol").where("refs = 1 and calls = 1")
    return finding(hit, text("%s has one call and one statement", F.col("name")), F.lit("fold"))


@rule(49, "mutable-default")
def mutable_default(f: Facts) -> DataFrame:
    return finding(f.sites("mutable-default"), text("default of %s is shared by all calls", F.col("value")))


@rule(50, "unannotated-boundary")
def unannotated(f: Facts) -> DataFrame:
    typed = f("param").where("value <> ''").select("module").distinct()
    bare = f("param").where("value = ''").where(F.element_at("items", 1) != "self").where(~F.element_at(F.split("symbol", "\\."), -1).startswith("_"))
    return finding(bare.join(typed, "module", "left_semi"), text("parameter %s has no annotation", F.col("name")), F.col("name"))


@rule(53, "raise-contract", scope="repo")
def raise_contract(f: Facts) -> DataFrame:
    from ..functions.text import declared_raises_udf

    docs = f("docstring").where(F.col("value").rlike("(?i)raises|:raise")).withColumn("said", declared_raises_udf("value")).where(F.size("said") > 0)
    short = lambda x: F.element_at(F.split(x, "\\."), -1)
    done = f("raise").where("name <> ''").groupBy("symbol").agg(F.sort_array(F.collect_set(short(F.col("name")))).alias("done"))
    hit = docs.join(done, "symbol").withColumn("more", F.array_except("done", F.transform("said", short))).where(F.size("more") > 0)
    return finding(hit, F.concat(F.lit("raises without saying so: "), owner_list(F.col("more"))), F.array_join("more", ","))


@rule(54, "kind-switch", scope="repo", engine="IDX")
def kind_switch(f: Facts) -> DataFrame:
    tags = f("tag").where(F.col("value").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    groups = best_per_anchor(combination_groups(tags, "symbol", "value", 2, 3, 15)).withColumn("symbol", F.element_at("owners", 1))
    at = tags.groupBy("symbol").agg(F.min(F.struct("rel", "line", "col")).alias("at"))
    hit = groups.join(at, "symbol").select("symbol", "owners", "items", "at.*")
    names = F.array_join("items", ", ")
    return finding(hit, F.concat(F.lit("kinds "), names, F.lit(" are told apart in "), owner_list(F.col("owners"))), names, F.size("owners"))


@rule(55, "positional-width", scope="repo", engine="IDX")
def width(f: Facts) -> DataFrame:
    kind = F.element_at("items", 1)
    per = f("param").groupBy("symbol").agg(
        F.count(F.when(kind == "positional", 1)).alias("k"), F.max((kind == "star").cast("int")).alias("star"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")
    )
    wide = f.functions().join(per.where((F.col("k") >= WIDTH) & (F.col("star") == 0)), "symbol")
    plugin = wide.groupBy("name", "names").agg(F.countDistinct("module").alias("m")).where("m > 1")
    return finding(wide.join(plugin, ["name", "names"], "left_anti"), text("%d positional parameters", F.col("k")), F.lit("width"), F.col("k"))


@rule(56, "test-only-symbol", scope="repo", engine="IDX")
def test_only(f: Facts) -> DataFrame:
    names = f("ref", prod=False).where("value not in ('store', 'attr-store')").select("name", "is_test")
    seen = names.groupBy("name").agg(F.bool_and("is_test").alias("only"))
    defs = f("symbol").where("value in ('function', 'class') and size(items) = 0")
    return finding(defs.join(seen.where("only").select("name"), "name", "left_semi"), text("%s is used by tests only", F.col("name")), F.lit("test-only"))


@rule(57, "dead-key", scope="repo", engine="WP")
def dead_key(f: Facts) -> DataFrame:
    other = f("plain-return").select("symbol").distinct()
    shapes = f("record").where(F.col("name") != "").join(other, "symbol", "left_anti")
    keys = shapes.groupBy("symbol").agg(F.min(F.struct("rel", "line", "col")).alias("at"), F.collect_list("items").alias("all"))
    on_all = F.aggregate("all", F.element_at("all", 1), lambda a, x: F.array_intersect(a, x))
    rows = keys.select("symbol", "at.*", F.explode(on_all).alias("key"))
    read = f("key-read", prod=False).select(F.col("name").alias("key")).distinct()
    # whoever unpacks or dumps a record reads keys that no name shows
    open_ = f("call", prod=False).where(F.col("name").rlike(r"(^|\.)(items|values|keys|dumps|dump)$") | F.exists("items", lambda x: x.startswith("**"))).select("module").distinct()
    last = F.element_at(F.split("symbol", "\\."), -1)
    used = f("call", prod=False).select(F.element_at(F.split("name", "\\."), -1).alias("fn"), "module")
    leaks = used.join(open_, "module", "left_semi").select("fn").distinct()
    closed = rows.withColumn("fn", last).join(used.select("fn").distinct(), "fn", "left_semi").join(leaks, "fn", "left_anti")
    return finding(closed.join(read, "key", "left_anti"), text("key %s is written and never read", F.col("key")), F.col("key"))


@rule(58, "checker-error", "report", "repo", "ORACLE")
def checker_error(f: Facts) -> DataFrame:
    typed = f("param").where("value <> ''").select("rel").union(f("returns").where("value <> ''").select("rel")).distinct()
    span = f.functions().select("rel", F.col("symbol").alias("owner"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    told = checker.errors(f.diagnostics, f.all).join(typed, "rel", "left_semi")
    keys = [c for c in told.columns]
    inner = told.join(span, "rel").where("line between lo and hi").groupBy(*keys).agg(F.max_by("owner", "lo").alias("owner"))
    mods = f("module").select("rel", "module")
    rows = told.join(inner, keys, "left").join(mods, "rel").withColumn("symbol", F.coalesce("owner", "module"))
    return finding(rows, F.col("message"), F.concat_ws(":", F.col("rule"), "rel", F.col("line").cast("string"), F.col("col").cast("string")))


@rule(59, "cost-docstring", scope="repo")
def cost_docstring(f: Facts) -> DataFrame:
    spends = effects.spends(f.all, f.calls, f.catalog).select("symbol").distinct()
    told = f("docstring").where(F.lower("value").rlike("cost|slow|network|request|process|seconds|expensive")).select("symbol")
    heavy = f.functions().where((F.col("end_line") - F.col("line") + 1 >= 30) & ~F.col("name").startswith("_"))
    return finding(heavy.join(spends, "symbol", "left_semi").join(told, "symbol", "left_anti"), text("%s spends outside the process without saying so", F.col("name")), F.lit("cost"))


@rule(60, "dead-by-graph", "report", "repo", "WP")
def dead_by_graph(f: Facts) -> DataFrame:
    """Named, but no call resolves to it; the world is closed: nothing decorates it,
    passes it on as a value, or calls its name on an unknown object."""
    last = F.substring_index("name", ".", -1)
    called = f.calls.where("resolution = 'resolved'").select(F.col("target").alias("symbol")).distinct()
    guessed = f.calls.where("resolution = 'unresolved'").select(last.alias("name")).distinct()
    valued = f("ref", prod=False).where("value = 'attr'").select("name").distinct()
    named = f("ref", prod=False).where("value = 'load'").select("name").distinct()
    # a name that stands where no call does is handed on
    spots = f.calls.select("rel", "line", "col", F.substring_index("name", ".", 1).alias("name")).distinct()
    handed = f("ref", prod=False).where("value = 'load'").join(spots, ["rel", "line", "col", "name"], "left_anti").select("name").distinct()
    defs = f.functions().where("value = 'function' and size(items) = 0")
    rest = defs.join(named, "name", "left_semi").join(called, "symbol", "left_anti")
    for other in (guessed, valued, handed):
        rest = rest.join(other, "name", "left_anti")
    return finding(rest, text("%s is named but never called", F.col("name")), F.lit("no-caller"))


def run(facts: DataFrame, only: list[int] | None = None, off: list[int] | None = None, roots: tuple[str, ...] = (), rust: DataFrame | None = None, told: dict[str, DataFrame] | None = None) -> DataFrame:
    """All findings in the canonical columns.  facts: those of the Python files,
    rust: those of the Rust files; roots: name patterns of hot code; told: tables of
    a checker (``diagnostics``, ``arg_types``, ``return_types``)."""
    from . import rust_rules

    sides = [("py", REGISTRY, Facts(facts, roots, told))]
    if rust is not None:
        sides.append(("rs", rust_rules.REGISTRY, rust_rules.Facts(rust)))
    parts = []
    for lang, registry, f in sides:
        for ident in sorted(registry):
            if (only and ident not in only) or (off and ident in off):
                continue
            r = registry[ident]
            rows = r.fn(f).select(F.lit(str(ident)).alias("rule"), F.lit(r.slug).alias("slug"), F.lit(lang).alias("lang"), "*")
            parts.append(rows.withColumn("engine", F.lit(r.engine)).withColumn("tier", F.lit(TIERS[r.engine])).withColumn("posture", F.lit(r.posture)))
    return reduce(DataFrame.unionByName, parts)
