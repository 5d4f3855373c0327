"""Rule readings over Rust facts.  Registered like the Python ones, by the same
numbers; names are resolved by path, and a method by its name where the repository
has one method of that name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_bench_path, owner_list
from ..functions.text import is_phase_label
from ..sources.rust_facts import parses_as_code
from .findings_rows import Rule, finding, text
from .lineage import settled
from .mining import maximal_repeats, runs

REGISTRY: dict[int, Rule] = {}
COMPLEXITY_LIMIT = 15  # fixed values from here on: the thresholds of the readings
BIG_MODULE, HOT_REFS, HOT_MODULE, CLONE_TOKENS, BLOCK, LAMBDA_TOKENS, COPIES, WRITERS, SITES, ENTRY_LINES = 150, 3, 500, 40, 5, 8, 3, 3, 3, 30
COMMENTED = 3
SPENDING = r"(^|::)(Command|TcpStream|TcpListener|UdpSocket|File|fs|reqwest|hyper|Client)::"


def rule(ident: int, slug: str, posture: str = "ratchet", scope: str = "file", engine: str = "AST"):
    def add(fn: Callable):
        if ident in REGISTRY:
            raise ValueError(f"rule {ident} is registered twice")
        REGISTRY[ident] = Rule(ident, slug, posture, scope, engine, fn)
        return fn

    return add


class Facts:
    """Named views of the fact table of Rust files."""

    def __init__(self, facts: DataFrame):
        tests = is_bench_path(F.col("rel")) | F.col("module").rlike(r"::tests?($|::)")
        self.all = facts.withColumn("is_test", tests)

    def __call__(self, kind: str, prod: bool = True) -> DataFrame:
        rows = self.all.where(F.col("kind") == kind)
        return rows.where(~F.col("is_test")) if prod else rows

    def sites(self, *names: str, prod: bool = True) -> DataFrame:
        return self("site", prod).where(F.col("name").isin(*names))

    def functions(self, prod: bool = True) -> DataFrame:
        return self("symbol", prod).where("value in ('function', 'method')")

    @cached_property
    def edges(self) -> DataFrame:
        """(src, dst, line, is_test): calls and named functions with the repository's
        symbol they mean."""
        symbols = self("symbol", False).select("symbol", "name", "value").distinct()
        calls = self("call", False).select("module", "symbol", "name", F.col("value").alias("receiver"), "line", "is_test")
        path = calls.where(~F.col("name").startswith("."))
        head, rest = F.substring_index("name", "::", 1), F.regexp_replace("name", r"^[^:]*", "")
        uses = self("import", False).select(F.col("symbol").alias("scope"), F.col("value").alias("head"), "name").distinct()
        own = F.regexp_replace("module", "::tests$", "")
        around = F.regexp_replace("symbol", "::[^:]*$", "")
        bound = path.withColumn("head", head).withColumn("rest", rest).withColumn("scope", own)
        far = bound.join(uses.withColumnRenamed("name", "target"), ["scope", "head"]).select("symbol", "line", "is_test", F.concat("target", "rest").alias("dst"))
        near = bound.select("symbol", "line", "is_test", F.explode(F.array(F.concat("scope", F.lit("::"), "name"), F.concat("module", F.lit("::"), "name"), F.concat(around, rest), F.col("name"))).alias("dst"))
        known = symbols.select(F.col("symbol").alias("dst")).distinct()
        named = far.union(near).join(known, "dst", "left_semi")
        # self.m() means the type's own method, any other .m() the only method of that name
        dotted = calls.where(F.col("name").startswith(".")).withColumn("name", F.expr("substring(name, 2)"))
        mine = dotted.where("receiver = 'self'").select("symbol", "line", "is_test", F.concat(around, F.lit("::"), "name").alias("dst")).join(known, "dst", "left_semi")
        single = symbols.where("value = 'method'").groupBy("name").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("dst")).where("n = 1").select("name", "dst")
        other = dotted.where("receiver <> 'self'").join(single, "name").select("symbol", "line", "is_test", "dst")
        out = named.select("symbol", "line", "is_test", "dst").union(mine.select("symbol", "line", "is_test", "dst")).union(other).distinct()
        return settled(out.withColumnRenamed("symbol", "src"))

    @cached_property
    def published(self) -> DataFrame:
        """(symbol): items that are ``pub`` to the outside."""
        return self("symbol", False).where(F.array_contains("items", "pub")).select("symbol").distinct()

    @cached_property
    def named(self) -> DataFrame:
        """(name, scope, is_test): every spelled name and where it stands."""
        spelled = self("ref", False).select("name", F.col("symbol").alias("scope"), "is_test")
        used = self("import", False).select(F.substring_index("name", "::", -1).alias("name"), F.concat(F.lit("use "), "symbol").alias("scope"), "is_test")
        typed = self("param", False).union(self("returns", False)).select(F.explode(F.split("value", " ")).alias("name"), F.col("symbol").alias("scope"), "is_test")
        impls = self("impl", False).select(F.explode(F.array("name", "value")).alias("name"), F.concat(F.lit("impl "), "symbol").alias("scope"), "is_test")
        return spelled.union(used).union(typed).union(impls).distinct()


def _outside(defs: DataFrame, named: DataFrame) -> DataFrame:
    """named joined to the definitions whose name it spells outside their own body."""
    n = named.select(F.col("name").alias("n2"), "scope", F.col("is_test").alias("from_test"))
    own = (F.col("scope") == F.col("symbol")) | F.col("scope").startswith(F.concat("symbol", F.lit("::")))
    return defs.join(n, (F.col("name") == F.col("n2")) & ~own)


def _short(c: str) -> Column:
    return F.substring_index(c, "::", -1)


@rule(9, "shared-mutable-state", "report", "repo", "IDX")
def shared_state(f: Facts) -> DataFrame:
    statics = f("symbol").where("value = 'static'").select("name", F.col("module").alias("home"), F.col("symbol").alias("cell")).distinct()
    writers = f("global").join(statics, "name").where(F.col("module") == F.col("home")).select("cell", "symbol", "rel", "line", "col").distinct()
    many = writers.groupBy("cell").agg(F.countDistinct("symbol").alias("k"), F.min(F.struct("rel", "line", "col", "symbol")).alias("at"))
    return finding(many.where(F.col("k") >= WRITERS).select("cell", "k", "at.*"), text("static %s is written by %d functions", _short("cell"), F.col("k")), F.concat(F.lit("local-writers:"), "cell"), F.col("k"))


@rule(11, "structural-clones", scope="repo", engine="IDX")
def clones(f: Facts) -> DataFrame:
    bodies = f("body", False).where(F.col("n") >= CLONE_TOKENS)
    w = Window.partitionBy("value")
    hit = bodies.withColumn("copies", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("is_test", "rel", "line"))).where("copies > 1 and k > 1 and not is_test")
    whole = finding(hit, text("%s has %d copies", F.col("name"), F.col("copies") - 1), F.concat(F.lit("clone:"), "value"), F.col("copies"))
    said = f("statement", False).withColumn("nodes", F.element_at("items", 1).cast("int")).withColumn("prod", ~F.col("is_test")).withColumn("whole", F.lit(True))
    found = maximal_repeats(said.select("symbol", F.col("n").alias("pos"), "value", "prod", "nodes", "whole"), "symbol", "pos", "value", "prod", BLOCK, "nodes", CLONE_TOKENS, "whole")
    at = said.where("prod").select("symbol", F.col("n").alias("start"), "rel", "line", "col")
    placed = found.withColumnRenamed("seq", "symbol").join(at, ["symbol", "start"])
    k = Window.partitionBy("key")
    placed = placed.withColumn("k", F.row_number().over(k.orderBy("rel", "line"))).withColumn("copies", F.count("*").over(k)).where("k > 1")
    return whole.union(finding(placed, text("%d statements that stand in %d places", F.col("length"), F.col("copies")), F.concat(F.lit("clone-block:"), "key"), F.col("copies") * F.col("length")))


@rule(18, "section-comments")
def section_comments(f: Facts) -> DataFrame:
    labels = f("comment").where("n = 1").where(is_phase_label(F.col("value"), "//"))
    span = f.functions().select("rel", F.col("symbol").alias("owner"), F.col("line").alias("lo"), F.col("end_line").alias("hi"))
    inside = labels.join(span, "rel").where("line > lo and line <= hi").withColumn("block", F.col("line") - F.row_number().over(Window.partitionBy("rel", "owner").orderBy("line")))
    each = inside.groupBy("rel", "owner", "block").agg(F.min(F.struct("line", "col")).alias("at")).groupBy("rel", F.col("owner").alias("symbol")).agg(F.count("*").alias("k"), F.min("at").alias("at"))
    return finding(each.where("k >= 2").select("rel", "symbol", "k", "at.*"), text("%d phase labels in one function", F.col("k")), F.lit("sections"), F.col("k"))


@rule(20, "repeated-lambda")
def repeated_closure(f: Facts) -> DataFrame:
    rows = f("lambda", False).withColumn("home", F.regexp_replace("module", "::tests$", "")).where(F.col("n") >= LAMBDA_TOKENS)
    many = rows.groupBy("home", "value").agg(F.count("*").alias("k"), F.min(F.when(~F.col("is_test"), F.struct("rel", "line", "col", "symbol"))).alias("at"))
    return finding(many.where((F.col("k") >= COPIES) & F.col("at").isNotNull()).select("value", "k", "at.*"), text("one closure %d times", F.col("k")), F.concat(F.lit("closure:"), "value"), F.col("k"))


@rule(21, "distributed-invariant", scope="repo")
def panicking_arm(f: Facts) -> DataFrame:
    enums = f("enum").select(F.col("name").alias("owner"), F.explode("items").alias("variant")).distinct()
    arms = f("panic-arm").select("rel", "line", "col", "symbol", F.col("name").alias("owner"), F.col("value").alias("variant")).join(enums, ["owner", "variant"], "left_semi")
    counted = arms.withColumn("k", F.count("*").over(Window.partitionBy("owner")))
    return finding(counted, text("%s::%s cannot come here, says a panic", F.col("owner"), F.col("variant")), F.concat_ws(":", F.lit("panic-arm"), "owner", "variant"), F.col("k"))


@rule(23, "cognitive-complexity", "report")
def complexity(f: Facts) -> DataFrame:
    return finding(f.functions(prod=False).where(F.col("n") > COMPLEXITY_LIMIT), text("cognitive complexity %d", F.col("n")), F.lit("complexity"), F.col("n"))


@rule(27, "purchase-price", scope="repo", engine="IDX")
def price(f: Facts) -> DataFrame:
    owned = f("symbol").select("symbol", "module").distinct()
    met = f.edges.join(owned.withColumnRenamed("symbol", "dst").withColumnRenamed("module", "home"), "dst").join(f("symbol", False).select(F.col("symbol").alias("src"), F.col("module").alias("from")).distinct(), "src")
    hot = met.where("home <> from").groupBy("home", "dst").agg(F.count("*").alias("refs")).where(F.col("refs") >= HOT_REFS)
    per = hot.groupBy(F.col("home").alias("module")).agg(F.sum("refs").alias("refs"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("refs")).alias("m"), "dst"))), 1, 3).alias("t"))
    big = f("module").where(F.col("n") >= HOT_MODULE).join(per, "module")
    names = F.array_join(F.transform("t", lambda x: x["dst"]), ", ")
    return finding(big, F.concat(text("%d lines to read for ", F.col("n")), names), F.lit("price"), F.col("n") * F.col("refs"))


@rule(29, "top-loading")
def top_loading(f: Facts) -> DataFrame:
    return finding(f("module").where((F.col("n") >= BIG_MODULE) & (F.col("value") == "")), text("%d lines without a //! header", F.col("n")), F.lit("no-header"), F.col("n"))


@rule(32, "dead-symbols", scope="repo", engine="WP")
def dead_symbols(f: Facts) -> DataFrame:
    """Public items that no edge and no other spelling of their name reaches; an
    item of a trait, an entry point and a marked one have users that no file shows."""
    defs = f("symbol").where("value in ('function', 'method', 'struct', 'enum', 'trait', 'const', 'static', 'type')").join(f.published, "symbol", "left_semi")
    plain = defs.where((F.size(F.filter("items", lambda x: ~x.startswith("pub"))) == 0) & (F.col("name") != "main"))
    traits = f("trait", False).select(F.concat("symbol", F.lit("::")).alias("t"))
    free = plain.join(traits, F.col("symbol").startswith(F.col("t")), "left_anti")
    unreached = free.join(f.edges.select(F.col("dst").alias("symbol")).distinct(), "symbol", "left_anti")
    live = _outside(unreached, f.named).select("symbol").distinct()
    dead = unreached.join(live, "symbol", "left_anti")
    return finding(dead, text("%s %s is never named", F.col("value"), F.col("name")), F.concat(F.lit("dead-symbol:"), "symbol"), F.col("end_line") - F.col("line") + 1)


@rule(34, "noop-code")
def noop(f: Facts) -> DataFrame:
    lines = f("comment").where("n = 1")
    blocks = runs(lines, ["rel", "col"], "line").where(F.col("length") >= COMMENTED)
    held = lines.select("rel", "col", "module", "line", "value").join(blocks, ["rel", "col"]).where("line between start and stop")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: F.regexp_replace(x["value"], "^// ?", "")), "\n")
    code = held.groupBy("rel", "col", "module", "start", "length").agg(joined.alias("code")).where(parses_as_code("code"))
    rows = code.select("rel", F.col("start").alias("line"), "col", F.col("module").alias("symbol"), "length")
    commented = finding(rows, text("%d comment lines are code", F.col("length")), F.lit("commented-code"), F.col("length"))
    same = finding(f.sites("noop-match"), text("every arm of match %s gives back its pattern", F.col("value")), F.lit("noop-match"), F.col("end_line") - F.col("line") + 1)
    return commented.union(same)


@rule(37, "speculative-generality", "report", "repo", "IDX")
def speculative(f: Facts) -> DataFrame:
    impls = f("impl", False).where("value <> ''").groupBy(F.col("value").alias("name")).agg(F.countDistinct("symbol").alias("k"))
    hidden = f("trait").where("value <> 'pub'").join(impls, "name").where("k = 1")
    single = finding(hidden, text("trait %s has one implementation", F.col("name")), F.concat(F.lit("single-impl:"), "symbol"))
    params = f("generic").where(F.length("name") > 0).groupBy("symbol").agg(F.count("*").alias("n"), F.min(F.struct("name", "rel", "line", "col")).alias("at")).where("n = 1")
    own = f.functions().groupBy("name").agg(F.countDistinct("symbol").alias("d"), F.min("symbol").alias("symbol")).where("d = 1")
    spelled = f("spelled", False).select(F.regexp_replace(_short("name"), r"^\.", "").alias("name"), "value").join(own, "name").groupBy("symbol").agg(F.count("*").alias("k"), F.countDistinct("value").alias("v"), F.min("value").alias("type"))
    mono = params.select("symbol", "at.*").join(spelled.where((F.col("k") >= SITES) & (F.col("v") == 1)), "symbol")
    return single.union(finding(mono, text("every use names %s as %s", F.col("name"), F.col("type")), F.concat_ws(":", F.lit("monomorphic"), "symbol", "name"), F.col("k")))


@rule(39, "comment-discipline", "report", "repo", "IDX")
def copied_docs(f: Facts) -> DataFrame:
    docs = f("docstring").where("n > 1")
    many = docs.groupBy("value").agg(F.countDistinct("name").alias("k"), F.min(F.struct("rel", "line", "col", "symbol")).alias("at")).where("k > 1")
    return finding(many.select("value", "k", "at.*"), text("one doc text on %d items of other names", F.col("k")), F.concat(F.lit("doc-copied:"), F.substring(F.sha2("value", 256), 1, 12)), F.col("k"))


@rule(42, "assertion-free-test", scope="repo", engine="IDX")
def assertion_free(f: Facts) -> DataFrame:
    marked = F.exists("items", lambda x: (x == "test") | x.rlike(r":: test( |$)"))
    tests = f.functions(prod=False).where(marked)
    proven = f("verdict", False).select("symbol").distinct()
    helper = f.edges.join(proven.withColumnRenamed("symbol", "dst"), "dst", "left_semi").select(F.col("src").alias("symbol"))
    # a call that no file explains may decide
    unknown = f("call", False).join(f.edges.select(F.col("src").alias("symbol"), "line").distinct(), ["symbol", "line"], "left_anti").where(~F.col("name").startswith(".") & ~_short("name").rlike("^[A-Z]") & ~F.col("name").rlike("^(std|core|Vec|String|Box|Arc|Rc|Duration|thread)::|sleep$|::new$|::default$")).select("symbol")
    rest = tests.join(proven.union(helper).union(unknown).distinct(), "symbol", "left_anti")
    return finding(rest, text("test %s decides nothing", F.col("name")), F.lit("no-verdict"))


@rule(47, "sleepy-test")
def sleepy(f: Facts) -> DataFrame:
    return finding(f.sites("sleep", prod=False).where("is_test"), text("%s in a test", F.col("value")), F.lit("sleepy"))


@rule(48, "fold-candidate", "report", "repo", "WP")
def fold(f: Facts) -> DataFrame:
    calls = f.edges.where("not is_test").groupBy(F.col("dst").alias("symbol")).agg(F.count("*").alias("calls")).where("calls = 1")
    spelled = f("ref", False).groupBy("name").agg(F.count("*").alias("refs")).where("refs = 1")
    short = f("statement").groupBy("symbol").agg(F.count("*").alias("s")).where("s = 1")
    private = f.functions().where(F.size("items") == 0)
    hit = private.join(calls, "symbol").join(spelled, "name").join(short, "symbol")
    return finding(hit, text("%s has one call and one statement", F.col("name")), F.concat(F.lit("fold:"), "symbol"))


@rule(53, "raise-contract", "report", "repo")
def raise_contract(f: Facts) -> DataFrame:
    docs = f("docstring").where(F.col("value").rlike(r"(?m)^#+ Errors")).select("symbol", "rel", "line", "col", "name", F.regexp_extract("value", r"(?s)#+ Errors(.*)$", 1).alias("said"))
    done = f("raise").groupBy("symbol").agg(F.sort_array(F.collect_set("name")).alias("done"))
    missing = docs.join(done, "symbol").withColumn("more", F.filter("done", lambda x: ~F.col("said").contains(F.substring_index(x, "::", -1)))).where(F.size("more") > 0)
    return finding(missing, F.concat(F.lit("returns errors without saying so: "), owner_list(F.col("more"))), F.concat(F.lit("raise-contract:undeclared:"), F.array_join("more", ",")))


@rule(56, "test-only-symbol", scope="repo", engine="IDX")
def test_only(f: Facts) -> DataFrame:
    defs = f("symbol").where("value in ('function', 'method', 'struct', 'enum', 'const')").join(f.published, "symbol", "left_semi")
    used = _outside(defs, f.named.where("not startswith(scope, 'use ')")).groupBy("symbol").agg(F.bool_and("from_test").alias("only")).where("only").select("symbol")
    return finding(defs.join(used, "symbol", "left_semi"), text("%s is used by tests only", F.col("name")), F.concat(F.lit("test-only:"), "symbol"), F.col("end_line") - F.col("line") + 1)


@rule(59, "cost-docstring", "report", "repo", "IDX")
def cost_docstring(f: Facts) -> DataFrame:
    entry = f.functions().where(F.col("rel").rlike(r"(^|/)(main\.rs|bin/[^/]*\.rs)$") & (F.col("name") == "main") & (F.col("end_line") - F.col("line") + 1 >= ENTRY_LINES))
    told = f("docstring").select("symbol").distinct()
    calls = f("call").where(F.col("name").rlike(SPENDING)).select("symbol").distinct()
    return finding(entry.join(calls, "symbol", "left_semi").join(told, "symbol", "left_anti"), text("%s spends outside the process without saying so", F.col("name")), F.lit("cost"), F.col("end_line") - F.col("line") + 1)
