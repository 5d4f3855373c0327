"""The whole audit: facts, rules, suppression, baseline, rank, filter, top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import score, tier_bar
from ..functions.paths import dotted_prefixes, is_test_path, under
from ..functions.text import body_shape
from ..operators import findings as fo
from ..operators import rules, rust_rules
from ..operators.lineage import settled
from ..operators.ranks import rank_in_ranges
from ..operators.world import united
from ..sources import rust_facts
from ..sources.python_facts import extract

KEY = ("rule", "symbol")


@dataclass
class Audit:
    """The relations of an audit, all lazy."""

    facts: DataFrame
    findings: DataFrame
    kept: DataFrame
    excess: DataFrame
    ranked: DataFrame


def with_order(found: DataFrame) -> DataFrame:
    """Emission order as a value: rules in registry order, then place."""
    return found.withColumn("ord", F.struct("lang", F.col("rule").cast("int").alias("rule"), "rel", "line", "col", "cause", "message"))


def reading_order() -> list:
    """The order of the report: likeliest first, rules in turn."""
    return [F.desc("p_real"), F.asc("within"), F.desc("cc"), F.asc("rel"), F.asc("line"), F.asc("col"), F.col("rule").cast("int").asc(), F.asc("ord")]


def shapes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """(symbol, shape): the digest of each definition's body without its own name."""
    spans = facts.where("kind = 'symbol' and line > 0 and end_line >= line").groupBy("symbol").agg(F.min(F.struct("rel", "line", "end_line")).alias("s")).select("symbol", "s.*")
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    name = F.element_at(F.split("symbol", r"\.|::"), -1)
    return spans.join(files.select("rel", "text"), "rel").select("symbol", body_shape(body, name).alias("shape"))


def with_moves(baseline: DataFrame, found: DataFrame, bodies: DataFrame) -> DataFrame:
    """baseline with the budgets of keys that moved: a key that it lacks takes over
    the entry of an unclaimed key with the same rule and body."""
    key = list(KEY)
    now = found.select(*key).distinct().join(bodies, "symbol", "left")
    missing = now.join(baseline.select(*key), key, "left_anti")
    pool = baseline.join(now.select(*key), key, "left_anti")
    moved = fo.moved_budget(missing.select(*key, "shape"), pool.select(*key, "shape", "count"), ["rule", "shape"], "symbol")
    return baseline.select(*key, "count").union(moved.select(*key, "from_count"))


def by_arm(found: DataFrame, precision: DataFrame) -> DataFrame:
    """found with ``tp`` and ``n`` of its rule, or of the arm that its cause names.

    precision has a row for each key: a rule, or ``rule:arm`` with the start of the
    causes it covers; a rule of another language is led by its name.  The first such
    arm in the table's order counts."""
    rule = F.when(F.coalesce("lang", F.lit("py")) == "py", F.col("rule")).otherwise(F.concat_ws(":", "lang", "rule"))
    keyed = found.withColumn("__key", rule)
    table = precision if "place" in precision.columns else precision.withColumn("place", F.lit(0))
    arms = keyed.select("__key", "cause").distinct().withColumn("key", F.explode(dotted_prefixes(F.concat_ws(":", "__key", "cause"), ":")))
    rows = table.select(F.col("rule").alias("key"), "tp", "n", "place")
    met = arms.join(rows, "key").where((F.col("key") == F.col("__key")) | F.col("key").startswith(F.concat("__key", F.lit(":"))))
    best = met.groupBy("__key", "cause").agg(F.min_by(F.struct("tp", "n"), F.struct(F.col("key") == F.col("__key"), "place", "key")).alias("b"))
    return keyed.join(best, ["__key", "cause"], "left").select(*found.columns, "b.tp", "b.n")


def audit(
    files: DataFrame,
    baseline: DataFrame | None = None,
    precision: DataFrame | None = None,
    marker: str = "factloom",
    only: list[int] | None = None,
    paths: list[str] | None = None,
    top: int | None = None,
    roots: tuple[str, ...] = (),
    told: dict[str, DataFrame] | None = None,
) -> Audit:
    """files (rel, text) of Python and Rust; baseline (rule, symbol, count, and shape
    to follow moved definitions); precision (rule, tp, n), where rule can be an arm;
    roots: name patterns of hot code; told: tables of a checker."""
    python, rust = files.where(~F.col("rel").endswith(".rs")), files.where(F.col("rel").endswith(".rs"))
    both = not rust.isEmpty()
    own = settled(extract(python))
    other = settled(rust_facts.extract(rust)) if both else None
    facts = united([own, other]) if both else own
    found = settled(with_order(rules.run(own, only, roots=roots, rust=other, told=told)))
    lines = files.select("rel", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    slugs = files.sparkSession.createDataFrame(sorted({(r.slug, str(r.id)) for g in (rules.REGISTRY, rust_rules.REGISTRY) for r in g.values()}), "name string, id string")
    told = fo.marker_table(lines.where(~F.col("rel").endswith(".rs")), rf"#\s*{marker}", "#").union(fo.marker_table(lines.where(F.col("rel").endswith(".rs")), rf"//\s*{marker}", "//"))
    marks = told.join(F.broadcast(slugs), "name", "left").select("rel", "line", F.coalesce("id", "name").alias("name"))
    symbols = facts.where("kind = 'symbol'").select("rel", "line", F.col("symbol").alias("qname"))
    kept = fo.suppress(found, marks, symbols).where("not suppressed").drop("suppressed")
    order = [F.asc("rel"), F.asc("line"), F.asc("col"), F.asc("cause"), F.asc("ord")]
    excess = kept
    if baseline is not None:
        budgets = with_moves(baseline, kept, shapes(files, facts)) if "shape" in baseline.columns else baseline
        excess = fo.budgeted_diff(kept, budgets, KEY, order, "line")
    cc = facts.where("kind = 'symbol' and value in ('function', 'method')").groupBy("symbol").agg(F.max("n").alias("cc"))
    judged = excess.join(cc, "symbol", "left").withColumn("cc", F.coalesce("cc", F.lit(0)))
    if precision is None:
        judged = judged.withColumn("p_real", F.lit(0.0))
    else:
        judged = by_arm(judged, precision)
        judged = judged.withColumn("p_real", F.coalesce(score(F.col("tp"), F.col("n"), tier_bar(F.col("tier"))), F.lit(0.0)))
    place = [F.desc("cc"), F.asc("rel"), F.asc("line"), F.asc("col")]
    within = fo.rank_within(judged, ["rule"], [F.desc("salience"), *place, F.asc("cause"), F.asc("ord")])
    ranked = within.orderBy(*reading_order()).where(under(F.col("rel"), paths or []))
    return Audit(facts, found, kept, excess, ranked.limit(top) if top else ranked)


def gate(files: DataFrame, changed: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Blocking findings of changed files: file-scoped rules only, so that they are
    a part of what the full run blocks on."""
    fast = [r.id for r in rules.REGISTRY.values() if r.scope == "file" and r.posture != "report"]
    part = files.join(changed.select("rel").distinct(), "rel", "left_semi")
    rows = audit(part, baseline, only=fast).excess
    return rows.orderBy("rel", "line", F.col("rule").cast("int"), "cause")


def report_rows(ranked: DataFrame) -> DataFrame:
    """Rows in the order of the text report."""
    numbered = rank_in_ranges(ranked, [], reading_order(), "rank")
    return fo.rollup_order(numbered, ["rel"], ["symbol"], "rank", is_test_path(F.col("rel")))
