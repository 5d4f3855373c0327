"""What a type checker says, as relations joined to the facts.

The checker itself is a source: its diagnostics, argument types and return types
come as tables; without them only the readings that need none have rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typestrings import joined_union, union_members_of

DIAGNOSTICS = "rel string, line int, col int, end_line int, end_col int, rule string, severity string, message string"
# fixed values: verdicts of the checker by their published names
MISSING_IMPORT = "reportMissingImports"
REDUNDANT = ("reportUnnecessaryIsInstance", "reportUnnecessaryComparison", "reportUnnecessaryContains", "reportUnnecessaryCast")
WARNINGS = ("reportUnnecessaryComparison", "reportUnusedCoroutine", "reportUnreachable")
PRAGMA = r"#\s*(type:\s*ignore|pyright:\s*ignore|mypy:\s*ignore)"


def read_diagnostics(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """Diagnostics of a checker's JSON report; positions count from line 1."""
    spot = "struct<line:int,character:int>"
    one = f"array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:{spot},end:{spot}>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"generalDiagnostics {one}").alias("j"))
    d = raw.select(F.explode("j.generalDiagnostics").alias("d")).select("d.*")
    rel = F.expr(f"if(startswith(file, '{root}/'), substring(file, {len(root) + 2}), file)") if root else F.col("file")
    return d.select(
        rel.alias("rel"), (F.col("range.start.line") + 1).alias("line"), F.col("range.start.character").alias("col"),
        (F.col("range.end.line") + 1).alias("end_line"), F.col("range.end.character").alias("end_col"), F.coalesce("rule", F.lit("")).alias("rule"), "severity", "message",
    )


def blind_modules(diagnostics: DataFrame) -> DataFrame:
    """(rel): files with an import that the checker could not follow."""
    return diagnostics.where(F.col("rule") == MISSING_IMPORT).select("rel").distinct()


def silenced(facts: DataFrame) -> DataFrame:
    """(rel, line): lines that tell the checker to be quiet."""
    return facts.where("kind = 'comment'").where(F.col("value").rlike(PRAGMA)).select("rel", "line").distinct()


def errors(diagnostics: DataFrame, facts: DataFrame) -> DataFrame:
    """Diagnostics that stand: errors and trusted warnings, of files whose imports
    all resolve, on lines that are not silenced."""
    told = diagnostics.where((F.col("severity") == "error") | F.col("rule").isin(*WARNINGS))
    return told.join(blind_modules(diagnostics), "rel", "left_anti").join(silenced(facts), ["rel", "line"], "left_anti")


def grounded_checks(diagnostics: DataFrame, facts: DataFrame) -> DataFrame:
    """Redundant checks of a parameter whose type the repository itself wrote down,
    and that the function does not bind anew: (diagnostic columns, symbol, name)."""
    kind = lambda k: facts.where(F.col("kind") == k)
    told = diagnostics.where(F.col("rule").isin(*REDUNDANT)).join(blind_modules(diagnostics), "rel", "left_anti")
    loads = kind("ref").where("value = 'load'").select("rel", "line", F.col("col").alias("at"), "symbol", "name")
    met = told.join(loads, ["rel", "line"]).where("at >= col and (end_line > line or at < end_col)")
    typed = kind("param").where("value <> ''").select("symbol", "name").distinct()
    again = kind("ref").where("value = 'store'").select("symbol", "name").distinct()
    first = met.join(typed, ["symbol", "name"], "left_semi").join(again, ["symbol", "name"], "left_anti")
    keys = diagnostics.columns
    return first.groupBy(*keys).agg(F.min_by(F.struct("symbol", "name"), "at").alias("w")).select(*keys, "w.symbol", "w.name")


def lifted_types(arg_types: DataFrame, facts: DataFrame, most: int = 2) -> DataFrame:
    """(symbol, name, type): the union that all call sites give to a parameter without
    an annotation, if it has ``most`` members at most and none is unknown.
    arg_types (symbol, name, type) has a row for each argument of a call."""
    bare = facts.where("kind = 'param' and value = ''").select("symbol", "name").distinct()
    each = arg_types.join(bare, ["symbol", "name"], "left_semi").withColumn("members", union_members_of("type"))
    per = each.groupBy("symbol", "name").agg(F.bool_and(F.col("members").isNotNull()).alias("known"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("all"))
    one = per.where("known and size(all) > 0").select("symbol", "name", joined_union(F.array_join(F.array_sort("all"), " | ")).alias("type"))
    return one.where(F.size(union_members_of("type")) <= most)


def pragma_density(facts: DataFrame) -> DataFrame:
    """(module, rel, lines, pragmas, line): modules with the pragmas that silence the
    checker, and the first of them."""
    told = facts.where("kind = 'comment'").where(F.col("value").rlike(PRAGMA))
    per = told.groupBy("rel").agg(F.count("*").alias("pragmas"), F.min("line").alias("line"))
    return facts.where("kind = 'module'").select("module", "rel", F.col("n").alias("lines")).join(per, "rel")


def laundered(returns: DataFrame, calls: DataFrame, facts: DataFrame) -> DataFrame:
    """(symbol): functions that the checker sees return Any, called by functions whose
    own returns are annotated.  returns (symbol, type), calls (scope, target)."""
    loose = returns.where(F.col("type").isin("Any", "Unknown")).select("symbol")
    typed = facts.where("kind = 'returns' and value <> ''").select(F.col("symbol").alias("scope")).distinct()
    return calls.join(typed, "scope", "left_semi").select(F.col("target").alias("symbol")).distinct().join(loose, "symbol", "left_semi")


# fixed values: the least protocol of a concrete container, and what it offers
PROTOCOLS = {
    "list": ("Sequence", ("index", "count", "getitem")),
    "dict": ("Mapping", ("get", "keys", "values", "items", "getitem")),
    "set": ("AbstractSet", ("isdisjoint", "issubset", "issuperset", "union", "intersection", "difference")),
}


def wide_enough(facts: DataFrame) -> DataFrame:
    """(symbol, name, annotation, protocol, rel, line, col): parameters annotated with
    a concrete container of which only a protocol's part is used.  One that is bound
    anew, or handed on whole, may be used in any way."""
    kind = lambda k: facts.where(F.col("kind") == k)
    base = F.lower(F.regexp_extract("value", r"^(?:typing\.)?([A-Za-z]+)", 1))
    params = kind("param").select("symbol", "name", F.col("value").alias("annotation"), base.alias("base"), "rel", "line", "col").where(F.col("base").isin(*PROTOCOLS))
    touched = kind("ref").where("value in ('attr', 'attr-store')").select("symbol", F.element_at("items", 1).alias("name"), F.col("name").alias("op"))
    used = touched.union(kind("use").select("symbol", "name", F.col("value").alias("op"))).groupBy("symbol", "name").agg(F.collect_set("op").alias("ops"))
    again = kind("ref").where("value = 'store'").select("symbol", "name").distinct()
    handed = kind("call").select("symbol", F.explode("items").alias("g")).select("symbol", F.regexp_replace("g", r"^(\w+=|\*+)", "").alias("name"))
    given = kind("plain-return").select("symbol", F.col("value").alias("name"))
    free = params.join(again, ["symbol", "name"], "left_anti").join(handed.union(given).distinct(), ["symbol", "name"], "left_anti").join(used, ["symbol", "name"])
    offers, protocol = F.array().cast("array<string>"), F.lit(None).cast("string")
    for name, (wide, ops) in PROTOCOLS.items():
        offers = F.when(F.col("base") == name, F.array(*map(F.lit, ops))).otherwise(offers)
        protocol = F.when(F.col("base") == name, wide).otherwise(protocol)
    return free.where(F.size(F.array_except("ops", offers)) == 0).select("symbol", "name", "annotation", protocol.alias("protocol"), "rel", "line", "col")
