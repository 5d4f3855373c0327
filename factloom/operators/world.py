"""What a repository offers the outside: modules' importers, readers and homes,
published names, roots of hot code, and the languages it is written in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dotted_prefixes, fnmatch, glob_regex, is_test_path
from .graph import class_closure

# fixed values: files that make a folder ship on its own
MANIFESTS = ("pyproject.toml", "setup.py", "setup.cfg", "SKILL.md")
COST = r"(?i)\b(hot (path|loop)|per[- ](frame|tick|request|row|token|batch)|O\([^)\s]{1,20}\))"


def any_name(files: DataFrame, pred: Column) -> bool:
    """Whether some file's name satisfies pred; reading stops at the first."""
    return not files.where(pred).limit(1).isEmpty()


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """The facts of several languages as one relation; their keys are disjoint."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def languages(files: DataFrame, marks: Mapping[str, tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(languages to read, notes).  marks: {language: (manifest name, suffix)}.

    Languages with a manifest are read; without any manifest those with loose
    files; else the first one.  A note names loose files beside a marked tree."""
    name = F.element_at(F.split("rel", "/"), -1)
    seen = files.agg(
        *(F.coalesce(F.bool_or(name == manifest), F.lit(False)).alias(f"m{k}") for k, (manifest, _) in enumerate(marks.values())),
        *(F.coalesce(F.bool_or(F.col("rel").endswith(suffix)), F.lit(False)).alias(f"l{k}") for k, (_, suffix) in enumerate(marks.values())),
    ).first()
    order = list(marks)
    marked = [x for k, x in enumerate(order) if seen[f"m{k}"]]
    loose = [x for k, x in enumerate(order) if seen[f"l{k}"] and not seen[f"m{k}"]]
    if not marked:
        return loose or order[:1], []
    return marked, [f"{x}: loose {marks[x][1]} files skipped beside a marked tree; a manifest marks a {x} tree to audit" for x in loose]


def importers(edges: DataFrame) -> DataFrame:
    """(module, importers) of import edges (src, dst)."""
    return edges.groupBy(F.col("dst").alias("module")).agg(F.sort_array(F.collect_set("src")).alias("importers"))


def readers(edges: DataFrame, refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, reader): production modules that read a module.

    A reader is imported by a module that a production module imports, and refers
    to the module's names outside its own ``main``.  edges (src, dst), refs
    (module, scope, target module as ``home``), modules (module, rel)."""
    prod = modules.where(~is_test_path(F.col("rel"))).select("module")
    own = edges.join(prod.withColumnRenamed("module", "src"), "src", "left_semi").select(F.col("dst").alias("src")).distinct()
    driven = own.join(prod.withColumnRenamed("module", "src"), "src", "left_semi")
    read = edges.join(driven, "src", "left_semi").select(F.col("dst").alias("module")).distinct().join(prod, "module", "left_semi")
    main = F.concat("module", F.lit(".main"))
    used = refs.where("home <> module").where((F.col("scope") != main) & ~F.col("scope").startswith(F.concat(main, F.lit("."))))
    return used.join(read, "module", "left_semi").select(F.col("home").alias("module"), F.col("module").alias("reader")).distinct()


def shared_homes(modules: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, home): where a second copy of a module's code could move to.

    The innermost folder with a manifest; else the repository, for modules at its
    root or in a package; else the own folder if the repository imports from it;
    else the file itself.  modules (module, rel), files (rel), edges (src, dst)."""
    head = lambda df: df.withColumn("folder", F.when(F.col("rel").contains("/"), F.expr("substring(rel, 1, length(rel) - length(substring_index(rel, '/', -1)) - 1)")).otherwise(""))
    last = F.element_at(F.split("rel", "/"), -1)
    placed = head(modules.select("module", "rel"))
    held = head(files.select("rel")).withColumn("last", last)
    bundles = held.where(F.col("last").isin(*MANIFESTS) & (F.col("folder") != "")).select(F.col("folder").alias("bundle")).distinct()
    packages = head(modules.select("rel")).where(last == "__init__.py").select("folder").distinct().withColumn("package", F.lit(True))
    used = placed.join(edges.select(F.col("dst").alias("module")).distinct(), "module", "left_semi").select("folder").distinct().withColumn("used", F.lit(True))
    up = placed.where("folder <> ''").select("module", F.posexplode(dotted_prefixes(F.col("folder"), "/")).alias("k", "bundle"))
    inner = up.join(bundles, "bundle").groupBy("module").agg(F.min_by("bundle", "k").alias("bundle"))
    out = placed.join(inner, "module", "left").join(packages, "folder", "left").join(used, "folder", "left")
    home = F.coalesce("bundle", F.when((F.col("folder") == "") | F.col("package"), F.lit("")), F.when(F.col("used"), F.col("folder")), F.col("rel"))
    return out.select("module", home.alias("home"))


def published(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols that outside code can name: public, of a published module, and held
    by classes only.  symbols (symbol, module, kind, parent, public)."""
    links = symbols.where("parent is not null").select(F.col("symbol").alias("child"), F.col("parent").alias("base"))
    start = symbols.where("public").join(modules.select("module").distinct(), "module", "left_semi")
    above = class_closure(links, start.select(F.col("symbol").alias("src"))).where("depth > 0")
    inside = above.join(symbols.where("kind <> 'class'").select(F.col("symbol").alias("dst")), "dst", "left_semi").select(F.col("src").alias("symbol")).distinct()
    return start.join(inside, "symbol", "left_anti")


def hot_roots(functions: DataFrame, docs: DataFrame, patterns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(roots, missing patterns): functions whose name matches a pattern, and
    production functions whose docstring speaks of cost.  functions (symbol, rel),
    docs (symbol, value)."""
    named = reduce(lambda a, b: a | b, (fnmatch(F.col("symbol"), p) for p in patterns), F.lit(False))
    told = docs.where(F.col("value").rlike(COST)).select("symbol")
    costly = functions.where(~is_test_path(F.col("rel"))).join(told, "symbol", "left_semi")
    roots = functions.where(named).select("symbol").union(costly.select("symbol")).distinct()
    spark = functions.sparkSession
    asked = spark.createDataFrame([(p, glob_regex(p)) for p in patterns], "pattern string, regex string")
    met = functions.agg(*(F.coalesce(F.bool_or(fnmatch(F.col("symbol"), p)), F.lit(False)).alias(f"p{k}") for k, p in enumerate(patterns))) if patterns else None
    if met is None:
        return roots, asked.select("pattern")
    hits = met.select(F.explode(F.array(*(F.struct(F.lit(p).alias("pattern"), F.col(f"p{k}").alias("hit")) for k, p in enumerate(patterns)))).alias("x"))
    return roots, hits.select("x.*").where("not hit").select("pattern")
