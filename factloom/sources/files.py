"""Text sources and sinks of the findings pipeline."""

from __future__ import annotations

import csv
import difflib
import io
import json
import tomllib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_ratio
from ..operators.findings import merge_baseline

# fixed values: the columns of a judging sheet
SHEET = ("key", "rule", "slug", "arm", "tier", "file", "line", "symbol", "message", "verdict", "why")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(rule, symbol, count, shape): lines ``rule|symbol count [shape]``; a key that
    stands twice, as after a merge, keeps the row with the larger count."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    # a fixed value: the line form of a baseline
    pattern = r"^([^|\s]+)\|(.*) (\d+)(?: ([0-9a-f]{16}))?\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    good = rows.where(F.col("value").rlike(pattern))
    cols = good.select(part(1).alias("rule"), part(2).alias("symbol"), part(3).cast("long").alias("count"), F.nullif(part(4), F.lit("")).alias("shape"))
    return merge_baseline(cols, ["rule", "symbol"])


def baseline_lines(counts: DataFrame) -> DataFrame:
    """The text lines of a baseline, in key order."""
    key = F.concat_ws("|", "rule", "symbol")
    return counts.select(key.alias("key"), F.concat_ws(" ", key, F.col("count").cast("string"), "shape").alias("value")).orderBy("key").select("value")


def read_legacy_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The older JSON form: {"counts": {"rule|symbol": number or its text}}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "counts map<string,string>").alias("j"))
    rows = raw.select(F.explode("j.counts").alias("k", "n"))
    return rows.select(F.split("k", r"\|", 2)[0].alias("rule"), F.split("k", r"\|", 2)[1].alias("symbol"), F.col("n").cast("long").alias("count"), F.lit(None).cast("string").alias("shape"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A judging sheet: quoted, tab-separated, all columns text."""
    schema = ", ".join(f"{c} string" for c in SHEET)
    return spark.read.csv(path, schema=schema, sep="\t", quote='"', escape='"', header=True, multiLine=True)


def sheet_text(rows: Iterable) -> str:
    out = io.StringIO()
    w = csv.writer(out, delimiter="\t", quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerow(SHEET)
    w.writerows([r[c] if r[c] is not None else "" for c in SHEET] for r in rows)
    return out.getvalue()


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a JSON audit."""
    item = "rule string, slug string, tier string, file string, line int, col int, symbol string, message string, cause string, salience double"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"findings array<struct<{', '.join(x.replace(' ', ':') for x in item.split(', '))}>>").alias("j"))
    return raw.select(F.inline("j.findings"))


def read_config(text: str, tool: str) -> dict:
    """Settings of a TOML file, from ``[tool.<name>]`` if it has that table; what
    is malformed falls back to its default."""
    base = {"excludes": [], "rules-off": [], "overrides": [], "complexity-threshold": 15, "hot-roots": [], "published": []}
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return base
    own = data.get("tool", {}).get(tool, data if "tool" not in data else {})
    return {k: own[k] if isinstance(own.get(k), type(v)) else v for k, v in base.items()}


def to_json(findings: Iterable[dict], provenance: dict) -> str:
    """An audit as JSON: sorted keys, two spaces, ASCII."""
    return json.dumps({"findings": list(findings), "provenance": provenance}, sort_keys=True, indent=2, ensure_ascii=True)


# fixed values: the report levels of the postures
LEVELS = {"gate": "error", "ratchet": "warning", "report": "note"}


def to_sarif(findings: Iterable[dict], tool: str, version: str = "0") -> str:
    """An audit as SARIF 2.1.0; the cause is the fingerprint."""
    rows = list(findings)
    rules = {r["rule"]: {"id": str(r["rule"]), "name": r["slug"]} for r in rows}
    results = [
        {
            "ruleId": str(r["rule"]),
            "level": LEVELS[r["posture"]],
            "message": {"text": r["message"]},
            "partialFingerprints": {"cause": r["cause"]},
            "locations": [
                {"physicalLocation": {"artifactLocation": {"uri": r["rel"]}, "region": {"startLine": max(1, r["line"]), "startColumn": r["col"] + 1}}}
            ],
        }
        for r in rows
    ]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": [rules[k] for k in sorted(rules)]}}, "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, sort_keys=True, indent=2)


def to_text(rows: Iterable[dict]) -> str:
    """A report by file and symbol of rows in rollup order."""
    out, file, symbol = [], None, None
    for r in rows:
        if r["rel"] != file:
            file, symbol = r["rel"], None
            out.append(file)
        if r["symbol"] != symbol:
            symbol = r["symbol"]
            out.append(f"  {symbol}")
        out.append(f"    {r['line']}: [{r['rule']} {r['slug']}] {r['message']}")
    return "\n".join(out) + "\n" * bool(out)


def unified_diff(before: str, after: str, rel: str) -> str:
    """A patch from one text to another, with three lines of context; a last line
    without a newline is marked."""
    out = []
    for line in difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{rel}", f"b/{rel}"):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def patches(files: DataFrame) -> DataFrame:
    """(rel, patch) of files (rel, before, after) that differ."""
    make = F.udf(lambda a, b, rel: unified_diff(a or "", b or "", rel), "string")
    changed = files.where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select("rel", make("before", "after", "rel").alias("patch"))


def dump_layers(layers: dict[str, DataFrame], out: str) -> None:
    """Each intermediate relation as JSON lines in a folder of its own."""
    for name, df in layers.items():
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{out}/{name}")


def profile_rows(spark: SparkSession, walls: dict[str, float]) -> DataFrame:
    """(pass, seconds) of timed passes, the slowest first; times are rounded to
    milliseconds once they are in order."""
    rows = spark.createDataFrame([(k, float(v)) for k, v in walls.items()], "pass string, wall double")
    return rows.orderBy(F.desc("wall"), "pass").select("pass", F.round("wall", 3).alias("seconds"))


def entry_points(text: str) -> list[tuple[str, str]]:
    """(command, target) of a project file's scripts and entry points."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project = data.get("project", {})
    tables = [project.get("scripts", {}), project.get("gui-scripts", {}), *project.get("entry-points", {}).values(), data.get("tool", {}).get("poetry", {}).get("scripts", {})]
    return sorted((k, v.partition("[")[0].strip()) for t in tables if isinstance(t, dict) for k, v in t.items() if isinstance(v, str))


def packaging(files: DataFrame) -> DataFrame:
    """(rel, command, target, symbol): what project files offer as commands.  The
    symbol is the dotted name of the target."""
    kind = "array<struct<command:string,target:string>>"
    rows = files.where(F.substring_index("rel", "/", -1) == "pyproject.toml").select("rel", F.explode(F.udf(entry_points, kind)("text")).alias("e"))
    return rows.select("rel", "e.command", "e.target", F.replace("e.target", F.lit(":"), F.lit(".")).alias("symbol"))


def typed_scope(files: DataFrame) -> DataFrame:
    """(folder): packages that say they are typed, by a ``py.typed`` file."""
    return files.where(F.substring_index("rel", "/", -1) == "py.typed").select(F.regexp_replace("rel", r"/?py\.typed$", "").alias("folder")).distinct()


def retired(rows: DataFrame, ident: str) -> DataFrame:
    """Decisions (ts, decision, why, evidence) that bury a rule: they name it and say
    that it was cut or retired; those that its number leads, if there are any."""
    named = rows.where(F.col("decision").rlike(rf"#{ident}(?![0-9])") & F.col("decision").rlike("cut|retired"))
    lead = F.col("decision").startswith(f"#{ident}")
    some = named.agg(F.coalesce(F.bool_or(lead), F.lit(False)).alias("__some"))
    return named.join(F.broadcast(some), F.lit(True)).where(lead | ~F.col("__some")).drop("__some")


def describe(symbols: DataFrame, name: str, most: int = 5) -> DataFrame:
    """The card of a symbol: its definition, or the nearest names if there is none.
    symbols (symbol, rel, line, what); ``near`` is null for a hit."""
    hit = symbols.where((F.col("symbol") == name) | F.col("symbol").endswith("." + name)).withColumn("near", F.lit(None).cast("double"))
    if not hit.isEmpty():
        return hit
    rated = symbols.withColumn("near", name_ratio(F.lower(F.element_at(F.split("symbol", r"\."), -1)), F.lit(name.rpartition(".")[2].lower())))
    return rated.where("near >= 0.6").orderBy(F.desc("near"), "symbol").limit(most)
