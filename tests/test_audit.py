"""The audit end to end, its sources and its sinks."""

import json

from pyspark.sql import functions as F

from factloom.operators import rules
from factloom.plans.audit import audit, gate, report_rows
from factloom.plans.rule_queries import FILES, audit_inline
from factloom.sources import files as fs
from factloom.sources.python_facts import extract, read_tree
from factloom.streaming.gate_stream import gate_stream


SOME = [1, 12, 32, 47, 49]  # a plan of all rules takes Spark long to compile; one test runs them all


def table(spark):
    return spark.createDataFrame(FILES, "rel string, text string")


def test_audit_ranks_and_suppresses(spark):
    rows = audit_inline(spark, "").collect()
    found = {(r.rule, r.rel) for r in rows}
    assert {("1", "shop/api.py"), ("49", "shop/api.py"), ("12", "shop/a.py"), ("35", "shop/a.py"), ("47", "tests/test_a.py")} <= found
    assert ("32", "shop/b.py") not in {(r.rule, r.rel) for r in rows if r.symbol == "shop.b.lonely"}
    assert [r.p_real for r in rows] == sorted((r.p_real for r in rows), reverse=True)


def test_baseline_absorbs(spark):
    files = table(spark)
    full = audit(files, only=SOME)
    base = full.kept.groupBy("rule", "symbol").agg(F.count("*").alias("count"))
    assert audit(files, base, only=SOME).excess.count() == 0
    assert audit(files, base.where("rule <> '49'"), only=SOME).excess.select("rule").distinct().collect()[0].rule == "49"


def test_gate_is_part_of_full(spark):
    files = table(spark)
    changed = spark.createDataFrame([("shop/a.py",), ("shop/api.py",)], "rel string")
    keys = ["rule", "rel", "line", "col", "message"]
    fast = {tuple(r) for r in gate(files, changed).select(*keys).collect()}
    full = {tuple(r) for r in audit(files, only=[12, 18, 20, 24, 26, 29, 34, 39, 47, 49, 50, 7]).kept.select(*keys).collect()}
    assert fast and fast <= full and {r[1] for r in fast} <= {"shop/a.py", "shop/api.py"}


def test_same_rows_at_any_parallelism(spark):
    a = audit(table(spark), only=SOME).ranked.collect()
    b = audit(table(spark).repartition(7), only=SOME).ranked.collect()
    assert a == b


def test_renders(spark):
    rows = [r.asDict() for r in report_rows(audit(table(spark), only=SOME).ranked).collect()]
    text = fs.to_text(rows)
    assert text.index("shop/a.py") < text.index("tests/test_a.py")
    sarif = json.loads(fs.to_sarif(rows, "factloom"))
    assert len(sarif["runs"][0]["results"]) == len(rows)
    plain = [{"rule": r["rule"], "file": r["rel"], "line": r["line"]} for r in rows]
    assert json.loads(fs.to_json(plain, {"n": 1}))["findings"] == plain


def test_baseline_files(spark, tmp_path):
    path = tmp_path / "base.txt"
    path.write_text("# head\n\n3|a.b 2 0123456789abcdef\n3|a.b 5 fedcba9876543210\n4|c d 1\n")
    got = {(r.rule, r.symbol, r["count"], r["shape"]) for r in fs.read_baseline(spark, str(path)).collect()}
    assert got == {("3", "a.b", 5, "fedcba9876543210"), ("4", "c d", 1, None)}
    assert [r.value for r in fs.baseline_lines(fs.read_baseline(spark, str(path))).collect()] == ["3|a.b 5 fedcba9876543210", "4|c d 1"]
    old = tmp_path / "old.json"
    old.write_text('{"counts": {"3|a|b": 2, "4|c": "1"}}')
    assert {(r.rule, r.symbol, r["count"]) for r in fs.read_legacy_baseline(spark, str(old)).collect()} == {("3", "a|b", 2), ("4", "c", 1)}


def test_sheet_round_trip(spark, tmp_path):
    row = {c: c for c in fs.SHEET} | {"message": 'a "b"\tc\nd', "line": "3"}
    path = tmp_path / "s.tsv"
    path.write_text(fs.sheet_text([row]))
    assert [r.asDict() for r in fs.read_sheet(spark, str(path)).collect()] == [row]


def test_audit_json_source(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(fs.to_json([{"rule": "3", "file": "a.py", "line": 2, "col": 0, "symbol": "a", "message": "m", "cause": "c", "salience": 1.5}], {}))
    (r,) = fs.read_audit(spark, str(path)).collect()
    assert (r.rule, r.file, r.line, r.salience) == ("3", "a.py", 2, 1.5)


def test_config():
    assert fs.read_config("[tool.x]\nexcludes = ['a']\nrules-off = 3\n", "x")["excludes"] == ["a"]
    assert fs.read_config("[tool.x]\nrules-off = 3\n", "x")["rules-off"] == []
    assert fs.read_config("not toml [", "x")["complexity-threshold"] == 15


def test_tree_source(spark, tmp_path):
    for rel in ("a/b.py", ".git/c.py", "venv/d.py", "e.txt"):
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x = 1\r\n")
    rows = read_tree(spark, str(tmp_path)).collect()
    assert [(r.rel, r.text, r.lossy) for r in rows] == [("a/b.py", "x = 1\n", False)]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(FILES, "rel string, text string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("rel string, text string").parquet(str(source))
    q = gate_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    rules_found = {r.rule for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "49" in {str(x) for x in rules_found}


def test_registry():
    assert len(rules.REGISTRY) >= 32
    assert len({r.slug for r in rules.REGISTRY.values()}) == len(rules.REGISTRY)
    assert extract is not None
