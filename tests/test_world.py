"""Resolution, effects, checker tables, repository sources and further sinks."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.functions import pytext
from factloom.functions import typestrings as ty
from factloom.operators import checker, effects, rules, world
from factloom.operators.ranks import rank_in_ranges
from factloom.operators.resolve import call_edges, resolve
from factloom.plans.audit import audit
from factloom.sources import files as fs
from factloom.sources import git
from factloom.sources.python_facts import SCHEMA, facts_of


def facts(spark, files):
    return spark.createDataFrame([r for rel, text in files.items() for r in facts_of(rel, text)], SCHEMA)


@pytest.mark.parametrize(
    ("text", "members"),
    [("Literal['a', 1] | None", ["str", "int", "None"]), ("list[Any]", ["list[Any]"]), ("Any", None), ("Unknown | int", None), ("dict[str, A | B] | 'C | D'", ["dict[str, A | B]", "'C | D'"]), ("Literal[b'x', True, E.A]", ["bytes", "bool", "Literal[b'x', True, E.A]"])],
)
def test_union_members(text, members):
    assert ty.union_members(text) == members


def test_type_strings():
    assert ty.join(["tuple[()]", "b", "tuple[int, ...]", "b"]) == ["b", "tuple[int, ...]"]
    assert ty.join(["tuple[()]", "a"]) == ["a", "tuple[()]"]
    assert [ty.return_of(x) for x in ("(a: int) -> ((b) -> int)", "(x) -> (int | None)", "int", "(x) -> ((a) | (b))")] == ["(b) -> int", "int | None", None, "(a) | (b)"]
    assert ty.split_top(r"'a\' , b', [c, d], e", ",") == [r"'a\' , b'", " [c, d]", " e"]


def test_python_strings(spark):
    rows = spark.createDataFrame([(" \x1f\u3000a b\u2003 ", "1_000", 1e-05), ("", "'x' 'y'", 1234567.0), (None, "f(1)", None)], "s string, lit string, n double")
    got = rows.select(pytext.strip(F.col("s")).alias("s"), pytext.literal_repr("lit").alias("lit"), pytext.format_g("n").alias("n"), F.size(pytext.words(F.col("s"))).alias("w")).collect()
    assert [(r.s, r.lit, r.n) for r in got] == [("a b", "1000", "1e-05"), ("", "'xy'", "1.23457e+06"), (None, None, None)]
    assert got[0].w == 2


FILES = {
    "p/__init__.py": "from .base import Base as Root\n",
    "p/base.py": "class Base:\n    def go(self):\n        return self.step()\n\n    def step(self):\n        return 1\n",
    "p/use.py": (
        "import subprocess\nimport p.util as u\nfrom p import Root\n\n\nclass Child(Root):\n    def step(self):\n        return helper(self)\n\n\n"
        "def helper(x):\n    def inner():\n        return u.spend(x)\n    x.items.append(1)\n    return inner()\n\n\nRoot()\nprint(helper(1))\n"
    ),
    "p/util.py": "import subprocess\n\nseen = 0\n\n\ndef spend(x):\n    global seen\n    seen = 1\n    subprocess.run(x)\n    x.unknown()\n    return len(x)\n",
}


def test_resolution(spark):
    got = {(r.scope, r.name): (r.target, r.resolution) for r in resolve(facts(spark, FILES)).collect()}
    assert got["p.base.Base.go", "self.step"] == ("p.base.Base.step", "resolved")
    assert got["p.use.Child.step", "helper"] == ("p.use.helper", "resolved")
    assert got["p.use.helper", "inner"] == ("p.use.helper.inner", "resolved")
    assert got["p.use.helper.inner", "u.spend"] == ("p.util.spend", "resolved")
    assert got["p.use", "Root"] == ("p.base.Base", "resolved")  # through the package that hands it on
    assert got["p.util.spend", "subprocess.run"] == ("subprocess.run", "external")
    assert got["p.util.spend", "len"] == ("len", "unresolved") and got["p.util.spend", "x.unknown"][1] == "unresolved"


def test_effects(spark):
    f = facts(spark, FILES)
    calls = resolve(f)
    out = {r.node: (set(r.atoms), r.unknown) for r in effects.summaries(f, calls, effects.catalog(spark)).collect()}
    assert out["p.util.spend"] == ({"io:spawns", "gw:p.util.seen"}, False)
    assert out["p.use.helper"] == ({"io:spawns", "gw:p.util.seen", "pw:x"}, False)
    assert out["p.use.Child.step"][0] == {"io:spawns", "gw:p.util.seen"} and out["p.base.Base.step"] == (set(), False)
    assert {(r.src, r.dst) for r in call_edges(calls).where("src = 'p.use.helper'").collect()} == {("p.use.helper", "p.use.helper.inner")}
    assert [(r.symbol, r.target) for r in effects.spends(f, calls, effects.catalog(spark)).collect()] == [("p.util.spend", "subprocess.run")]


def test_handlers(spark):
    f = facts(spark, {"m.py": "def f():\n    try:\n        g()\n    except KeyError:\n        raise\n    except (A, B) as e:\n        raise C from e\n    except:\n        return None\n"})
    assert {(r.caught, tuple(r.outcomes)) for r in effects.handler_outcomes(f).collect()} == {("KeyError", ("raises again",)), ("A", ("raises another",)), ("B", ("raises another",)), ("BaseException", ("gives a default",))}


def test_languages_and_names(spark):
    files = spark.createDataFrame([("a/b.py",), ("c.rs",), ("Cargo.toml",)], "rel string")
    marks = {"py": ("pyproject.toml", ".py"), "rs": ("Cargo.toml", ".rs")}
    assert world.languages(files, marks)[0] == ["rs"] and "loose .py" in world.languages(files, marks)[1][0]
    assert world.languages(files.where("rel <> 'Cargo.toml'"), marks) == (["py", "rs"], [])
    assert world.languages(files.limit(0), marks) == (["py"], [])
    assert world.any_name(files, F.col("rel").endswith(".rs")) and not world.any_name(files, F.col("rel") == "x")


def test_readers(spark):
    edges = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "c"), ("tests", "c")], "src string, dst string")
    mods = spark.createDataFrame([("main", "main.py"), ("a", "a.py"), ("b", "b.py"), ("c", "c.py"), ("tests", "tests/t.py")], "module string, rel string")
    refs = spark.createDataFrame([("b", "b.f", "c"), ("a", "a.f", "b"), ("tests", "tests", "c"), ("b", "b.main.x", "a")], "module string, scope string, home string")
    assert [tuple(r) for r in world.readers(edges, refs, mods).collect()] == [("c", "b")]


def test_checker_rules(spark):
    files = {
        "m.py": "def f(a: int, b):\n    if a is None:\n        return b\n    return g(a)\n\n\ndef g(xs: list[int]) -> int:\n    return xs[0] + xs.index(1)\n\n\ndef h(d: dict) -> int:\n    d.update(a=1)\n    return f(1, 'x')\n",
        "t.py": "x = 1  # type: ignore\ny = 2  # pyright: ignore\nz = 3  # type: ignore\n",
    }
    told = {
        "diagnostics": spark.createDataFrame(
            [
                ("m.py", 2, 7, 2, 16, "reportUnnecessaryComparison", "warning", "never None"),
                ("m.py", 4, 11, 4, 12, "reportCallIssue", "error", "bad call"),
                ("t.py", 1, 0, 1, 1, "reportOther", "error", "silenced"),
                ("n.py", 1, 0, 1, 1, "reportMissingImports", "error", "blind"),
            ],
            checker.DIAGNOSTICS,
        ),
        "arg_types": spark.createDataFrame([("m.f", "b", "Literal['x']"), ("m.f", "b", "int | None"), ("m.f", "a", "int")], "symbol string, name string, type string"),
        "return_types": spark.createDataFrame([("m.f", "Any")], "symbol string, type string"),
    }
    one = lambda k, **more: sorted((r.rel, r.line, r.cause) for r in rules.run(facts(spark, files), only=[k], told=told | more).collect())
    assert one(2) == [("m.py", 2, "redundant:reportUnnecessaryComparison")]
    assert one(5) == []  # three members are too many
    assert one(5, arg_types=told["arg_types"].where("type <> 'int | None'")) == [("m.py", 1, "lift:m.f:b")]
    assert one(10) == [("m.py", 7, "over-constrained:m.g:xs")]
    assert one(36) == [("m.py", 1, "any-laundering:m.f"), ("t.py", 1, "type-lies")]
    assert [c for *_, c in one(58)] == ["reportUnnecessaryComparison:m.py:2:7", "reportCallIssue:m.py:4:11"]


def test_diagnostics_source(spark, tmp_path):
    spot = {"start": {"line": 0, "character": 4}, "end": {"line": 0, "character": 9}}
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"generalDiagnostics": [{"file": "/r/a.py", "severity": "error", "message": "m", "rule": "reportX", "range": spot}]}))
    assert [tuple(r) for r in checker.read_diagnostics(spark, str(path), "/r").collect()] == [("a.py", 1, 4, 1, 9, "reportX", "error", "m")]


def test_git_tables(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    assert git.changed_files(spark, str(tmp_path / "none")) is None
    run("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    run("add", "a.py")
    run("-c", "user.name=n", "-c", "user.email=e@e", "commit", "-q", "-m", "m")
    (tmp_path / "a.py").write_text("x = 1\ny = 3\n")
    (tmp_path / "b.py").write_text("z = 1\n")
    assert [r.rel for r in git.changed_files(spark, str(tmp_path)).collect()] == ["a.py", "b.py"]
    lines = git.blame(spark, str(tmp_path), ["a.py", "b.py"])
    assert [(r.rel, r.line) for r in lines.collect()] == [("a.py", 1), ("a.py", 2)] and lines.first().ts > 0
    spans = spark.createDataFrame([("g", "a.py", 1, 2), ("h", "a.py", 2, 3)], "group string, rel string, lo long, hi long")
    days = {r.group: r.days for r in git.youngest_ages(spans, lines, lines.first().ts + 3 * 86400 + 5).collect()}
    assert days["h"] is None and days["g"] in (2, 3)


def test_sinks(spark, tmp_path):
    assert fs.unified_diff("a\nb\n", "a\nc", "m.py") == "--- a/m.py\n+++ b/m.py\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\\ No newline at end of file\n"
    both = spark.createDataFrame([("m.py", "a\n", "b\n"), ("n.py", "a\n", "a\n")], "rel string, before string, after string")
    assert [r.rel for r in fs.patches(both).collect()] == ["m.py"]
    assert [tuple(r) for r in fs.profile_rows(spark, {"a": 0.10004, "b": 2.5, "c": 0.1}).collect()] == [("b", 2.5), ("a", 0.1), ("c", 0.1)]
    fs.dump_layers({"both": both}, str(tmp_path / "dump"))
    assert spark.read.json(str(tmp_path / "dump" / "both")).count() == 2
    toml = '[project]\nscripts = {run = "app.cli:main"}\n[project.entry-points."x.y"]\nz = "app.z:f [extra]"\n'
    assert fs.entry_points(toml) == [("run", "app.cli:main"), ("z", "app.z:f")] and fs.entry_points("not toml [") == []
    files = spark.createDataFrame([("pyproject.toml", toml), ("app/py.typed", ""), ("py.typed", "")], "rel string, text string")
    assert {r.symbol for r in fs.packaging(files).collect()} == {"app.cli.main", "app.z.f"}
    assert {r.folder for r in fs.typed_scope(files).collect()} == {"app", ""}


def test_describe(spark):
    symbols = spark.createDataFrame([("a.load_user", "a.py", 1, "function"), ("a.save", "a.py", 5, "function")], "symbol string, rel string, line int, what string")
    assert [r.symbol for r in fs.describe(symbols, "save").collect()] == ["a.save"]
    (near,) = fs.describe(symbols, "load_users").collect()
    assert near.symbol == "a.load_user" and near.near > 0.9


def test_rank_in_ranges(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, (k * 37) % 101) for k in range(100)], "g int, v int")
    got = sorted((str(r.g), r.v, r.k) for r in rank_in_ranges(rows, ["g"], [F.desc("v")], "k").collect())
    want = []
    for g in (None, 1, 2):
        values = sorted(((k * 37) % 101 for k in range(100) if (k % 3 or None) == g), reverse=True)
        want += [(str(g), v, n + 1) for n, v in enumerate(values)]
    assert got == sorted(want)


def test_audit_follows_moves_and_arms(spark):
    old = spark.createDataFrame([("a.py", "def one(x=[]):\n    return x\n")], "rel string, text string")
    new = spark.createDataFrame([("b.py", "def two(x=[]):\n    return x\n"), ("m.rs", "fn f(e: E) -> E { match e { E::A => E::A } }\n")], "rel string, text string")
    first = audit(old, only=[49])
    base = first.kept.groupBy("rule", "symbol").agg(F.count("*").alias("count"))
    from factloom.plans.audit import shapes

    shaped = base.join(shapes(old, first.facts), "symbol").select("rule", "symbol", "count", "shape")
    assert audit(new, base, only=[49]).excess.count() == 1
    assert audit(new, shaped, only=[49]).excess.count() == 0
    table = spark.createDataFrame([("34", 1, 10, 0), ("rs:34", 5, 10, 1), ("rs:34:noop-match", 10, 10, 2)], "rule string, tp long, n long, place int")
    (row,) = audit(new, precision=table, only=[34]).ranked.collect()
    assert row.lang == "rs" and row.tp == 10
