"""Each rule on a small inline repository: it fires once there, and a clean file stays silent."""

import pytest

from factloom.operators import rules
from factloom.sources.python_facts import COLUMNS, SCHEMA, complexity, facts_of, module_name
from factloom.sources.rust_facts import facts_of as rust_facts_of
from factloom.sources.rust_facts import module_name as module_of

CASES = {
    1: {"api.py": "def load(n: int = None):\n    return n\n"},
    3: {"m.py": "def f(items: list):\n    if items:\n        items.sort()\n"},
    6: {"m.py": "def get_x():\n    global x\n    x = 1\n    return x\n"},
    7: {"m.py": 'def f(a):\n    """The caller must close a."""\n    return a\n'},
    9: {"m.py": "".join(f"def f{k}():\n    global n\n    n = {k}\n" for k in range(3))},
    11: {f"{n}.py": "def f(a, b):\n    t = 0\n    for x in a:\n        if x > b:\n            t += x * b\n    return t\n".replace("a", n).replace("f(", f"f{n}(") for n in ("a", "c")},
    12: {"m.py": "def f(a):\n    for i in range(len(a)):\n        print(a[i])\n"},
    14: {"m.py": "".join(f"def f{k}(host, port, user):\n    return {k}\n" for k in range(3))},
    18: {"m.py": "def f():\n    # Step 1: read\n    a = 1\n    # Step 2: write\n    return a\n"},
    20: {"m.py": "a = sorted(x, key=lambda t: t.a + t.b)\n" * 3},
    21: {"m.py": "class C:\n" + "".join(f"    def f{k}(self):\n        if self.a and self.b > 3:\n            return {k}\n" for k in range(3))},
    23: {"m.py": "def f(a):\n" + "".join("    " * (k + 1) + f"if a > {k}:\n" for k in range(6)) + "    " * 7 + "return a\n"},
    24: {"m.py": "def f(a, n):\n    return getattr(a, 'x' + n)\n"},
    26: {"m.py": "from os import *\n"},
    29: {"m.py": "a = 1\n" * 150},
    32: {"m.py": "def lonely():\n    return 1\n"},
    33: {"m.py": "def f(a) -> int:\n    if a:\n        return 1\n    return None\n"},
    34: {"m.py": "def f():\n    try:\n        g()\n    except Exception:\n        pass\n"},
    35: {"p/__init__.py": "", "p/a.py": "import p.b\n", "p/b.py": "import p.a\n"},
    37: {"m.py": "def f(a, b=1):\n    return a + b\n\n\n" + "f(1)\n" * 3},
    38: {f"{n}.py": "LIMITS = (10, 20, 30, 40)\n" for n in "abc"},
    39: {"m.py": 'def load_user(a):\n    """Load the user."""\n    return a\n'},
    40: {"m.py": "def is_open(a) -> int:\n    return a\n"},
    41: {"m.py": 'import re\n\n\ndef f(a):\n    """Runs per row."""\n    for x in a:\n        g(x)\n\n\ndef g(x):\n    for y in x:\n        re.compile(y)\n'},
    42: {"tests/test_m.py": "def test_a():\n    run()\n"},
    44: {"tests/test_m.py": "def test_a():\n    assert x == x\n"},
    47: {"tests/test_m.py": "import time\ndef test_a():\n    time.sleep(2)\n    assert g()\n"},
    48: {"m.py": "def _one(a):\n    return a + 1\n\n\ndef two(b):\n    return _one(b)\n"},
    49: {"m.py": "def f(a=[]):\n    return a\n"},
    50: {"m.py": "def f(a: int, b):\n    return a\n"},
    53: {"m.py": 'def f(a):\n    """Do.\n\n    Raises:\n        KeyError: if a.\n    """\n    raise ValueError(a)\n'},
    54: {"m.py": "".join(f"def f{k}(a):\n    if a.kind == 'red':\n        return 1\n    if a.kind == 'blue':\n        return 2\n" for k in range(3))},
    55: {"m.py": "def f(a, b, c, d, e):\n    return a\n"},
    56: {"m.py": "def helper():\n    return 1\n", "tests/test_m.py": "from m import helper\ndef test_a():\n    assert helper() == 1\n"},
    57: {"m.py": "def f():\n    return {'a': 1, 'b': 2}\n\n\nx = f()\nprint(x['a'])\n"},
    59: {"m.py": "import subprocess\n\n\ndef f(a):\n" + "    a += 1\n" * 30 + "    subprocess.run(a)\n"},
    60: {"m.py": "def job():\n    return 1\n", "n.py": "def job():\n    return 2\n\n\njob()\n"},
}
CLEAN = {"ok.py": '"""A module."""\n\n\ndef double(value: int) -> int:\n    """Twice the value given."""\n    return value * 2\n\n\nprint(double(2))\n'}


def table(spark, files):
    rows = [r for rel, text in files.items() for r in facts_of(rel, text)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("ident", sorted(CASES))
def test_rule_fires(spark, ident):
    found = rules.run(table(spark, CASES[ident]), only=[ident]).collect()
    assert found, f"rule {ident} is silent"
    assert all(r.rule == str(ident) and r.rel in CASES[ident] for r in found)


# further arms of the readings: files, and (file, line, start of the cause) of every finding
ARMS = {
    "monkeypatch": (9, {"a.py": "LIMIT = 1\n", "b.py": "import a\n\n\ndef f():\n    a.LIMIT = 2\n"}, [("b.py", 5, "monkeypatch:a.LIMIT")]),
    "import effect": (9, {"a.py": "import os\nos.chdir('/')\n", "b.py": "import a\n"}, [("a.py", 2, "import-time-effect:os.chdir")]),
    "blocks": (
        11,
        {f"{n}.py": f"def {n}(q):\n    {n} = 0\n" + "".join(f"    q.go{k}(q, {k}, q)\n" for k in range(6)) + f"    return {n}\n" * (n == "x") for n in ("x", "y")},
        [("y.py", 2, "clone-block:")],
    ),
    "whole idiom": (12, {"m.py": "def total(values):\n    out = 0\n    for v in values:\n        out += v\n    return out\n"}, [("m.py", 1, "idiom:a sum")]),
    "ambient": (
        14,
        {"m.py": "".join(f"def f{k}(a, b, c):\n    return {k}\n" for k in range(3)) + "".join(f"def g{k}(a):\n    return {k}\n" for k in range(30))},
        [],
    ),
    "parameter": (32, {"m.py": "def f(a, b):\n    a += 1\n    return a\n\n\nf(1, 2)\n"}, [("m.py", 1, "dead-param:b")]),
    "commented code": (34, {"m.py": "# x = f(1)\n# if x:\n#     g(x)\n\n# some words of prose\n# that go on for\n# three lines\n"}, [("m.py", 1, "commented-code")]),
    "hoistable": (
        35,
        {"p/__init__.py": "", "p/a.py": "def f():\n    import p.b\n    return p.b\n", "p/b.py": "x = 1\n", "p/c.py": "import p.d\n", "p/d.py": "def g():\n    import p.c\n    return p.c\n"},
        [("p/a.py", 2, "hoistable-import:p.b"), ("p/a.py", 2, "hoistable-import:p"), ("p/c.py", 1, "hidden-cycle"), ("p/d.py", 2, "hoistable-import:p")],
    ),
    "one value": (37, {"m.py": "def f(a, b):\n    return a + b\n\n\nf(1, 2)\nf(3, 2)\nf(5, b=2)\n"}, [("m.py", 1, "monomorphic:b")]),
    "cold loop": (41, {"m.py": "import re\n\n\ndef f(a):\n    for x in a:\n        re.compile(x)\n"}, []),
    "deep effect": (6, {"m.py": "def get_x():\n    return load()\n\n\ndef load():\n    global cache\n    cache = 1\n    return cache\n"}, [("m.py", 1, "get_x rebinds cache")]),
    "helper": (42, {"tests/test_m.py": "def check(a):\n    assert a\n\n\ndef test_a():\n    check(1)\n"}, []),
    "called": (60, {"m.py": "from n import job\njob()\n", "n.py": "def job():\n    return 2\n"}, []),
}


@pytest.mark.parametrize("name", sorted(ARMS))
def test_arm(spark, name):
    ident, files, want = ARMS[name]
    got = sorted((r.rel, r.line, r.cause) for r in rules.run(table(spark, files), only=[ident]).collect() if not (ident == 32 and r.cause == "dead-symbol"))
    assert len(got) == len(want) and all(g[:2] == w[:2] and g[2].startswith(w[2]) for g, w in zip(got, sorted(want), strict=True)), got


RUST = {
    9: "static N: Cell = Cell::new(0);\n" + "".join(f"fn f{k}() {{ N.store({k}); }}\n" for k in range(3)),
    11: "".join(f"fn f{n}(a: u8, b: u8) -> u8 {{ let mut t = 0; for x in a.all() {{ if x > b {{ t += x * b; }} else {{ t -= x + b * 2; }} }} t }}\n" for n in "xy"),
    18: "fn f() {\n    // Step 1: read\n    a();\n    // Step 2: write\n    b();\n}\n",
    20: "fn f() { a.map(|x| x.one() + x.two() * 3); b.map(|y| y.one() + y.two() * 3); c.map(|z| z.one() + z.two() * 3); }\n",
    21: 'enum E { A, B }\nfn f(e: E) -> u8 { match e { E::A => 1, E::B => unreachable!("no") } }\n',
    23: "fn f(a: u8) {\n" + "".join(f"if a > {k} {{\n" for k in range(6)) + "g();" + "}" * 7 + "\n",
    27: "pub fn f() {}\n" + "// x\n" * 500,
    29: "fn f() {}\n" * 150,
    32: "pub fn lonely() {}\n",
    34: "fn f(e: E) -> E { match e { E::A => E::A, E::B => E::B } }\n// let x = f(1);\n// if x {\n//     g(x);\n// }\n",
    37: "trait T { fn m(&self); }\nstruct S;\nimpl T for S { fn m(&self) {} }\n",
    39: "/// One.\n/// Two.\nfn a() {}\n/// One.\n/// Two.\nfn b() {}\n",
    42: "#[test]\nfn t() { let x = 1; }\n",
    47: "#[cfg(test)]\nmod tests { #[test] fn t() { std::thread::sleep(Duration::from_millis(5)); assert!(true); } }\n",
    48: "fn one(a: u8) -> u8 { a + 1 }\nfn two(b: u8) -> u8 { let c = b; one(c) }\n",
    53: "/// Reads.\n///\n/// # Errors\n/// `E::A` if so.\npub fn f() -> Result<u8, E> { if x { return Err(E::B); } Err(E::A) }\n",
    56: "pub fn helper() -> u8 { 1 }\n#[cfg(test)]\nmod tests { #[test] fn t() { assert_eq!(super::helper(), 1); } }\n",
    59: "fn main() {\n" + "    step();\n" * 30 + '    Command::new("x");\n}\n',
}


@pytest.mark.parametrize("ident", sorted(RUST))
def test_rust_rule_fires(spark, ident):
    rel = {59: "app/src/main.rs"}.get(ident, "app/src/m.rs")
    files = {rel: RUST[ident]}
    if ident == 27:
        files["app/src/n.rs"] = "use crate::m::f;\nfn a() { f(); }\nfn b() { f(); }\nfn c() { f(); }\n"
    facts = spark.createDataFrame([r for k, t in files.items() for r in rust_facts_of(k, t)], SCHEMA)
    assert not facts.where("kind = 'error'").count()
    found = rules.run(facts.limit(0), only=[ident], rust=facts).collect()
    assert found and all(r.lang == "rs" and r.rule == str(ident) and r.rel == rel for r in found), found


def test_clean_rust_file_is_silent(spark):
    text = "//! Doubles.\n\n/// Twice the value.\nfn double(value: u8) -> u8 {\n    value * 2\n}\n\nfn main() {\n    let x = double(2);\n    show(double(x));\n}\n"
    facts = spark.createDataFrame(rust_facts_of("app/src/main.rs", text), SCHEMA)
    assert [(r.rule, r.message) for r in rules.run(facts.limit(0), rust=facts).collect()] == []


def test_rust_facts():
    rows = rust_facts_of("app/src/lib.rs", "use a::{b, c::{self, d as e}, f::*};\nimpl<T> fmt::Display for S<T> { fn m(&self, k: u8) -> bool { r#\"}\"#; '}'; /* /* } */ */ self.k::<u8>(\"{\") } }\n")
    assert {(r[4], r[8]) for r in rows if r[0] == "import"} == {("a::b", "b"), ("a::c", "c"), ("a::c::d", "e"), ("a::f::*", "*")}
    assert [(r[3], r[8]) for r in rows if r[0] == "impl"] == [("app::S", "Display")]
    assert [(r[4], r[8], r[9]) for r in rows if r[0] == "call"] == [(".k", "self", 1)]
    assert [r[0] for r in rust_facts_of("x.rs", "fn f( {")] == ["error"]
    assert [module_of(x) for x in ("my-app/src/lib.rs", "src/a/mod.rs", "src/a/b.rs", "tests/t.rs")] == ["my_app", "crate::a", "crate::a::b", "tests::t"]


def test_clean_file_is_silent(spark):
    found = rules.run(table(spark, CLEAN)).collect()
    assert [(r.rule, r.message) for r in found] == []


def test_syntax_error_is_one_row():
    (row,) = facts_of("bad.py", "def f(:\n")
    assert dict(zip(COLUMNS, row, strict=True))["kind"] == "error"


@pytest.mark.parametrize(("rel", "name"), [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("src/a/b.py", "a.b"), ("__init__.py", "__init__")])
def test_module_name(rel, name):
    assert module_name(rel) == name


def test_complexity_nesting():
    import ast

    def of(source):
        return complexity(ast.parse(source).body[0])

    assert of("def f(a):\n    if a:\n        if a:\n            if a:\n                pass\n") == 6
    assert of("def f(a):\n    if a:\n        pass\n    elif a:\n        pass\n    else:\n        pass\n") == 3
    assert of("def f(a):\n    return a and b and c\n") == 1
