"""Literal vectors and small brute-force checks of the generic operators."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.functions.bounds import interval, p_real, posterior, score
from factloom.functions.paths import digest, excluded, is_test_path, owner_list, under
from factloom.operators import findings as fo
from factloom.operators import graph as g
from factloom.operators import lookup as lo
from factloom.operators import measure as mo
from factloom.operators import mining as mi
from factloom.operators.graph_undirected import undirected_components


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_posterior_values(spark):
    n = lambda x: F.lit(x)
    a, _ = posterior(n(66), n(80), 0.7)
    b, _ = posterior(n(44), n(46), 0.95)
    r = one(spark, a.alias("a"), b.alias("b"), score(n(5), n(5), 0.8).alias("c"), score(n(232), n(256), 0.8).alias("d"))
    assert r.a == pytest.approx(0.819047619047619, abs=1e-15) and r.b == pytest.approx(0.956, abs=1e-15)
    assert 0.82 < r.c < 0.83 and 0.88 < r.d < 0.89


def test_interval_is_clamped(spark):
    low, high = interval(F.lit(0), F.lit(0), 0.8)
    r = one(spark, low.alias("low"), high.alias("high"), p_real(F.lit(False), F.lit(1), F.lit(1), F.lit("STRONG")).alias("p"))
    assert 0 <= r.low < r.high <= 1 and r.p == 0


def test_digest_values(spark):
    r = one(spark, digest(F.lit("")).alias("a"), digest(F.lit("a\nb")).alias("b"))
    assert (r.a, r.b) == ("e3b0c44298fc", "7e18f737311b")


@pytest.mark.parametrize(("rel", "pattern", "hit"), [("a/b/c.py", "b", True), ("a/bb/c.py", "b", False), ("a/b/c.py", "a/*.py", True), ("a/b.py", "a", True), ("ab/c.py", "a", False)])
def test_excluded(spark, rel, pattern, hit):
    assert one(spark, excluded(F.lit(rel), [pattern]).alias("x")).x is hit


@pytest.mark.parametrize(("rel", "hit"), [("tests/a.py", True), ("a/test_b.py", True), ("a/b_test.py", True), ("conftest.py", True), ("a/contest.py", False), ("tests.py", False)])
def test_test_paths(spark, rel, hit):
    assert one(spark, is_test_path(F.lit(rel)).alias("x")).x is hit


def test_under_and_owner_list(spark):
    names = F.array(*map(F.lit, "abcd"))
    r = one(spark, under(F.lit("a/b"), ["a/"]).alias("u"), under(F.lit("ab"), ["a"]).alias("v"), owner_list(names).alias("o"), owner_list(F.slice(names, 1, 3)).alias("p"))
    assert (r.u, r.v, r.o, r.p) == (True, False, "a, b, c +1 more", "a, b, c")


@pytest.mark.parametrize(
    ("doc", "names"),
    [
        ("X.\n\nRaises:\n    KeyError: no.\n    a.ValueError: no.\n      More of it: yes.\n\nReturns:\n    int: b\n", ["KeyError", "ValueError"]),
        ("X.\n\nRaises\n------\nKeyError\n    If so.\nOSError\n\nReturns\n-------\nint\n", ["KeyError", "OSError"]),
        ("X.\n\n:raises KeyError: no\n:raise A, b.B: c\n", ["A", "B", "KeyError"]),
        ("X.\n\nRaises:\n    when x is bad: no\n    KeyError: no\n", ["KeyError"]),
        ("X.\n\nRaises:\nKeyError: no\n", []),
        ("nothing", []),
        (None, []),
    ],
)
def test_declared_raises(doc, names):
    assert tx.declared_raises(doc) == names


def test_text_helpers(spark):
    assert tx.apply_edits("abcdef", [(0, 1, "X"), (3, 5, "")]) == "Xbcf"
    assert tx.lcs_ratio("abc", "abd") == pytest.approx(2 / 3)
    rows = spark.createDataFrame([(bytearray(b"a\r\nb\xff"),), (None,)], "raw binary").select(tx.decode_text("raw").alias("d")).select("d.*").collect()
    assert [tuple(r) for r in rows] == [("a\nb�", True), (None, None)]


def test_blank_word_and_shape(spark):
    data = [("f(f, ff)", "f"), ("xf f_ é.f", "f"), ("fé f", "f"), ("a.b+ab", "a.b"), ("none", ""), ("$1 f", "f")]
    got = [r[0] for r in spark.createDataFrame(data, "line string, name string").select(tx.blank_word(F.col("line"), F.col("name"))).collect()]
    assert got == ["$($, f$)", "xf f_ é.$", "fé $", "$+ab", "none", "$1 $"]
    two = spark.createDataFrame([("def f(x):\n    return f\n", "f"), ("  def gg(x):\n\n\treturn gg", "gg")], "body string, name string")
    one, other = (r[0] for r in two.select(tx.body_shape(F.col("body"), F.col("name"))).collect())
    assert one == other == hashlib.sha256(b"def $(x):\nreturn $").hexdigest()[:16]


def repeats(spark, words, nodes=4, whole=True, prod=True, floor=20):
    rows = [(s, p, v, nodes, prod, whole) for s, w in enumerate(words) for p, v in enumerate(w)]
    df = spark.createDataFrame(rows, "seq long, pos long, v string, nodes int, prod boolean, body boolean")
    out = {}
    for r in mi.maximal_repeats(df, "seq", "pos", "v", "prod", 5, "nodes", floor, "body").collect():
        out.setdefault((r.key, r.length), []).append((r.seq, r.start))
    return {k: sorted(v) for k, v in out.items()}


def test_repeats_overlap(spark):
    assert repeats(spark, ["1212121", "9121219"]) == {("02160b4177f6", 5): [(0, 0), (1, 1)]}


def test_repeats_need_nodes_production_and_more_than_whole_bodies(spark):
    assert repeats(spark, ["abcde", "abcde"], nodes=3) == {}
    assert repeats(spark, ["abcdef", "abcdef"]) == {}
    assert repeats(spark, ["abcdef", "abcdef"], whole=False, prod=False) == {}
    assert [n for _, n in repeats(spark, ["abcdef", "abcdef"], whole=False)] == [6]


def brute_repeats(words, size=5):
    """Repeats that no letter extends at all places, without overlaps; those inside
    others left out."""
    places = {}
    for s, w in enumerate(words):
        for p in range(len(w)):
            for n in range(size, len(w) - p + 1):
                places.setdefault(w[p : p + n], []).append((s, p))
    found = {}
    for x, at in places.items():
        near = [{(words[s][k] if 0 <= k < len(words[s]) else (s, k)) for s, p in at for k in [p + d]} for d in (-1, len(x))]
        if len(at) < 2 or min(len(n) for n in near) < 2:
            continue
        kept = []
        for s, p in sorted(at):
            if not kept or kept[-1][0] != s or kept[-1][1] + len(x) <= p:
                kept.append((s, p))
        if len(kept) > 1:
            found[x] = kept
    inside = lambda s, p, n: any(s == s2 and p2 <= p and p + n <= p2 + len(y) for y, at in found.items() if len(y) > n for s2, p2 in at)
    return {x: at for x, at in found.items() if not all(inside(s, p, len(x)) for s, p in at)}


def test_repeats_against_brute_force(spark):
    rng = random.Random(4)
    for _ in range(4):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 30))) for _ in range(6)]
        want = brute_repeats(words)
        got = repeats(spark, words, whole=False, floor=0)
        assert {(len(x), tuple(at)) for x, at in want.items()} == {(n, tuple(at)) for (_, n), at in got.items()}


def edge_table(spark, pairs, extra=""):
    return spark.createDataFrame(pairs, "src string, dst string" + extra)


def test_components_value(spark):
    e = edge_table(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")])
    got = {r.node: r.scc for r in g.components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def reach_of(pairs):
    nodes = {x for p in pairs for x in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            out[n] |= {y for x in out[n] for y in out[x]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(14)}
    want = reach_of(pairs)
    e = edge_table(spark, sorted(pairs))
    assert {(r.src, r.dst) for r in g.reach(e).collect()} == {(a, b) for a in want for b in want[a]}
    scc = {r.node: r.scc for r in g.components(e).collect()}
    assert scc == {n: min([n] + [m for m in want[n] if n in want[m]]) for n in want}


def test_hot_amplification_enters_a_cycle_once(spark):
    e = spark.createDataFrame([("r", "a", 1), ("a", "b", 2), ("b", "a", 3), ("b", "c", 1)], "src string, dst string, depth long")
    roots = spark.createDataFrame([("r",)], "node string")
    got = {r.node: r.amp for r in g.hot_amplification(e, roots).collect()}
    # entry 1: b becomes 1 + 2, a becomes 1 + 3, and c gets b's raised value
    assert got == {"r": 0, "a": 4, "b": 3, "c": 4}


def test_effect_fold_taints(spark):
    e = spark.createDataFrame([("a", "b", False), ("c", "b", True), ("a", "d", False), ("d", "a", False)], "src string, dst string, taint boolean")
    own = spark.createDataFrame([("b", ["io"], False), ("d", ["gw:x"], False)], "node string, atoms array<string>, unknown boolean")
    got = {r.node: (r.atoms, r.unknown) for r in g.effect_fold(e, own).collect()}
    assert got["a"] == got["d"] == (["gw:x", "io"], False) and got["b"] == (["io"], False) and got["c"] == ([], True)


def test_undirected_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)] + [(k, k + 1) for k in range(20, 60)], "src long, dst long")
    got = {r.node: r.root for r in undirected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9} | dict.fromkeys(range(20, 61), 20)


def test_suppress_covers_definitions(spark):
    found = spark.createDataFrame(
        [(1, "a.py", 5, "3", "m.C.f"), (2, "a.py", 9, "3", "m.D"), (3, "a.py", 20, "4", "m.C"), (4, "b.py", 1, "3", "x")], "ord long, rel string, line int, rule string, symbol string"
    )
    lines = spark.createDataFrame([("a.py", 2, "class C:  # lint allow: 3"), ("a.py", 8, "  # lint allow: 3, 7"), ("b.py", 9, "# lint allow-file: 3")], "rel string, line int, text string")
    marks = fo.marker_table(lines, "lint", "#")
    symbols = spark.createDataFrame([("a.py", 2, "m.C")], "rel string, line int, qname string")
    out = {r.ord: r.suppressed for r in fo.suppress(found, marks, symbols).collect()}
    assert out == {1: True, 2: True, 3: False, 4: True}


def test_budget_lists_all_lines(spark):
    rows = spark.createDataFrame([("k", 3), ("k", 1), ("k", 2), ("j", 7)], "key string, line int")
    base = spark.createDataFrame([("k", 2)], "key string, count long")
    out = {(r.key, r.line): (r.budget, r.lines) for r in fo.budgeted_diff(rows, base, ["key"], [F.asc("line")], "line").collect()}
    assert out == {("k", 3): (2, [1, 2, 3]), ("j", 7): (0, [7])}


def test_compose_drops_strict_subsets(spark):
    rows = [("a", "f", 1, True), ("a", "f", 2, True), ("b", "f", 1, True), ("c", "f", 2, False), ("d", "f", 9, False)]
    out = fo.compose_fixes(spark.createDataFrame(rows, "fix string, rel string, line int, deletes boolean"))
    assert {r.fix for r in out.collect()} == {"a", "d"}


def test_longest_prefix(spark):
    t = spark.createDataFrame([("os", "io"), ("os.path", "pure"), ("re", "cpu")], "key string, cls string")
    names = spark.createDataFrame([("os.path.join",), ("os.remove",), ("osx",), ("re",)], "name string")
    got = {r["name"]: r.cls for r in lo.longest_prefix(names, "name", t, "key", "cls").collect()}
    assert got == {"os.path.join": "pure", "os.remove": "io", "osx": None, "re": "cpu"}


def test_unique_or_null_and_resolve(spark):
    defs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "w")], "rel string, line int, q string")
    t = lambda *p: [{"rel": a, "line": b} for a, b in p]
    sites = spark.createDataFrame([(1, t(("a", 1))), (2, t(("a", 1), ("a", 2))), (3, t(("b", 1))), (4, t(("a", 1), ("b", 1)))], "site int, targets array<struct<rel:string,line:int>>")
    got = {r.site: (r.resolution, r.answers) for r in lo.resolve_all(sites, "site", "targets", defs, ["rel", "line"], "q").collect()}
    assert got == {1: ("resolved", ["x"]), 2: ("ambiguous", ["x", "y"]), 3: ("unresolved", None), 4: ("unresolved", None)}


def test_sample_follows_one_generator(spark):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", k) for k in range(100)] + [("c", k) for k in range(50)], "s string, k int")
    got = mo.stratified_sample(rows, "s", [F.asc("k")], 20, 7).collect()
    rng = random.Random(7)
    want = [("a", k) for k in range(5)] + [("b", k) for k in rng.sample(range(100), 20)] + [("c", k) for k in rng.sample(range(50), 20)]
    assert sorted((r.s, r.k) for r in got) == sorted(want)


def test_judged_and_grown(spark):
    rows = spark.createDataFrame([("a", 9, 10), ("b", 1, 10), ("c", 1, 2)], "k string, tp int, n int")
    assert {r.k: r.verdict for r in mo.judged(rows, 0.8, 5).collect()} == {"a": "PASS", "b": "FAIL", "c": "THIN"}
    assert math.isclose(0.1 + 0.2, 0.3)


def test_combination_groups(spark):
    rows = spark.createDataFrame([(o, x) for o in (1, 2, 3) for x in "abcd"] + [(4, "a"), (4, "b"), (4, "c")], "o int, x string")
    got = {tuple(r.owners): r["items"] for r in mi.combination_groups(rows, "o", "x", 3, 3).collect()}
    assert got == {(1, 2, 3, 4): ["a", "b", "c"], (1, 2, 3): ["a", "b", "c", "d"]}
    best = {tuple(r.owners) for r in mi.best_per_anchor(mi.combination_groups(rows, "o", "x", 3, 3)).collect()}
    assert best == {(1, 2, 3, 4)}


def test_entry_has_no_training_import():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "factloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in {x for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for x in ast.unparse(n).replace(".", " ").split()}


def test_group_testing_vetoes_what_breaks():
    from factloom.operators.verdicts import group_testing

    bad, quiet = {3, 11}, {7}
    runs = []

    def check(group):
        ids = {p[0] for p in group}
        runs.append(len(ids))
        if ids & bad:
            return ids & bad  # the break names its cause
        return set() if ids & quiet else None  # this one breaks something, but nothing points at it

    kept, vetoed = group_testing([(k, f"f{k}") for k in range(16)], check)
    assert sorted(vetoed) == [3, 7, 11] and sorted(kept) == [k for k in range(16) if k not in (3, 7, 11)]
    assert max(runs) == 16 and len(runs) < 14
