"""Fact extraction from Python source, one file at a time, on the executors.

``extract(files)`` turns (rel, text) rows into one long table of facts; the
named tables below are filters of it.  A file that does not parse gives one
``error`` fact and nothing else.  Columns: kind, module, rel, symbol (qualified
name of the enclosing or described definition), name, line, col (UTF-8 bytes for
syntax, code points for comments), end_line, value, n, items.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import decode_text

COLUMNS = ["kind", "module", "rel", "symbol", "name", "line", "col", "end_line", "value", "n", "items"]
SCHEMA = (
    "kind string, module string, rel string, symbol string, name string, line int, col int, end_line int, value string, n long, items array<string>"
)
# fixed values: folders that are never read
SKIPPED = ("__pycache__", "node_modules", "site-packages", "venv", "target", "build", "dist")

FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPE = (*FUNCTION, ast.ClassDef)
LOOP = (ast.For, ast.AsyncFor, ast.While)


def read_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(rel, text, lossy) of the files below a folder, hidden and skipped ones left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.substring_index("path", base, -1)
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    hidden = F.exists(folders, lambda x: x.startswith(".") | x.isin(*SKIPPED))
    rows = raw.select(rel.alias("rel"), decode_text("content").alias("d")).where(~hidden)
    return rows.select("rel", "d.text", "d.lossy")


def module_name(rel: str) -> str:
    """Dotted name of a file; a package is named by its folder, ``src`` falls away."""
    parts = rel.removesuffix(".py").split("/")
    if parts[0] == "src" and len(parts) > 1:
        parts = parts[1:]
    if parts[-1] == "__init__" and len(parts) > 1:
        parts = parts[:-1]
    return ".".join(parts)


def complexity(node: ast.AST) -> int:
    """Cognitive complexity of a function: branches cost one and their nesting,
    sequences of one boolean operator cost one, jumps to labels do not exist."""

    def cost(n: ast.AST, depth: int) -> int:
        if isinstance(n, (ast.If, *LOOP, ast.IfExp, ast.Match)) or isinstance(n, ast.ExceptHandler):
            own = 1 + depth
            out = own
            if isinstance(n, ast.If):
                out += cost(n.test, depth) + sum(cost(x, depth + 1) for x in n.body)
                rest = n.orelse
                while len(rest) == 1 and isinstance(rest[0], ast.If):
                    out += 1 + cost(rest[0].test, depth) + sum(cost(x, depth + 1) for x in rest[0].body)
                    rest = rest[0].orelse
                if rest:
                    out += 1 + sum(cost(x, depth + 1) for x in rest)
                return out
            return own + sum(cost(x, depth + 1) for x in ast.iter_child_nodes(n))
        if isinstance(n, (*FUNCTION, ast.Lambda)):
            return sum(cost(x, depth + 1) for x in ast.iter_child_nodes(n))
        extra = 1 if isinstance(n, ast.BoolOp) else 0
        return extra + sum(cost(x, depth) for x in ast.iter_child_nodes(n))

    return sum(cost(x, 0) for x in node.body)


def shape(node: ast.AST, names: dict[str, str] | None = None) -> str:
    """A dump in which local names are numbered in order of appearance and
    constants are reduced to their kind."""
    names = {} if names is None else names

    def dump(n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return f"N{names.setdefault(n.id, str(len(names)))}"
        if isinstance(n, ast.arg):
            return f"A{names.setdefault(n.arg, str(len(names)))}"
        if isinstance(n, ast.Constant):
            return f"C:{type(n.value).__name__}"
        parts = []
        for field, value in ast.iter_fields(n):
            if field in ("ctx", "type_comment", "lineno", "name", "annotation", "returns", "decorator_list", "kind"):
                continue
            if isinstance(value, ast.AST):
                parts.append(dump(value))
            elif isinstance(value, list):
                parts.append("[" + ",".join(dump(x) if isinstance(x, ast.AST) else str(x) for x in value) + "]")
            elif value is not None:
                parts.append(str(value))
        return f"{type(n).__name__}({','.join(parts)})"

    return dump(node)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def size(node: ast.AST) -> int:
    return sum(1 for _ in ast.walk(node)) - 1


def _strip_doc(body: list[ast.stmt]) -> list[ast.stmt]:
    first = body[0] if body else None
    return body[1:] if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else body


# fixed values: calls that a loop should not repeat
COSTLY = ("re.compile", "re.match", "re.search", "re.sub", "copy.deepcopy", "open", "subprocess.run", "sorted", "json.loads", "json.dumps", "pd.concat", "np.append")


def costly(node: ast.Call, name: str) -> str:
    """What a call in a loop costs too much, if anything: a listed call, or work at
    the front of a list."""
    first = node.args[0] if node.args else None
    front = isinstance(first, ast.Constant) and first.value == 0 and type(first.value) is int
    if name.endswith((".pop", ".insert")) and front:
        return f"{name.rpartition('.')[2]}(0)"
    return name if name in COSTLY else ""


def outcome(handler: ast.ExceptHandler) -> str:
    """What a handler does in the end."""
    last = handler.body[-1]
    if isinstance(last, ast.Raise):
        same = last.exc is None or isinstance(last.exc, ast.Name) and last.exc.id == handler.name
        return "raises again" if same else "raises another"
    if isinstance(last, ast.Return):
        return "gives a default" if last.value is None or isinstance(last.value, (ast.Constant, ast.List, ast.Dict, ast.Tuple)) else "handles"
    return "goes on" if all(isinstance(x, (ast.Pass, ast.Continue)) for x in handler.body) else "handles"


class _File(ast.NodeVisitor):
    """Walks one module and collects fact rows."""

    def __init__(self, rel: str, text: str):
        self.rel, self.module, self.rows = rel, module_name(rel), []
        self.lines = text.split("\n")
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.scope: list[ast.AST] = []
        self.names: list[str] = []
        self.typed = 0
        self.loops = 0
        self.tree = ast.parse(text)

    def put(self, kind: str, node: ast.AST | None = None, name: str = "", value: str = "", n: int = 0, items: list[str] | None = None, line: int = 0, col: int = 0, symbol: str | None = None) -> None:
        if node is not None:
            line, col = getattr(node, "lineno", line), getattr(node, "col_offset", col)
        end = getattr(node, "end_lineno", line) or line
        self.rows.append((kind, self.module, self.rel, self.qname if symbol is None else symbol, name, line, col, end, value, n, items or []))

    @property
    def qname(self) -> str:
        return ".".join([self.module, *self.names]) if self.names else self.module

    @property
    def in_function(self) -> bool:
        return any(isinstance(x, FUNCTION) for x in self.scope)

    def run(self, text: str) -> list[tuple]:
        doc = ast.get_docstring(self.tree, clean=False)
        self.comments(text)
        lead = any(r[0] == "comment" and r[5] <= 5 and len(r[8]) > 20 and not r[8].startswith("#!") for r in self.rows)
        self.put("module", line=1, value="doc" if doc else "comment" if lead else "", n=len(self.lines))
        for x in self.tree.body:
            if isinstance(x, (ast.Assign, ast.AnnAssign)):
                self.module_value(x)
        self.generic_visit(self.tree)
        return self.rows

    def comments(self, text: str) -> None:
        try:
            for t in tokenize.generate_tokens(io.StringIO(text).readline):
                if t.type == tokenize.COMMENT:
                    whole = not t.line[: t.start[1]].strip()
                    self.put("comment", line=t.start[0], col=t.start[1], value=t.string, n=int(whole), symbol=self.module)
        except (tokenize.TokenError, IndentationError):
            pass

    def module_value(self, x: ast.Assign | ast.AnnAssign) -> None:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target]
        for t in targets:
            if isinstance(t, ast.Name) and x.value is not None:
                self.put("symbol", x, t.id, "variable", symbol=f"{self.module}.{t.id}")
                text = ast.unparse(x.value)
                plain = isinstance(x.value, (ast.Constant, ast.Tuple, ast.List, ast.Set, ast.Dict)) and len(text) > 12
                if plain and not any(isinstance(y, (ast.Call, ast.Name)) for y in ast.walk(x.value)):
                    self.put("literal", x, t.id, text, symbol=f"{self.module}.{t.id}")
                if t.id == "__all__" and not isinstance(x.value, (ast.List, ast.Tuple)):
                    self.put("site", x, "computed-all", symbol=self.module)
                if t.id.isupper() and isinstance(x.value, ast.BinOp) and any(isinstance(y, ast.Call) for y in ast.walk(x.value)):
                    self.put("site", x, "assembled-constant", symbol=f"{self.module}.{t.id}")

    # definitions
    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.names.append(node.name)
        self.put("symbol", node, node.name, "class", items=[ast.unparse(d) for d in node.decorator_list])
        self.put("class", node, node.name, items=[ast.unparse(b) for b in node.bases])
        self.scope.append(node)
        for d in (*node.decorator_list, *node.bases, *node.keywords, *node.body):
            self.visit(d)
        self.scope.pop()
        self.names.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        method = bool(self.scope) and isinstance(self.scope[-1], ast.ClassDef)
        self.names.append(node.name)
        body = _strip_doc(node.body)
        marks = [ast.unparse(d) for d in node.decorator_list]
        self.put("symbol", node, node.name, "method" if method else "function", complexity(node), marks)
        self.put("body", node, node.name, digest(shape(node)), size(node), [ast.unparse(x) for x in body[:1]])
        self.put("docstring", node, node.name, ast.get_docstring(node, clean=False) or "", len(body))
        for k, x in enumerate(node.body):
            self.put("statement", x, value=digest(shape(x)), n=k, items=[str(size(x) + 1), str(len(node.body))])
        self.params(node, method and "staticmethod" not in marks)
        self.scope.append(node)
        for d in (*node.decorator_list, *node.args.defaults, *(x for x in node.args.kw_defaults if x), *node.body):
            self.visit(d)
        if node.returns is not None:
            self.visit(node.returns)
        self.returns(node)
        self.scope.pop()
        self.names.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # type: ignore[assignment]

    def params(self, node, bound: bool) -> None:
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        rows = [(x, "positional", d) for x, d in zip(plain, defaults, strict=True)]
        rows += [(a.vararg, "star", None)] if a.vararg else []
        rows += [(x, "keyword", d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        rows += [(a.kwarg, "double-star", None)] if a.kwarg else []
        for k, (x, kind, d) in enumerate(rows):
            own = bound and k == 0
            self.put("param", x, x.arg, ast.unparse(x.annotation) if x.annotation else "", k, ["self" if own else kind, ast.unparse(d) if d is not None else ""])
            if isinstance(d, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)) or (isinstance(d, ast.Call) and ast.unparse(d.func) in ("list", "dict", "set")):
                self.put("site", d, "mutable-default", x.arg)
            if isinstance(d, ast.Constant) and d.value is None and x.annotation is not None:
                note = ast.unparse(x.annotation)
                if not any(w in note for w in ("None", "Optional", "Any", "object")):
                    self.put("site", x, "lying-default", f"{x.arg}: {note} = None")

    def returns(self, node) -> None:
        kinds: set[str] = set()
        stack = list(node.body)
        gives = False
        while stack:
            x = stack.pop()
            if isinstance(x, (*SCOPE, ast.Lambda)):
                continue
            if isinstance(x, ast.Return):
                v = x.value
                kinds.add("bare" if v is None else "none" if isinstance(v, ast.Constant) and v.value is None else "value")
            gives |= isinstance(x, (ast.Yield, ast.YieldFrom))
            stack += list(ast.iter_child_nodes(x))
        last = node.body[-1]
        if not isinstance(last, (ast.Return, ast.Raise, ast.While, ast.With, ast.Try, ast.If, ast.Match)) and "value" in kinds:
            kinds.add("fall")
        note = ast.unparse(node.returns) if node.returns else ""
        self.put("returns", node, node.name, note, int(gives), sorted(kinds))

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.put("lambda", node, value=digest(shape(node.body, {a.arg: f"p{k}" for k, a in enumerate(node.args.args)})), n=size(node.body) + 1)
        self.generic_visit(node)

    # names and calls
    def visit_Name(self, node: ast.Name) -> None:
        self.put("ref", node, node.id, "store" if isinstance(node.ctx, ast.Store) else "load")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.put("ref", node, node.attr, "attr-store" if isinstance(node.ctx, ast.Store) else "attr", items=[ast.unparse(node.value)[:80]])
        self.generic_visit(node)

    def visit_Global(self, node: ast.Global) -> None:
        for x in node.names:
            self.put("global", node, x)

    def visit_Call(self, node: ast.Call) -> None:
        name = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else ""
        args = [ast.unparse(x) for x in node.args] + [f"{k.arg or '**'}={ast.unparse(k.value)}" for k in node.keywords]
        self.put("call", node, name, str(self.loops), len(node.args), args)
        if name in ("getattr", "setattr", "delattr", "hasattr") and len(node.args) > 1 and not isinstance(node.args[1], ast.Constant):
            self.put("site", node, "dynamic-attribute", name)
        if name in ("importlib.import_module", "__import__") and node.args and not isinstance(node.args[0], ast.Constant):
            self.put("site", node, "dynamic-import", name)
        if name.endswith("sleep") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, (int, float)) and node.args[0].value > 0:
            self.put("site", node, "sleep", name)
        if name.endswith(".get") and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.put("key-read", node, node.args[0].value)
        if self.loops and (what := costly(node, name)):
            self.put("site", node, "costly-in-loop", what, self.loops)
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        it = node.iter
        if isinstance(it, ast.Call) and ast.unparse(it.func) == "range" and len(it.args) == 1 and isinstance(it.args[0], ast.Call) and ast.unparse(it.args[0].func) == "len":
            self.put("site", node, "range-len", ast.unparse(it))
        self.visit(node.target)
        self.visit(it)  # evaluated once
        self.loops += 1
        for x in (*node.body, *node.orelse):
            self.visit(x)
        self.loops -= 1

    visit_AsyncFor = visit_For  # type: ignore[assignment]

    def visit_While(self, node: ast.While) -> None:
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    def visit_ListComp(self, node: ast.ListComp) -> None:
        g = node.generators
        if len(g) == 1 and not g[0].ifs and isinstance(node.elt, ast.Name) and ast.dump(node.elt) == ast.dump(g[0].target).replace("Store", "Load"):
            self.put("site", node, "identity-comprehension")
        self.generic_visit(node)

    def visit_IfExp(self, node: ast.IfExp) -> None:
        if isinstance(node.body, ast.Constant) and isinstance(node.orelse, ast.Constant) and {node.body.value, node.orelse.value} == {True, False}:
            self.put("site", node, "bool-ternary")
        self.generic_visit(node)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if self.loops and isinstance(node.op, ast.Add) and isinstance(node.value, (ast.JoinedStr, ast.Constant)) and isinstance(getattr(node.value, "value", ""), str):
            self.put("site", node, "costly-in-loop", "string +=", self.loops)
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:
        op = node.ops[0]
        if self.loops and isinstance(op, (ast.In, ast.NotIn)) and isinstance(node.comparators[0], ast.List):
            self.put("site", node, "costly-in-loop", "in [...]", self.loops)
        if isinstance(op, (ast.In, ast.NotIn)) and isinstance(node.comparators[0], ast.Call) and ast.unparse(node.comparators[0].func).endswith(".keys"):
            self.put("site", node, "keys-membership")
        if isinstance(op, (ast.Eq, ast.Is)) and isinstance(node.comparators[0], ast.Constant) and isinstance(node.comparators[0].value, str) and isinstance(node.left, (ast.Name, ast.Attribute)):
            self.put("tag", node, ast.unparse(node.left), node.comparators[0].value)
        self.generic_visit(node)

    def visit_Assert(self, node: ast.Assert) -> None:
        t = node.test
        same = isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], (ast.Eq, ast.Is)) and ast.dump(t.left) == ast.dump(t.comparators[0])
        calls = any(isinstance(x, ast.Call) for x in ast.walk(t))
        if (same and not calls) or (isinstance(t, ast.Constant) and t.value):
            self.put("site", node, "tautology", ast.unparse(t))
        self.put("verdict", node, "assert")
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        exc = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        self.put("raise", node, ast.unparse(exc) if exc is not None else "")
        self.generic_visit(node)

    def visit_Try(self, node: ast.Try) -> None:
        for h in node.handlers:
            types = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type] if h.type is not None else []
            self.put("handler", h, value=outcome(h), items=[ast.unparse(t) for t in types] or ["BaseException"])
            if len(h.body) == 1 and isinstance(h.body[0], ast.Raise) and h.body[0].exc is None and len(node.handlers) == 1:
                self.put("site", h, "noop-reraise")
            broad = h.type is None or ast.unparse(h.type) in ("Exception", "BaseException")
            if broad and len(h.body) == 1 and (isinstance(h.body[0], ast.Pass) or (isinstance(h.body[0], ast.Return) and (h.body[0].value is None or isinstance(h.body[0].value, (ast.Constant, ast.List, ast.Dict))))):
                self.put("site", h, "swallowed-exception")
        self.generic_visit(node)

    def visit_With(self, node: ast.With) -> None:
        if any("raises" in ast.unparse(i.context_expr) or "warns" in ast.unparse(i.context_expr) for i in node.items):
            self.put("verdict", node, "raises")
        self.generic_visit(node)

    def visit_Return(self, node: ast.Return) -> None:
        v = node.value
        if isinstance(v, ast.Dict) and v.keys and all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in v.keys):
            self.put("record", node, self.names[-1] if self.names else "", items=sorted(k.value for k in v.keys))
        else:
            self.put("plain-return", node, value=ast.unparse(v)[:80] if v is not None else "")
        self.generic_visit(node)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
            self.put("key-read" if isinstance(node.ctx, ast.Load) else "key-write", node, node.slice.value)
        if isinstance(node.value, ast.Name):
            self.put("use", node, node.value.id, {ast.Load: "getitem", ast.Store: "setitem"}.get(type(node.ctx), "delitem"))
        self.generic_visit(node)

    def visit_If(self, node: ast.If) -> None:
        if isinstance(node.test, ast.Name) and not node.orelse and len(node.body) == 1:
            inner, own = node.body[0], node.test.id
            loops = isinstance(inner, ast.For) and isinstance(inner.iter, ast.Name) and inner.iter.id == own
            call = inner.value if isinstance(inner, ast.Expr) else None
            tolerant = isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and isinstance(call.func.value, ast.Name)
            if loops or (tolerant and call.func.value.id == own and call.func.attr in ("sort", "clear", "reverse", "update")):
                self.put("site", node, "needless-guard", own)
        text = ast.unparse(node.test)
        if "self." in text and size(node.test) + 1 >= 5:
            self.put("decision", node, text)
        guard = ast.unparse(node.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")
        self.typed += guard
        self.generic_visit(node)
        self.typed -= guard

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.put("import", node, a.name, a.asname or a.name.split(".")[0], int(not self.in_function), ["typed"] if self.typed else [])

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            own = self.module.split(".")
            package = own if self.rel.endswith("__init__.py") else own[:-1]
            up = package[: len(package) - (node.level - 1)]
            base = ".".join([*up, *([base] if base else [])])
        for a in node.names:
            if a.name == "*":
                self.put("site", node, "star-import", base)
                self.put("import", node, base, "*", int(not self.in_function), ["typed"] if self.typed else [])
            else:
                self.put("import", node, f"{base}.{a.name}", a.asname or a.name, int(not self.in_function), ["typed"] if self.typed else [])


# fixed values: functions that the standard library has, with what to use instead
IDIOMS = {
    "a sum": ("def f(xs):\n t = 0\n for x in xs:\n  t += x\n return t", "sum"),
    "a sum, spelled out": ("def f(xs):\n t = 0\n for x in xs:\n  t = t + x\n return t", "sum"),
    "a clamp": ("def f(x, lo, hi):\n if x < lo:\n  return lo\n if x > hi:\n  return hi\n return x", "min and max"),
    "a clamp of min and max": ("def f(x, lo, hi):\n return max(lo, min(x, hi))", "a library clamp"),
    "any": ("def f(xs):\n for x in xs:\n  if x:\n   return True\n return False", "any"),
    "all": ("def f(xs):\n for x in xs:\n  if not x:\n   return False\n return True", "all"),
    "a maximum": ("def f(xs):\n m = xs[0]\n for x in xs:\n  if x > m:\n   m = x\n return m", "max"),
    "a minimum": ("def f(xs):\n m = xs[0]\n for x in xs:\n  if x < m:\n   m = x\n return m", "min"),
    "a lower-casing": ("def f(s):\n o = ''\n for c in s:\n  if 'A' <= c <= 'Z':\n   o += chr(ord(c) + 32)\n  else:\n   o += c\n return o", "str.lower"),
    "a binary search": (
        "def f(xs, v):\n lo = 0\n hi = len(xs)\n while lo < hi:\n  mid = (lo + hi) // 2\n  if xs[mid] < v:\n   lo = mid + 1\n  else:\n   hi = mid\n return lo",
        "bisect",
    ),
    "a reversal": ("def f(xs):\n o = []\n for x in xs:\n  o.insert(0, x)\n return o", "reversed"),
    "a count": ("def f(xs):\n d = {}\n for x in xs:\n  if x in d:\n   d[x] += 1\n  else:\n   d[x] = 1\n return d", "collections.Counter"),
}


def idiom_shapes() -> list[tuple[str, str, str]]:
    """(digest of a body's shape, idiom, what to use instead)."""
    return [(digest(shape(ast.parse(code).body[0])), name, instead) for name, (code, instead) in IDIOMS.items()]


@F.pandas_udf(T.BooleanType())
def parses_as_code(block: pd.Series) -> pd.Series:
    """Whether lines are statements, and not words that happen to parse."""

    def one(text: str) -> bool:
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError, RecursionError):
            return False
        plain = (ast.Name, ast.Constant, ast.Tuple, ast.Attribute, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Subscript)
        return any(not (isinstance(x, ast.Expr) and isinstance(x.value, plain)) and not isinstance(x, ast.AnnAssign) for x in body)

    return block.map(lambda x: x is not None and one(x))


def facts_of(rel: str, text: str) -> list[tuple]:
    try:
        return _File(rel, text).run(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        line = getattr(error, "lineno", 0) or 0
        return [("error", module_name(rel), rel, "", type(error).__name__, line, 0, line, str(error), 0, [])]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for rel, text in zip(f["rel"], f["text"], strict=True):
            yield pd.DataFrame(facts_of(rel, text or ""), columns=COLUMNS)


def extract(files: DataFrame) -> DataFrame:
    """The fact table of (rel, text) rows."""
    return files.select("rel", "text").mapInPandas(_batches, SCHEMA)
