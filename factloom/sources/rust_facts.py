"""Fact extraction from Rust source, one file at a time, on the executors.

A lexer and a walk over bracket groups find items, statements, closures, matches
and calls; types are not inferred.  The table has the columns of the Python facts.
Names are joined by ``::``; what stands in test code (a ``cfg(test)`` item, a
``#[test]`` function) has a module that ends in ``::tests``."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .python_facts import COLUMNS, SCHEMA

# fixed values: the tokens of the language, in order of trial
TOKEN = re.compile(
    r"""(?P<doc>//[/!][^\n]*|/\*[*!](?:[^*]|\*(?!/))*\*/)|(?P<comment>//[^\n]*)|(?P<block>/\*)
      |(?P<string>b?r(?P<hash>\#*)"(?s:.*?)"(?P=hash)|b?"(?:\\(?s:.)|[^"\\])*")|(?P<char>b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')
      |(?P<life>'[A-Za-z_]\w*)|(?P<number>\d[\w.]*(?<!\.))|(?P<ident>(?:r\#)?[^\W\d]\w*)
      |(?P<punct>::|->|=>|\.\.=|\.\.\.|\.\.|&&|\|\||<<=|>>=|[-+*/%^&|=!<>]=|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])""",
    re.X,
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
KEYWORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct"
    " super trait true type union unsafe use where while".split()
)
ITEMS = {"fn", "struct", "enum", "trait", "impl", "mod", "static", "const", "type", "use", "union"}
CELL_WRITES = ("lock", "write", "store", "set", "swap", "fetch_add", "fetch_sub", "get_or_init", "borrow_mut", "compare_exchange", "replace", "with_borrow_mut")
PANICS = ("panic", "unreachable", "todo", "unimplemented")


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int


def lex(text: str) -> tuple[list[Token], list[Token]]:
    """Code tokens, and comments."""
    code, notes, at, line, start = [], [], 0, 1, 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            if text[at] == "\n":
                line, start = line + 1, at + 1
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        kind = "string" if kind == "hash" else kind
        if kind == "block":  # nested block comments
            depth, end = 1, at + 2
            while depth and end < len(text):
                two = text[end : end + 2]
                depth += (two == "/*") - (two == "*/")
                end += 2 if two in ("/*", "*/") else 1
            kind = "comment"
        piece = text[at:end]
        (notes if kind in ("comment", "doc") else code).append(Token(kind, piece, line, at - start))
        if n := piece.count("\n"):
            line, start = line + n, at + piece.rindex("\n") + 1
        at = end
    return code, notes


def shape(tokens: list[Token], fixed: frozenset[str] = frozenset()) -> str:
    """Tokens with local names numbered in order of appearance and literals reduced
    to their kind; called, typed and qualified names stay."""
    names: dict[str, str] = {}
    out = []
    for k, t in enumerate(tokens):
        before, after = tokens[k - 1].text if k else "", tokens[k + 1].text if k + 1 < len(tokens) else ""
        if t.kind in ("string", "char", "number"):
            out.append(t.kind)
        elif t.kind == "ident" and t.text not in KEYWORDS and t.text not in fixed and before not in (".", "::") and after not in ("(", "::", "!") and not t.text[0].isupper():
            out.append(names.setdefault(t.text, f"n{len(names)}"))
        else:
            out.append(t.text)
    return " ".join(out)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def module_name(rel: str) -> str:
    """Path of a file's module: folders below ``src``, and the file."""
    parts = rel.removesuffix(".rs").split("/")
    if "src" in parts:
        k = parts.index("src")
        parts = [parts[k - 1].replace("-", "_") if k else "crate", *parts[k + 1 :]]
    if len(parts) > 1 and parts[-1] in ("mod", "lib", "main"):
        parts = parts[:-1]
    return "::".join(parts)


class _File:
    def __init__(self, rel: str, text: str):
        self.rel, self.rows = rel, []
        self.code, self.notes = lex(text)
        self.lines = text.split("\n")
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.code):
            if t.text in OPEN and t.kind == "punct":
                stack.append(k)
            elif t.text in CLOSE and t.kind == "punct":
                if not stack or OPEN[self.code[stack[-1]].text] != t.text:
                    raise ValueError(f"line {t.line}: {t.text} closes nothing")
                self.pair[stack.pop()] = k
        if stack:
            raise ValueError(f"line {self.code[stack[-1]].line}: {self.code[stack[-1]].text} is not closed")
        self.module = module_name(rel)
        self.test = False

    def put(self, kind: str, symbol: str, name: str = "", value: str = "", n: int = 0, items: list[str] | None = None, at: Token | None = None, end: int = 0) -> None:
        line, col = (at.line, at.col) if at else (1, 0)
        module = self.module + ("::tests" if self.test and not self.module.endswith("::tests") else "")
        self.rows.append((kind, module, self.rel, symbol, name, line, col, end or line, value, n, items or []))

    def run(self) -> list[tuple]:
        header = any(t.text.startswith("//!") or t.text.startswith("/*!") for t in self.notes)
        self.put("module", self.module, value="doc" if header else "", n=len(self.lines))
        for t in self.notes:
            whole = not self.lines[t.line - 1][: t.col].strip()
            self.put("comment", self.module, value=t.text, n=int(whole and t.kind == "comment"), at=t)
        self.block(0, len(self.code), self.module, "")
        return self.rows

    # items
    def block(self, lo: int, hi: int, scope: str, owner: str) -> None:
        """The items between two tokens; owner is the type or trait around them."""
        k, marks, public = lo, [], ""
        while k < hi:
            t = self.code[k]
            if t.text == "#" and k + 1 < hi and self.code[k + 1].text in ("[", "!"):
                at = k + 1 + (self.code[k + 1].text == "!")
                stop = self.pair.get(at, hi)
                marks.append(" ".join(x.text for x in self.code[at + 1 : stop]))
                k = stop + 1
            elif t.text == "pub":
                public = "pub"
                k += 1
                if k < hi and self.code[k].text == "(":
                    public, k = "pub(in)", self.pair[k] + 1
            elif t.text in ITEMS and k + 1 < hi and (self.code[k + 1].kind == "ident" or t.text in ("impl", "use")):
                if t.text == "const" and self.code[k + 1].text in ("fn", "unsafe", "async", "extern"):
                    k += 1
                    continue
                k = self.item(t.text, k, hi, scope, owner, marks, public)
                marks, public = [], ""
            elif t.text in OPEN:
                k = self.pair[k] + 1
            else:
                if t.text == ";":
                    marks, public = [], ""
                k += 1

    def item(self, what: str, k: int, hi: int, scope: str, owner: str, marks: list[str], public: str) -> int:
        body, end = self.body_of(k, hi)
        first, last = self.code[k], self.code[min(end, len(self.code) - 1)]
        tested = any(m in ("test", "cfg ( test )") or m.endswith(":: test") or m.startswith(("tokio :: test", "rstest")) for m in marks)
        was, self.test = self.test, self.test or tested
        notes = [public] if public else []
        if what == "use":
            self.uses(k + 1, end, "", scope)
        elif what == "impl":
            self.impl(k, body, end, scope)
        else:
            name = self.code[k + 1].text
            name = self.code[k + 2].text if name == "mut" else name
            symbol = f"{scope}::{name}"
            kind = "method" if what == "fn" and owner else {"fn": "function"}.get(what, what)
            if what == "fn":
                self.function(k, body, end, symbol, name, kind, owner, marks, notes)
            else:
                self.put("symbol", symbol, name, kind, items=[*marks, *notes], at=first, end=last.line)
                if what == "mod" and body is not None:
                    self.block(body + 1, self.pair[body], symbol, "")
                elif what == "trait":
                    self.put("trait", symbol, name, public, at=first)
                    if body is not None:
                        self.block(body + 1, self.pair[body], symbol, name)
                elif what == "enum" and body is not None:
                    self.put("enum", symbol, name, items=self.variants(body), at=first)
        self.document(first.line, f"{scope}::{self.code[k + 1].text}", self.code[k + 1].text, len(marks))
        self.test = was
        return end + 1

    def body_of(self, k: int, hi: int) -> tuple[int | None, int]:
        """The opening brace of an item's body, if it has one, and its last token."""
        at = k + 1
        while at < hi:
            x = self.code[at].text
            if x == "{":
                return at, self.pair[at]
            if x == ";":
                return None, at
            at = self.pair[at] + 1 if x in OPEN else at + 1
        return None, hi - 1

    def variants(self, body: int) -> list[str]:
        out, k, fresh = [], body + 1, True
        while k < self.pair[body]:
            t = self.code[k]
            if t.text == "#" and self.code[k + 1].text == "[":
                k = self.pair[k + 1]
            elif t.text in OPEN:
                k = self.pair[k]
            elif t.text == ",":
                fresh = True
            elif fresh and t.kind == "ident":
                out.append(t.text)
                fresh = False
            k += 1
        return out

    def uses(self, lo: int, hi: int, prefix: str, scope: str) -> None:
        """Paths of a ``use``, groups taken apart."""
        path, k, alias = prefix, lo, ""
        while k <= hi:
            t = self.code[k] if k < hi else Token("punct", ",", 0, 0)
            if t.text == "{":
                part = j = k + 1
                while j <= self.pair[k]:
                    if self.code[j].text == "," or j == self.pair[k]:
                        if j > part:
                            self.uses(part, j, path, scope)
                        part = j + 1
                    j = self.pair.get(j, j) + 1
                return
            if t.text == "as" and k + 1 < hi:
                alias, k = self.code[k + 1].text, k + 1
            elif t.text in (",", ";"):
                break
            elif t.text == "::":
                path += "::" if path else ""
            elif t.kind == "ident" or t.text == "*":
                path += t.text
            k += 1
        path = path.replace("crate::", f"{self.module.split('::')[0]}::", 1) if path.startswith("crate::") else path
        path = path.replace("self::", f"{self.module}::", 1) if path.startswith("self::") else path
        path = path.replace("super::", f"{self.module.rpartition('::')[0]}::", 1) if path.startswith("super::") else path
        path = path.removesuffix("::self")
        if path:
            self.put("import", scope, path, alias or path.rpartition("::")[2], 1, at=self.code[lo])

    def impl(self, k: int, body: int | None, end: int, scope: str) -> None:
        stop = body if body is not None else end
        head, at, depth = [], k + 1, 0
        while at < stop:
            x = self.code[at].text
            if x == "where":
                break
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(x, 0)
            if depth <= 0 and x not in (">", ">>"):
                head.append(x)
            at += 1
        cut = head.index("for") if "for" in head else -1
        trait = "".join(head[:cut]) if cut >= 0 else ""
        kind = next((x for x in reversed(head[cut + 1 :]) if x[:1].isalpha()), "")
        self.put("impl", f"{scope}::{kind}", kind, trait.rpartition("::")[2], at=self.code[k], end=self.code[min(end, len(self.code) - 1)].line)
        if body is not None:
            self.block(body + 1, self.pair[body], f"{scope}::{kind}", kind if not trait else f"{kind} as {trait}")

    # functions
    def function(self, k: int, body: int | None, end: int, symbol: str, name: str, kind: str, owner: str, marks: list[str], notes: list[str]) -> None:
        first, last = self.code[k], self.code[min(end, len(self.code) - 1)]
        inner = self.code[body + 1 : self.pair[body]] if body is not None else []
        carried = ["impl"] if " as " in owner else []
        self.put("symbol", symbol, name, kind, self.complexity(inner), [*marks, *notes, *carried], at=first, end=last.line)
        opening = next((j for j in range(k + 2, end) if self.code[j].text == "("), None)
        if opening is not None:
            self.signature(k, opening, symbol, body if body is not None else end)
        if body is None:
            return
        self.put("body", symbol, name, digest(shape(self.code[(opening or k) : self.pair[body]])), len(inner), at=first)
        parts = self.statements(body)
        for n, (a, b) in enumerate(parts):
            piece = self.code[a:b]
            self.put("statement", symbol, value=digest(shape(piece)), n=n, items=[str(len(piece)), str(len(parts))], at=self.code[a])
        self.expressions(body + 1, self.pair[body], symbol, {"should_panic"} & {m.split(" ")[0] for m in marks})
        # functions inside a body are items of it
        self.block(body + 1, self.pair[body], symbol, "")

    def signature(self, k: int, opening: int, symbol: str, stop: int) -> None:
        depth, fresh = 0, False
        for t in self.code[k + 2 : opening]:
            depth += (t.text == "<") - (t.text == ">")
            if t.text in ("<", ",") and depth == 1:
                fresh = True
            elif fresh and t.kind == "ident" and t.text != "const":
                self.put("generic", symbol, t.text, at=t)
                fresh = False
            elif t.kind != "life":
                fresh = False
        n, j = 0, opening + 1
        start = j
        while j <= self.pair[opening]:
            x = self.code[j].text
            if x in OPEN:
                j = self.pair[j]
            elif x == "," or j == self.pair[opening]:
                part = self.code[start:j]
                if part:
                    own = any(t.text == "self" for t in part[:3])
                    label = next((t.text for t in part if t.kind == "ident" and t.text not in ("mut", "ref")), "")
                    cut = next((i for i, t in enumerate(part) if t.text == ":"), len(part))
                    self.put("param", symbol, label, " ".join(t.text for t in part[cut + 1 :]), n, ["self" if own else "positional", ""], at=part[0])
                    n += 1
                start = j + 1
            j += 1
        back = [t.text for t in self.code[self.pair[opening] + 1 : stop]]
        self.put("returns", symbol, symbol.rpartition("::")[2], " ".join(back[1:]) if back[:1] == ["->"] else "", at=self.code[k])

    def statements(self, body: int) -> list[tuple[int, int]]:
        """Statements of a block: up to a semicolon, or a block that stands alone."""
        out, start, k, stop = [], body + 1, body + 1, self.pair[body]
        while k < stop:
            x = self.code[k].text
            if x in OPEN:
                k = self.pair[k]
                after = self.code[k + 1].text if k + 1 < stop else ""
                if x == "{" and self.code[start].text in ("if", "for", "while", "loop", "match", "unsafe", "{") and after not in ("else", ".", "?"):
                    out.append((start, k + 1))
                    start = k + 1
            elif x == ";":
                if k > start:
                    out.append((start, k))
                start = k + 1
            k += 1
        if start < stop:
            out.append((start, stop))
        return out

    def complexity(self, tokens: list[Token]) -> int:
        """Cognitive complexity: branches cost one and their nesting, ``else`` and runs
        of one logical operator cost one."""
        cost, depth, opened, pending, last = 0, 0, [], False, ""
        for k, t in enumerate(tokens):
            x, before = t.text, tokens[k - 1].text if k else ""
            if x in ("if", "match", "while", "for", "loop") and t.kind == "ident" and not (x == "for" and before in ("impl", ">")):
                cost += 1 if x == "if" and before == "else" else 1 + depth
                pending = True
            elif x == "else" and not (k + 1 < len(tokens) and tokens[k + 1].text == "if"):
                cost, pending = cost + 1, True
            elif x in ("&&", "||") and before not in ("(", ",", "=", "move", "{", ";", "|"):
                cost, last = cost + (x != last), x
            elif x == "{":
                opened.append(pending)
                depth, pending = depth + pending, False
            elif x == "}" and opened:
                depth -= opened.pop()
            if x in (";", "{", "}"):
                last = ""
        return cost

    def expressions(self, lo: int, hi: int, symbol: str, verdict: set[str]) -> None:
        if verdict:
            self.put("verdict", symbol, "should_panic", at=self.code[lo - 1])
        k = lo
        while k < hi:
            t = self.code[k]
            after = self.code[k + 1].text if k + 1 < hi else ""
            before = self.code[k - 1].text
            if t.kind == "ident" and t.text not in KEYWORDS:
                self.put("ref", symbol, t.text, "attr" if before == "." else "load", at=t)
                if after == "!" and k + 2 < hi and self.code[k + 2].text in OPEN:
                    self.macro(k, symbol)
                elif after == "(" or after == "::" and self.turbofish(k + 1, hi):
                    self.call(k, hi, symbol)
                if t.text.isupper():
                    self.cell(k, hi, symbol)
            elif t.text == "match" and t.kind == "ident":
                self.match(k, hi, symbol)
            elif t.text in ("|", "||") and before in ("(", ",", "=", "move", "=>", "{", ";", "return"):
                self.closure(k, hi, symbol)
            k += 1

    def turbofish(self, k: int, hi: int) -> int:
        """The opening parenthesis behind ``::<...>``, or 0."""
        if not (k + 1 < hi and self.code[k + 1].text == "<"):
            return 0
        depth = 0
        for j in range(k + 1, min(hi, k + 80)):
            depth += {"<": 1, "<<": 2, ">": -1, ">>": -2}.get(self.code[j].text, 0)
            if depth <= 0:
                return j + 1 if j + 1 < hi and self.code[j + 1].text == "(" else 0
        return 0

    def call(self, k: int, hi: int, symbol: str) -> None:
        opening = k + 1 if self.code[k + 1].text == "(" else self.turbofish(k + 1, hi)
        path, j = [self.code[k].text], k
        while self.code[j - 1].text == "::" and self.code[j - 2].kind == "ident":
            path.insert(0, self.code[j - 2].text)
            j -= 2
        method = self.code[j - 1].text == "."
        name = "." + path[0] if method else "::".join(path)
        receiver = self.code[j - 2].text if method and self.code[j - 2].kind == "ident" else ""
        close = self.pair[opening]
        args = self.arguments(opening)
        self.put("call", symbol, name, receiver, len(args), args, at=self.code[j])
        spelled = [t.text for t in self.code[k + 3 : opening - 1]] if opening > k + 1 else []
        if spelled:
            self.put("spelled", symbol, name, " ".join(spelled), at=self.code[j])
        if path[-1] == "sleep" and any(t.kind == "number" and t.text.strip("0_.") for t in self.code[opening:close]):
            self.put("site", symbol, "sleep", "::".join(path), at=self.code[j])
        if path == ["Err"] and opening + 1 < close and self.code[opening + 1].kind == "ident":
            told = [self.code[opening + 1].text]
            if self.code[opening + 2].text == "::" and self.code[opening + 3].kind == "ident":
                told.append(self.code[opening + 3].text)
            if told[0][0].isupper():
                self.put("raise", symbol, "::".join(told), at=self.code[j])
        if path[-1] in ("unwrap", "expect", "unwrap_err", "expect_err"):
            self.put("verdict", symbol, path[-1], at=self.code[j])

    def arguments(self, opening: int) -> list[str]:
        out, start, j = [], opening + 1, opening + 1
        while j <= self.pair[opening]:
            if self.code[j].text in OPEN and j < self.pair[opening]:
                j = self.pair[j]
            elif self.code[j].text == "," or j == self.pair[opening]:
                if j > start:
                    out.append(" ".join(t.text for t in self.code[start:j]))
                start = j + 1
            j += 1
        return out

    def macro(self, k: int, symbol: str) -> None:
        name = self.code[k].text
        self.put("macro", symbol, name, at=self.code[k])
        if name.startswith(("assert", "debug_assert")) or name in PANICS:
            self.put("verdict", symbol, name, at=self.code[k])

    def cell(self, k: int, hi: int, symbol: str) -> None:
        """A write to an upper-case name: an assignment, or a cell's writing method."""
        a, b, c = (self.code[j].text if j < hi else "" for j in (k + 1, k + 2, k + 3))
        if a == "=" or a == "." and b in CELL_WRITES and c == "(":
            self.put("global", symbol, self.code[k].text, at=self.code[k])

    def match(self, k: int, hi: int, symbol: str) -> None:
        body = next((j for j in range(k + 1, hi) if self.code[j].text == "{"), None)
        if body is None:
            return
        arms, start, j = [], body + 1, body + 1
        while j < self.pair[body]:
            x = self.code[j].text
            if x == "=>":
                right = j + 1
                stop = right
                while stop < self.pair[body] and self.code[stop].text != ",":
                    stop = self.pair[stop] + 1 if self.code[stop].text in OPEN else stop + 1
                    if self.code[right].text == "{":
                        break
                arms.append(([t.text for t in self.code[start:j]], self.code[right:stop]))
                j = stop + (stop < self.pair[body] and self.code[stop].text == ",")
                start = j
            else:
                j = self.pair[j] + 1 if x in OPEN else j + 1
        if arms and all(" ".join(p) == " ".join(t.text for t in r) for p, r in arms):
            self.put("site", symbol, "noop-match", " ".join(t.text for t in self.code[k + 1 : body]), len(arms), at=self.code[k], end=self.code[self.pair[body]].line)
        for left, right in arms:
            if right[:1] and right[0].text in PANICS and len(right) > 1 and right[1].text == "!" and "::" in left:
                cut = left.index("::")
                self.put("panic-arm", symbol, left[cut - 1], left[cut + 1] if cut + 1 < len(left) else "", at=right[0])

    def closure(self, k: int, hi: int, symbol: str) -> None:
        stop = k if self.code[k].text == "||" else next((j for j in range(k + 1, min(hi, k + 60)) if self.code[j].text == "|"), None)
        if stop is None:
            return
        end = stop + 1
        if end < hi and self.code[end].text == "{":
            end = self.pair[end] + 1
        else:
            while end < hi and self.code[end].text not in (",", ";", ")", "]", "}"):
                end = self.pair[end] + 1 if self.code[end].text in OPEN else end + 1
        inner = self.code[stop + 1 : end]
        names = [t.text for t in self.code[k + 1 : stop] if t.kind == "ident"]
        forward = len(inner) >= 3 and inner[-1].text == ")" and [t.text for t in inner if t.text in names] == names and len(inner) <= 3 + 2 * len(names)
        if inner and not forward:
            self.put("lambda", symbol, value=digest(shape(self.code[k:end])), n=len(inner), at=self.code[k])

    def document(self, line: int, symbol: str, name: str, marks: int) -> None:
        """The doc comment that ends above an item."""
        docs = {t.line: t.text for t in self.notes if t.text.startswith("///")}
        at = line - 1
        while at > 0 and at not in docs and self.lines[at - 1].strip().startswith(("#[", "pub", ")]")) and line - at <= marks + 2:
            at -= 1
        said = []
        while at in docs:
            said.insert(0, docs[at].removeprefix("///").strip())
            at -= 1
        if said:
            self.put("docstring", symbol, name, "\n".join(said), len(said), at=Token("", "", line, 0))


def facts_of(rel: str, text: str) -> list[tuple]:
    try:
        return _File(rel, text).run()
    except (ValueError, IndexError, RecursionError) as error:
        return [("error", module_name(rel), rel, "", type(error).__name__, 0, 0, 0, str(error), 0, [])]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for rel, text in zip(f["rel"], f["text"], strict=True):
            yield pd.DataFrame(facts_of(rel, text or ""), columns=COLUMNS)


def extract(files: DataFrame) -> DataFrame:
    """The fact table of (rel, text) rows."""
    return files.select("rel", "text").mapInPandas(_batches, SCHEMA)


@F.pandas_udf(T.BooleanType())
def parses_as_code(block: pd.Series) -> pd.Series:
    """Whether comment lines read as statements: brackets close, and most lines end
    like code."""

    def one(text: str) -> bool:
        try:
            code = _File("x.rs", text).code
        except (ValueError, IndexError):
            return False
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        ended = sum(x.endswith((";", "{", "}", ",", "(", ")")) for x in lines)
        return bool(lines) and ended * 3 >= len(lines) * 2 and any(t.text in (";", "{", "=", "::") for t in code)

    return block.map(lambda x: x is not None and one(x))
