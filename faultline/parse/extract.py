"""Facts of one source text, in one walk over its syntax tree."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from .syntax import Node, parse
from .tokens import SourceError

NAMED, RETHROW, UNKNOWN = "named", "rethrow", "unknown"


@dataclass
class Facts:
    """Rows by table; spans are UTF-8 byte offsets.  Throws, calls and try blocks carry the key of their function."""

    functions: list[dict] = field(default_factory=list)
    throws: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    tries: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)
    signatures: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    error: str | None = None


class Bytes:
    """Byte offset of each character offset."""

    def __init__(self, source: str):
        self.plain = source.isascii()
        if not self.plain:
            total, self.at = 0, [0]
            for c in source:
                o = ord(c)
                total += 1 if o < 0x80 else 2 if o < 0x800 else 3 if o < 0x10000 else 4
                self.at.append(total)

    def __call__(self, i: int) -> int:
        return i if self.plain else self.at[i]


def function_key(path: str, name: str, start: int, end: int) -> str:
    return hashlib.sha256("\0".join((path, name, str(start), str(end))).encode()).hexdigest()


# where control goes: which types a catch clause deals with


def rethrows(s: Node, param: str | None) -> bool:
    """Whether the statement may throw the caught value on, as far as straight code, branches and cases show."""
    if param is None:
        return False
    if s.kind == "throw":
        return s.value.kind == "name" and s.value.text == param
    if s.kind == "block":
        for x in s.kids:
            if rethrows(x, param):
                return True
            if leaves(x):
                return False
        return False
    if s.kind == "if":
        return rethrows(s.then, param) or s.other is not None and rethrows(s.other, param)
    if s.kind == "switch":
        return any(rethrows(x, param) for case in s.cases for x in case.body)
    return False


def leaves(s: Node) -> bool:
    """Whether nothing after the statement runs, whatever it throws."""
    if s.kind in ("return", "throw", "break", "continue"):
        return True
    if s.kind == "if":
        return leaves(s.then) and s.other is not None and leaves(s.other)
    return s.kind == "block" and any(leaves(x) for x in s.kids)


def ends(s: Node, param: str | None, inside: str = "branch") -> bool:
    """Whether the statement always ends the catch clause without throwing the caught value on.

    ``inside``: 'branch' (a branch of an if), 'list' (a statement of a block: a bare block doesn't count), or 'case' (break
    only leaves the switch).
    """
    if rethrows(s, param):
        return False
    if s.kind in ("throw", "return", "continue"):
        return True
    if s.kind == "break":
        return inside != "case"
    if s.kind == "block":
        return inside != "list" and any(ends(x, param, "case" if inside == "case" else "list") for x in s.kids)
    if s.kind == "if":
        deeper = "case" if inside == "case" else "branch"
        return ends(s.then, param, deeper) and s.other is not None and ends(s.other, param, deeper)
    if s.kind == "switch":
        cases = s.cases
        if all(c.test is not None for c in cases) or not cases[-1].body:
            return False
        return all(any(ends(x, param, "case") for x in c.body) for c in cases if c.body)
    return False


def caught_types(body: Node, param: str | None) -> list[str]:
    """Types that the clause's own ``if (param instanceof T)`` statements deal with for good."""
    out = []
    for s in body.kids if param is not None else ():
        if s.kind == "if" and s.test.kind == "instanceof":
            left, right = s.test.kids
            if left.kind == "name" and left.text == param and right.kind == "name" and ends(s.then, param):
                out.append(right.text)
    return out


def thrown(e: Node, params: list[str]) -> tuple[str, str | None]:
    """(kind, name) of a thrown expression."""
    if e.kind == "new" and e.callee.kind == "name":
        return NAMED, e.callee.text
    if e.kind == "call" and e.callee.kind == "name" and e.callee.text.endswith("Error"):
        return NAMED, e.callee.text
    if e.kind == "conditional":
        first = thrown(e.then, params)
        return first if first[0] == NAMED else thrown(e.other, params)
    if e.kind == "name" and e.text in params:
        return RETHROW, e.text
    return UNKNOWN, None


class Walk:
    def __init__(self, path: str, source: str):
        self.path, self.source, self.byte = path, source, Bytes(source)
        self.facts, self.scopes, self.params = Facts(), [], []
        self.known: dict[str, list[str]] = {}  # annotated variables of the file; the last annotation counts
        self.in_class: str | None = None
        self.hints: list[dict[str, list[str]]] = []  # annotated parameters of the functions around

    def span(self, n: Node | tuple) -> dict:
        start, end = (n.start, n.end) if isinstance(n, Node) else n
        return {"start": self.byte(start), "end": self.byte(end)}

    def doc(self, start: int) -> str | None:
        before = self.source[:start].rstrip()
        at = before.rfind("/**") if before.endswith("*/") else -1
        return before[at:] if at >= 0 else None

    def begin(self, name: str, name_span: tuple[int, int], f: Node, doc: str | None) -> None:
        s = self.span(f)
        fn = function_key(self.path, name, s["start"], s["end"])
        params = [{"name": k, "types": v} for k, v in f.params.items() if v]
        line = self.source.count("\n", 0, name_span[0]) + 1
        self.facts.functions.append({"fn": fn, "file": self.path, "name": name, **s, "name_start": self.byte(name_span[0]), "name_end": self.byte(name_span[1]), "name_line": line, "is_async": f.is_async, "class_name": self.in_class, "has_body": f.at.get("has_body", True), "comment": doc, "result": f.at.get("result", []), "params": params})
        self.scopes.append(fn)

    def named(self, name, f: Node, doc: str | None) -> None:
        self.begin(name.text, (name.start, name.end), f, doc)
        self.inside(f)
        self.scopes.pop()

    def inside(self, f: Node) -> None:
        self.hints.append(f.params)
        self.each(f.kids)
        self.hints.pop()

    def _arrow(self, n: Node) -> None:
        self.inside(n)

    def each(self, nodes: list[Node]) -> None:
        for n in nodes:
            self.visit(n)

    def visit(self, n: Node) -> None:
        f = getattr(self, f"_{n.kind}", None)
        if f:
            f(n)
        else:
            self.each(n.kids)

    def add(self, table: list[dict], row: dict) -> None:
        if self.scopes:
            table.append({"fn": self.scopes[-1], **row})

    def _function(self, n: Node) -> None:
        if n.name is not None:
            self.named(n.name, n, self.doc(n.start))
        else:
            self.inside(n)

    def declarators(self, n: Node, doc_at: int, annotate: bool) -> None:
        for d in n.kids:
            if annotate and d.name is not None and d.types:
                self.known[d.name.text] = d.types
            if d.value is not None and d.value.kind == "arrow" and d.name is not None:
                self.each(d.kids[:-1])
                self.named(d.name, d.value, self.doc(doc_at))
            else:
                self.each(d.kids)

    def _variables(self, n: Node) -> None:
        self.declarators(n, n.start, True)

    def _export(self, n: Node) -> None:
        inner = n.inner
        if inner.kind == "variables":
            self.declarators(inner, n.start, False)
        elif inner.kind == "function" and inner.name is not None:
            self.named(inner.name, inner, self.doc(n.start))
        else:
            self.visit(inner)

    def hint(self, e: Node) -> str | None:
        """The annotated type of a thrown parameter."""
        if e.kind == "name":
            for known in reversed(self.hints):
                if types := known.get(e.text):
                    return types[0]
        return None

    def _throw(self, n: Node) -> None:
        e = n.value
        if e.kind == "name" and e.text in self.known:
            for t in self.known[e.text]:
                self.add(self.facts.throws, {**self.span(n), "kind": NAMED, "name": t, "hint": None})
        else:
            kind, name = thrown(e, self.params)
            self.add(self.facts.throws, {**self.span(n), "kind": kind, "name": name, "hint": self.hint(e) if kind == UNKNOWN else None})
        self.each(n.kids)

    def _call(self, n: Node) -> None:
        c = n.callee
        if c.kind == "name":
            self.add(self.facts.calls, {"callee_name": c.text, "callee_start": self.byte(c.start), "callee_end": self.byte(c.end), **self.span(n), "receiver": None})
        elif c.kind == "member":
            p, r = c.property, c.kids[0]
            receiver = r.text if r.kind == "name" or r.kind == "value" and r.at.get("text") == "this" else None
            self.add(self.facts.calls, {"callee_name": p.text, "callee_start": self.byte(p.start), "callee_end": self.byte(p.end), **self.span(n), "receiver": receiver})
        self.each(n.kids)

    def _try(self, n: Node) -> None:
        c = n.catch
        cs = self.span(c) if c is not None else {"start": None, "end": None}
        t = self.span(n.body)
        self.add(self.facts.tries, {"try_start": t["start"], "try_end": t["end"], "catch_start": cs["start"], "catch_end": cs["end"], "caught_types": caught_types(c.body, c.param) if c is not None else []})
        self.each(n.body.kids)
        if c is not None:
            if c.param is not None:
                self.params.append(c.param)
            self.each(c.body.kids)
            if c.param is not None:
                self.params.pop()
        if n.final is not None:
            self.each(n.final.kids)

    def parents(self, n: Node) -> None:
        for name, start, end, kind in n.parents:
            self.facts.relations.append({"child_file": self.path, "child": n.name, "child_span": self.span(n), "parent": name, "parent_span": self.span((start, end)), "kind": kind})

    def _interface(self, n: Node) -> None:
        self.parents(n)
        for name, start, end in n.methods:
            self.facts.signatures.append({"type_file": self.path, "type_name": n.name, "type_span": self.span(n), "method_name": name, "method_span": self.span((start, end)), "comment": self.doc(start), "is_abstract": False})

    def _class(self, n: Node) -> None:
        before, self.in_class = self.in_class, n.name
        if n.name is not None:
            self.parents(n)
            for m in n.members if n.abstract else ():
                if m.kind == "method" and "abstract" in m.flags and m.key is not None:
                    self.facts.signatures.append({"type_file": self.path, "type_name": n.name, "type_span": self.span(n), "method_name": m.key.text, "method_span": self.span(m), "comment": self.doc(m.start), "is_abstract": True})
        self.each(n.kids)
        self.in_class = before

    def _method(self, n: Node) -> None:
        if "abstract" in n.flags:
            return
        if n.key is None:
            self.each(n.kids)
            return
        f = n.value
        self.begin(n.key.text, (n.key.start, n.key.end), f, self.doc(n.start))
        self.each(n.kids[:-1])
        self.inside(f)
        self.scopes.pop()

    def _alias(self, n: Node) -> None:
        for k, m in enumerate(n.members):
            self.facts.aliases.append({"file": self.path, "alias": n.name, "member": m, "ordinal": k})

    def _import(self, n: Node) -> None:
        for local, name in n.names:
            self.facts.imports.append({"file": self.path, "local": local, "imported": name, "source": n.source})


def extract(path: str, source: str) -> Facts:
    """All facts of a file; a text that isn't well formed has an ``error`` and no rows."""
    try:
        walk = Walk(path, source)
        walk.visit(parse(source))
        return walk.facts
    except (SourceError, RecursionError) as e:
        return Facts(error=str(e) or type(e).__name__)


def try_blocks(source: str) -> list[dict]:
    """All try blocks of a text, those outside functions too."""
    out: list[dict] = []
    walk = Walk("", source)

    def visit(n: Node) -> None:
        if n.kind == "try":
            c = n.catch
            t, cs = walk.span(n.body), walk.span(c) if c is not None else {"start": None, "end": None}
            out.append({"try_start": t["start"], "try_end": t["end"], "catch_start": cs["start"], "catch_end": cs["end"], "caught_types": caught_types(c.body, c.param) if c is not None else []})
        for k in [*n.kids, *(x for x in (n.at.get("catch"), n.at.get("final")) if x is not None)]:
            visit(k)

    visit(parse(source))
    return out


def classify(snippet: str, params: list[str] = ()) -> tuple[str, str | None]:
    """(kind, name) of the text of a throw statement; unknown if it isn't one."""
    try:
        body = parse(snippet).kids
    except SourceError:
        return UNKNOWN, None
    return thrown(body[0].value, list(params)) if body and body[0].kind == "throw" else (UNKNOWN, None)
