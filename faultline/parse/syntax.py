"""A tolerant recursive-descent parser: statements and expressions as far as the facts need them; types are walked over."""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokens import SourceError, Token, tokenize


@dataclass
class Node:
    """``kind`` with ``start`` and ``end`` (characters); ``kids`` in source order; other fields by kind in ``at``."""

    kind: str
    start: int
    end: int
    kids: list[Node] = field(default_factory=list)
    at: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.__dict__["at"][name]
        except KeyError:
            raise AttributeError(name) from None


_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor"}
_BINARY = {"+", "-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??", "==", "!=", "===", "!==", "<", ">", "<=", "<<", "instanceof", "in"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "&&=", "||=", "??=", "<<="}
_PREFIX = {"+", "-", "!", "~", "++", "--", "typeof", "void", "delete", "await"}
_KEYWORD_TYPES = {"string", "number", "boolean", "bigint", "symbol", "object", "any", "unknown", "never", "void", "undefined", "null", "this", "true", "false", "intrinsic"}
_RESERVED = {"if", "else", "for", "while", "do", "switch", "case", "default", "try", "catch", "finally", "throw", "return", "break", "continue", "var", "const", "function", "class", "new", "delete", "typeof", "void", "in", "instanceof", "import", "export", "extends", "with", "debugger", "enum"}


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0
        self.no_in = False

    # tokens

    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.tokens[self.i]
        if t[0] == "end":
            raise SourceError(f"unexpected end at {t.start}")
        self.i += 1
        return t

    def is_(self, text: str, k: int = 0) -> bool:
        t = self.peek(k) if k else self.tokens[self.i]
        return t[1] == text and t[0] in ("punct", "name")

    def eat(self, text: str) -> Token | None:
        t = self.tokens[self.i]
        if t[1] != text or t[0] not in ("punct", "name"):
            return None
        self.i += 1
        return t

    def need(self, text: str) -> Token:
        if not self.is_(text):
            raise SourceError(f"expected {text!r}, found {self.t.text!r} at {self.t.start}")
        return self.next()

    def name(self) -> Token:
        if self.t.kind != "name":
            raise SourceError(f"expected a name, found {self.t.text!r} at {self.t.start}")
        return self.next()

    @property
    def last(self) -> int:
        return self.tokens[self.i - 1].end if self.i else 0

    def semicolon(self) -> None:
        if self.eat(";") or self.is_("}") or self.t.kind == "end" or self.t.fresh:
            return
        raise SourceError(f"unexpected {self.t.text!r} at {self.t.start}")

    def attempt(self, f):
        """The result of ``f``, or None and nothing consumed."""
        i = self.i
        try:
            return f()
        except SourceError:
            self.i = i
            return None

    # statements

    def program(self) -> Node:
        kids = []
        while self.t.kind != "end":
            kids.append(self.statement())
        return Node("program", 0, self.last, kids)

    def block(self) -> Node:
        start = self.need("{").start
        kids = []
        while not self.is_("}"):
            kids.append(self.statement())
        self.next()
        return Node("block", start, self.last, kids)

    def statement(self) -> Node:
        t = self.t
        if t.kind == "punct":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.next()
                return Node("empty", t.start, self.last)
            if t.text == "@":
                return self.decorated()
        if t.kind == "name":
            f = getattr(self, f"_{t.text}", None) if t.text in _STATEMENTS else None
            if f is not None and (node := f()) is not None:
                return node
            if self.is_(":", 1) and t.text not in _RESERVED:
                self.next(), self.next()
                body = self.statement()
                return Node("other", t.start, self.last, [body])
        e = self.expression()
        self.semicolon()
        return Node("expression", t.start, self.last, [e])

    def decorated(self, start: int | None = None) -> Node:
        start = self.t.start if start is None else start
        marks = self.decorators()
        node = self.statement()
        node.start = start
        node.kids = marks + node.kids
        return node

    def decorators(self) -> list[Node]:
        out = []
        while self.is_("@"):
            self.next()
            out.append(self.postfix(self.primary(), decorator=True))
        return out

    def _if(self):
        start = self.next().start
        self.need("(")
        test = self.expression()
        self.need(")")
        then = self.statement()
        other = self.statement() if self.eat("else") else None
        return Node("if", start, self.last, [test, then, *([other] if other else [])], {"test": test, "then": then, "other": other})

    def _switch(self):
        start = self.next().start
        self.need("(")
        value = self.expression()
        self.need(")")
        self.need("{")
        cases = []
        while not self.eat("}"):
            s = self.t.start
            if self.eat("default"):
                test = None
            else:
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not (self.is_("case") or self.is_("default") and self.is_(":", 1) or self.is_("}")):
                body.append(self.statement())
            cases.append(Node("case", s, self.last, [*([test] if test else []), *body], {"test": test, "body": body}))
        return Node("switch", start, self.last, [value, *cases], {"cases": cases})

    def _throw(self):
        start = self.next().start
        if self.t.fresh:
            raise SourceError(f"nothing is thrown at {start}")
        e = self.expression()
        self.semicolon()
        return Node("throw", start, self.last, [e], {"value": e})

    def _return(self):
        start = self.next().start
        kids = [] if self.t.fresh or self.is_(";") or self.is_("}") or self.t.kind == "end" else [self.expression()]
        self.semicolon()
        return Node("return", start, self.last, kids)

    def _jump(self):
        t = self.next()
        if self.t.kind == "name" and not self.t.fresh:
            self.next()
        self.semicolon()
        return Node(t.text, t.start, self.last)

    _break = _continue = _debugger = _jump

    def _try(self):
        start = self.next().start
        body, catch, final = self.block(), None, None
        if self.is_("catch"):
            s = self.next().start
            param, kids = None, []
            if self.eat("("):
                if self.t.kind == "name":
                    param = self.next().text
                else:
                    kids.append(self.pattern())
                if self.eat(":"):
                    self.type()
                self.need(")")
            inner = self.block()
            catch = Node("catch", s, self.last, [inner], {"param": param, "body": inner})
        if self.eat("finally"):
            final = self.block()
        if catch is None and final is None:
            raise SourceError(f"try without catch or finally at {start}")
        return Node("try", start, self.last, [body], {"body": body, "catch": catch, "final": final})

    def _for(self):
        start = self.next().start
        self.eat("await")
        self.need("(")
        kids: list[Node] = []
        self.no_in = True
        try:
            if self.t.text in ("var", "let", "const") and self.t.kind == "name":
                kids.append(self.variables())
            elif not self.is_(";"):
                kids.append(self.expression())
        finally:
            self.no_in = False
        if self.eat("of") or self.eat("in"):
            kids.append(self.expression())
        else:
            self.need(";")
            if not self.is_(";"):
                kids.append(self.expression())
            self.need(";")
            if not self.is_(")"):
                kids.append(self.expression())
        self.need(")")
        kids.append(self.statement())
        return Node("other", start, self.last, kids)

    def _while(self):
        start = self.next().start
        self.need("(")
        test = self.expression()
        self.need(")")
        return Node("other", start, self.last, [test, self.statement()])

    def _do(self):
        start = self.next().start
        body = self.statement()
        self.need("while")
        self.need("(")
        test = self.expression()
        self.need(")")
        self.eat(";")
        return Node("other", start, self.last, [body, test])

    def variables(self) -> Node:
        start = self.next().start
        out = []
        while True:
            s, known, kids, name = self.t.start, [], [], None
            if self.t.kind == "name":
                name = self.next()
            else:
                kids.append(self.pattern())
            self.eat("!")
            if self.eat(":"):
                known = self.type()
            value = None
            if self.eat("="):
                value = self.assignment()
                kids.append(value)
            out.append(Node("declarator", s, self.last, kids, {"name": name, "types": known, "value": value}))
            if not self.eat(","):
                return Node("variables", start, self.last, out)

    def _var(self):
        if self.is_("const") and self.is_("enum", 1):
            self.next()
            return self._enum()
        node = self.variables()
        self.semicolon()
        node.end = self.last
        return node

    _const = _var

    def _let(self):
        n = self.peek()
        return self._var() if n.kind == "name" or n.text in ("[", "{") else None

    def _function(self):
        return self.function(self.t.start)

    def _async(self):
        if self.is_("function", 1) and not self.peek().fresh:
            start = self.next().start
            return self.function(start, True)
        return None

    def function(self, start: int, is_async: bool = False, expression: bool = False) -> Node:
        self.need("function")
        self.eat("*")
        name = self.next() if self.t.kind == "name" and not self.is_("(") else None
        node = self.callable(start, is_async)
        if not node.has_body:
            if expression:
                raise SourceError(f"function without body at {start}")
            self.semicolon()
            node.end = self.last
        node.at["name"] = name
        return node

    def callable(self, start: int, is_async: bool) -> Node:
        """Type parameters, parameters, result type and body of a function or method."""
        if self.is_("<"):
            self.type_parameters()
        kids, known = self.parameters()
        result = self.type(predicate=True) if self.eat(":") else []
        has_body = self.is_("{")
        if has_body:
            old, self.no_in = self.no_in, False
            kids.append(self.block())
            self.no_in = old
        return Node("function", start, self.last, kids, {"name": None, "is_async": is_async, "has_body": has_body, "result": result, "params": known})

    def parameters(self) -> tuple[list[Node], dict[str, list[str]]]:
        self.need("(")
        kids: list[Node] = []
        known: dict[str, list[str]] = {}
        while not self.eat(")"):
            kids += self.decorators()
            while self.t.text in _MODIFIERS and self.peek().kind == "name" or self.t.text in _MODIFIERS and self.peek().text in ("{", "["):
                self.next()
            self.eat("...")
            name = None
            if self.t.kind == "name":
                name = self.next().text
            else:
                kids.append(self.pattern())
            self.eat("?")
            if self.eat(":"):
                types = self.type()
                if name:
                    known[name] = types
            if self.eat("="):
                kids.append(self.assignment())
            if not self.is_(")"):
                self.need(",")
        return kids, known

    def pattern(self) -> Node:
        """A destructuring pattern; only its default values and computed keys matter."""
        start = self.t.start
        if self.t.kind == "name":
            self.next()
            return Node("pattern", start, self.last)
        close = {"[": "]", "{": "}"}.get(self.t.text)
        if close is None:
            raise SourceError(f"unexpected {self.t.text!r} at {start}")
        opener, kids = self.next().text, []
        while not self.eat(close):
            if self.eat(","):
                continue
            self.eat("...")
            if opener == "{":
                if self.eat("["):
                    kids.append(self.assignment())
                    self.need("]")
                    self.need(":")
                    kids.append(self.pattern())
                else:
                    self.next()
                    if self.eat(":"):
                        kids.append(self.pattern())
            else:
                kids.append(self.pattern())
            if self.eat("="):
                kids.append(self.assignment())
            if not self.is_(close):
                self.need(",")
        return Node("pattern", start, self.last, kids)

    def _class(self, start: int | None = None, abstract: bool = False):
        start = self.t.start if start is None else start
        self.need("class")
        name = self.next().text if self.t.kind == "name" and not self.is_("extends") and not self.is_("implements") else None
        if self.is_("<"):
            self.type_parameters()
        kids, parents = [], []
        if self.eat("extends"):
            base = self.postfix(self.primary(), no_calls=False)
            kids.append(base)
            if base.kind == "name":
                parents.append((base.text, base.start, base.end, "extends"))
            if self.is_("<"):
                self.type_arguments()
        if self.eat("implements"):
            while True:
                s = self.t
                types = self.type()
                if len(types) == 1:
                    parents.append((types[0], s.start, s.end, "implements"))
                if not self.eat(","):
                    break
        members = self.members()
        return Node("class", start, self.last, [*kids, *members], {"name": name, "parents": parents, "abstract": abstract, "members": members})

    def members(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            out.append(self.member())
        return out

    def member(self) -> Node:
        start = self.t.start
        marks, flags = self.decorators(), set()
        if self.is_("static") and self.is_("{", 1):
            self.next()
            return Node("field", start, self.last, [*marks, self.block()])
        while self.t.kind == "name" and (self.t.text in _MODIFIERS or self.t.text in ("get", "set")):
            n = self.peek()
            if n.text in ("(", "=", ";", ":", "?", "!", "<", "}", ",") and n.kind == "punct" or n.fresh and self.t.text in ("get", "set", "accessor", "declare"):
                break
            flags.add(self.next().text)
            marks += self.decorators()
        self.eat("*")
        if self.is_("[") and self.index_signature():
            return Node("field", start, self.last, marks)
        key, kids = self.key()
        self.eat("?") or self.eat("!")
        if self.is_("(") or self.is_("<"):
            f = self.callable(self.t.start, "async" in flags)
            if not f.has_body:
                self.semicolon()
                f.end = max(f.end, self.last if self.tokens[self.i - 1].text == ";" else f.end)
            return Node("method", start, self.last, [*marks, *kids, f], {"key": key, "flags": flags, "value": f})
        known = self.type() if self.eat(":") else []
        if self.eat("="):
            kids.append(self.assignment())
        self.semicolon()
        return Node("field", start, self.last, [*marks, *kids], {"key": key, "types": known})

    def index_signature(self) -> bool:
        if self.peek().kind == "name" and self.is_(":", 2):
            self.skip_brackets()
            if self.eat(":"):
                self.type()
            self.eat(";") or self.eat(",")
            return True
        return False

    def key(self) -> tuple[Token | None, list[Node]]:
        """(name token if the key is a plain name, expressions of a computed key)."""
        t = self.t
        if t.kind == "name":
            return self.next(), []
        if t.kind in ("string", "number", "private"):
            self.next()
            return None, []
        if self.eat("["):
            e = self.assignment()
            self.need("]")
            return None, [e]
        raise SourceError(f"unexpected {t.text!r} at {t.start}")

    def _abstract(self):
        if self.is_("class", 1):
            start = self.next().start
            return self._class(start, True)
        return None

    def _declare(self):
        if self.peek().kind == "name" and not self.peek().fresh and self.peek().text not in ("instanceof", "in", "as"):
            start = self.next().start
            if self.t.text == "global" and self.is_("{", 1):
                self.next()
                return Node("other", start, self.last, [self.block()])
            node = self.statement()
            node.start = start
            return node
        return None

    def _interface(self):
        if self.peek().kind != "name":
            return None
        start = self.next().start
        name, parents, methods = self.name().text, [], []
        if self.is_("<"):
            self.type_parameters()
        if self.eat("extends"):
            while True:
                s = self.t
                types = self.type()
                if len(types) == 1:
                    parents.append((types[0], s.start, s.end, "extends"))
                if not self.eat(","):
                    break
        self.need("{")
        while not self.eat("}"):
            if self.eat(";") or self.eat(","):
                continue
            methods += self.type_member()
        return Node("interface", start, self.last, [], {"name": name, "parents": parents, "methods": methods})

    def type_member(self) -> list[tuple[str, int, int]]:
        """A member of an interface or object type: [(name, start, end)] if it is a method with a plain name."""
        start, mode = self.t.start, None
        while self.t.kind == "name" and self.t.text in ("readonly", "get", "set", "new") and not (self.peek().kind == "punct" and self.peek().text in ("(", ":", "?", "<", ";", ",", "}")):
            mode = self.next().text
        if self.is_("new") and self.peek().text in ("(", "<"):
            self.next()
            mode = "new"
        if self.is_("+") or self.is_("-"):
            self.next()
            self.eat("readonly")
        if self.is_("(") or self.is_("<"):
            key = None
        elif self.is_("["):
            self.skip_brackets()
            key = None
        else:
            key, _ = self.key()
        while self.is_("?") or self.is_("+") or self.is_("-"):
            self.next()
        method = self.is_("(") or self.is_("<")
        if method:
            if self.is_("<"):
                self.type_parameters()
            self.skip_brackets()
        if self.eat(":"):
            self.type(predicate=True)
        end = self.last
        self.eat(";") or self.eat(",")
        return [(key.text, start, end)] if method and key is not None and mode not in ("get", "set") else []

    def _type(self):
        if self.peek().kind != "name" or self.peek().fresh:
            return None
        start = self.next().start
        name = self.name().text
        if self.is_("<"):
            self.type_parameters()
        self.need("=")
        members = self.type()
        self.semicolon()
        return Node("alias", start, self.last, [], {"name": name, "members": members})

    def _enum(self):
        start = self.next().start
        self.name()
        self.need("{")
        kids = []
        while not self.eat("}"):
            self.key()
            if self.eat("="):
                kids.append(self.assignment())
            if not self.is_("}"):
                self.need(",")
        return Node("other", start, self.last, kids)

    def _namespace(self):
        n = self.peek()
        if n.kind not in ("name", "string") or n.fresh:
            return None
        start = self.next().start
        self.next()
        while self.eat("."):
            self.name()
        kids = [self.block()] if self.is_("{") else []
        if not kids:
            self.semicolon()
        return Node("other", start, self.last, kids)

    _module = _namespace

    def _import(self):
        if self.peek().text in ("(", "."):
            return None
        start = self.next().start
        names: list[tuple[str, str]] = []
        source = None
        if self.t.kind == "string":
            source = self.next().text[1:-1]
        else:
            if self.is_("type") and self.peek().text not in ("from", ",", "="):
                self.next()
            if self.t.kind == "name":
                local = self.next().text
                if self.eat("="):
                    self.expression()
                    self.semicolon()
                    return Node("other", start, self.last)
                names.append((local, "default"))
                self.eat(",")
            if self.eat("*"):
                self.need("as")
                names.append((self.name().text, "*"))
            elif self.is_("{"):
                names += self.specifiers()
            self.need("from")
            source = self.next().text[1:-1]
        if self.eat("with") or self.eat("assert"):
            self.skip_brackets()
        self.semicolon()
        return Node("import", start, self.last, [], {"names": names, "source": source})

    def specifiers(self) -> list[tuple[str, str]]:
        self.need("{")
        out = []
        while not self.eat("}"):
            if self.is_("type") and self.peek().text not in (",", "}", "as"):
                self.next()
            name = self.next().text
            local = self.next().text if self.eat("as") else name
            out.append((local, name))
            if not self.is_("}"):
                self.need(",")
        return out

    def _export(self):
        start = self.next().start
        if self.eat("default"):
            t = self.t
            if t.text in ("function", "class", "abstract", "interface") or t.text == "async" and self.is_("function", 1) or t.text == "@":
                inner = self.statement() if t.text != "@" else self.decorated()
            else:
                inner = self.assignment()
                self.semicolon()
            return Node("other", start, self.last, [inner])
        if self.eat("*"):
            if self.eat("as"):
                self.next()
            self.need("from")
            self.next()
            self.semicolon()
            return Node("other", start, self.last)
        if self.is_("{") or self.is_("type") and self.is_("{", 1):
            self.eat("type")
            names = self.specifiers()
            source = self.next().text[1:-1] if self.eat("from") else None
            self.semicolon()
            return Node("reexport", start, self.last, [], {"names": names, "source": source})
        if self.eat("="):
            e = self.expression()
            self.semicolon()
            return Node("other", start, self.last, [e])
        if self.eat("as"):
            self.need("namespace")
            self.name()
            self.semicolon()
            return Node("other", start, self.last)
        inner = self.statement() if not self.is_("@") else self.decorated()
        return Node("export", start, self.last, [inner], {"inner": inner})

    # types

    def skip_brackets(self) -> None:
        """Past a balanced group of (), [] or {}."""
        depth = 0
        while True:
            t = self.next()
            if t.kind == "punct":
                if t.text in "([{":
                    depth += 1
                elif t.text in ")]}":
                    depth -= 1
                    if depth == 0:
                        return

    def type_parameters(self) -> None:
        self.need("<")
        while not self.eat(">"):
            while self.t.text in ("const", "in", "out") and self.peek().kind == "name":
                self.next()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.is_(">"):
                self.need(",")

    def type_arguments(self) -> None:
        self.need("<")
        while not self.eat(">"):
            self.type()
            if not self.is_(">"):
                self.need(",")

    def type(self, predicate: bool = False) -> list[str]:
        """Past a type; the names of a reference, or of all references of a union; nothing for other types."""
        if predicate and self.is_("asserts") and self.peek().kind == "name" and not self.peek().fresh:
            self.next()
            self.next()
            if self.eat("is"):
                self.type()
            return []
        if predicate and self.t.kind == "name" and self.is_("is", 1) and not self.peek().fresh:
            self.next()
            self.next()
            self.type()
            return []
        names = self.union()
        if self.is_("extends") and not self.t.fresh and not self.no_conditional:
            self.next()
            self.no_conditional += 1
            self.union()
            self.no_conditional -= 1
            self.need("?")
            self.type()
            self.need(":")
            self.type()
            return []
        return names

    no_conditional = 0

    def union(self) -> list[str]:
        self.eat("|")
        names = self.intersection()
        while self.eat("|"):
            names = names + self.intersection()
        return names

    def intersection(self) -> list[str]:
        self.eat("&")
        names = self.unit()
        while self.eat("&"):
            self.unit()
            names = []
        return names

    def unit(self) -> list[str]:
        t = self.t
        names: list[str] = []
        if t.kind == "name" and t.text in ("keyof", "readonly", "unique", "infer") and (self.peek().kind in ("name", "string", "template") or self.peek().text in ("(", "[", "{")):
            self.next()
            self.unit()
            if t.text == "infer" and self.is_("extends"):
                self.attempt(lambda: (self.next(), self.union()))
            return []
        if t.kind == "name" and t.text in ("new", "abstract") and self.peek().text in ("(", "<", "new"):
            self.next()
            return self.unit()
        if t.kind == "name" and t.text == "typeof":
            self.next()
            if self.is_("import"):
                self.unit()
            else:
                self.next()
                while self.eat("."):
                    self.next()
                if self.is_("<") and not self.t.fresh:
                    self.type_arguments()
        elif t.kind == "name" and t.text == "import":
            self.next()
            self.skip_brackets()
            while self.eat("."):
                self.name()
            if self.is_("<"):
                self.type_arguments()
        elif t.kind == "name":
            self.next()
            plain = True
            while self.is_("."):
                self.next()
                self.name()
                plain = False
            if self.is_("<") and not self.t.fresh:
                self.type_arguments()
            names = [t.text] if plain and t.text not in _KEYWORD_TYPES else []
        elif t.text == "<":
            self.type_parameters()
            self.skip_brackets()
            self.need("=>")
            self.type(predicate=True)
            return []
        elif t.text == "(":
            self.skip_brackets()
            if self.eat("=>"):
                self.type(predicate=True)
                return []
        elif t.text in ("{", "["):
            self.skip_brackets()
        elif t.kind in ("string", "number", "template"):
            self.next()
        elif t.text == "-":
            self.next(), self.next()
        else:
            raise SourceError(f"unexpected {t.text!r} in a type at {t.start}")
        while self.is_("[") and not self.t.fresh:
            self.skip_brackets()
            names = []
        return names

    # expressions

    def expression(self) -> Node:
        e = self.assignment()
        if not self.is_(","):
            return e
        kids = [e]
        while self.eat(","):
            kids.append(self.assignment())
        return Node("sequence", e.start, self.last, kids)

    def assignment(self) -> Node:
        t = self.t
        if t.kind == "name" and t.text == "yield":
            self.next()
            self.eat("*")
            ends = self.t.fresh or self.t.kind == "end" or self.t.text in (")", "]", "}", ",", ";", ":")
            return Node("unary", t.start, self.last, [] if ends else [self.assignment()])
        if arrow := self.arrow():
            return arrow
        left = self.conditional()
        if self.t.kind == "punct" and (self.t.text in _ASSIGN or self.shift_assign()):
            self.next()
            right = self.assignment()
            return Node("assign", left.start, self.last, [left, right])
        return left

    def shift_assign(self) -> bool:
        """``>=``-like operators are single tokens here; ``>>=`` is put together."""
        n = 0
        while self.is_(">", n) and (n == 0 or self.peek(n).start == self.peek(n - 1).end):
            n += 1
        if n >= 2 and self.is_("=", n) and self.peek(n).start == self.peek(n - 1).end:
            self.i += n
            return True
        return False

    def arrow(self) -> Node | None:
        t = self.t
        is_async = t.kind == "name" and t.text == "async" and not self.peek().fresh and (self.peek().kind == "name" and self.is_("=>", 2) or self.peek().text in ("(", "<"))
        k = 1 if is_async else 0
        first = self.peek(k) if k else t
        if first.kind == "name" and self.is_("=>", k + 1) and first.text not in _RESERVED:
            self.i += k + 2
            return self.arrow_body(t.start, is_async, [], {})
        if first.text not in ("(", "<") or first.kind != "punct":
            return None

        def try_() -> tuple:
            self.i += k
            if self.is_("<"):
                self.type_parameters()
            kids, known = self.parameters()
            if self.eat(":"):
                self.type(predicate=True)
            if self.t.fresh:
                raise SourceError("no arrow")
            self.need("=>")
            return kids, known

        got = self.attempt(try_)
        return None if got is None else self.arrow_body(t.start, is_async, *got)

    def arrow_body(self, start: int, is_async: bool, kids: list[Node], known: dict) -> Node:
        if self.is_("{"):
            old, self.no_in = self.no_in, False
            body = self.block()
            self.no_in = old
        else:
            body = self.assignment()
        return Node("arrow", start, self.last, [*kids, body], {"is_async": is_async, "params": known})

    def conditional(self) -> Node:
        test = self.binary()
        if not self.is_("?"):
            return test
        self.next()
        old, self.no_in = self.no_in, False
        i = self.i
        # an arrow with a result type may swallow the colon of this conditional
        try:
            then = self.assignment()
            self.need(":")
        except SourceError:
            self.i = i
            then = self.binary()
            self.need(":")
        self.no_in = old
        other = self.assignment()
        return Node("conditional", test.start, self.last, [test, then, other], {"then": then, "other": other})

    def binary(self) -> Node:
        first = self.unary()
        operands, ops = [first], []
        while True:
            t = self.t
            if t.kind == "name" and t.text in ("as", "satisfies") and not t.fresh:
                self.next()
                if not self.eat("const"):
                    self.type()
                operands[-1] = Node("as", operands[-1].start, self.last, [operands[-1]])
                continue
            if t.text == "in" and self.no_in or t.kind not in ("punct", "name") or t.text not in _BINARY:
                break
            if t.text == ">":
                n = 1
                while self.is_(">", n) and self.peek(n).start == self.peek(n - 1).end:
                    n += 1
                if self.is_("=", n) and self.peek(n).start == self.peek(n - 1).end:
                    if n >= 2:
                        break
                    n += 1
                self.i += n
            else:
                self.next()
            ops.append(t.text)
            operands.append(self.unary())
        if not ops:
            return operands[0]
        kind = "instanceof" if ops == ["instanceof"] else "binary"
        return Node(kind, first.start, self.last, operands)

    def unary(self) -> Node:
        t = self.t
        if t.kind in ("punct", "name") and t.text in _PREFIX:
            if t.text == "await" and (self.peek().kind == "punct" and self.peek().text in (")", ";", ",", ".", "=", "]", "}")):
                return self.postfix(self.primary())
            self.next()
            e = self.unary()
            return Node("await" if t.text == "await" else "unary", t.start, self.last, [e])
        if t.text == "<" and t.kind == "punct":  # an old-style assertion
            self.type_arguments()
            e = self.unary()
            return Node("as", t.start, self.last, [e])
        e = self.postfix(self.primary())
        if self.t.text in ("++", "--") and self.t.kind == "punct" and not self.t.fresh:
            self.next()
            return Node("unary", e.start, self.last, [e])
        return e

    def postfix(self, e: Node, no_calls: bool = False, decorator: bool = False) -> Node:
        while True:
            t = self.t
            if t.kind == "template":
                e = Node("tagged", e.start, t.end, [e, self.primary()])
            elif t.kind != "punct":
                return e
            elif t.text in (".", "?."):
                self.next()
                if t.text == "?." and self.is_("("):
                    e = self.call(e)
                elif t.text == "?." and self.is_("["):
                    continue
                elif t.text == "?." and self.is_("<"):
                    self.type_arguments()
                    e = self.call(e)
                else:
                    p = self.next()
                    if p.kind not in ("name", "private"):
                        raise SourceError(f"unexpected {p.text!r} at {p.start}")
                    e = Node("member" if p.kind == "name" else "private", e.start, self.last, [e], {"property": p})
            elif t.text == "[" and not (decorator and t.fresh):
                self.next()
                old, self.no_in = self.no_in, False
                k = self.expression()
                self.no_in = old
                self.need("]")
                e = Node("index", e.start, self.last, [e, k])
            elif t.text == "!" and not t.fresh and not (self.is_("=", 1) and self.peek().start == t.end):
                self.next()
                e = Node("nonnull", e.start, self.last, [e])
            elif t.text == "(" and not no_calls:
                e = self.call(e)
            elif t.text == "<" and not no_calls:

                def generic(e=e) -> Node:
                    self.type_arguments()
                    if self.t.kind == "template":
                        return e
                    if not self.is_("("):
                        raise SourceError("no call")
                    return self.call(e)

                got = self.attempt(generic)
                if got is None:
                    return e
                e = got
            else:
                return e

    def arguments(self) -> list[Node]:
        self.need("(")
        old, self.no_in = self.no_in, False
        out = []
        while not self.eat(")"):
            self.eat("...")
            out.append(self.assignment())
            if not self.is_(")"):
                self.need(",")
        self.no_in = old
        return out

    def call(self, callee: Node) -> Node:
        args = self.arguments()
        return Node("call", callee.start, self.last, [callee, *args], {"callee": callee})

    def primary(self) -> Node:
        t = self.t
        if t.kind == "name":
            if t.text == "function":
                return self.function(t.start, expression=True)
            if t.text == "async" and self.is_("function", 1) and not self.peek().fresh:
                self.next()
                return self.function(t.start, True, expression=True)
            if t.text == "class":
                return self._class()
            if t.text == "new":
                self.next()
                if self.eat("."):
                    self.next()
                    return Node("value", t.start, self.last)
                callee = self.postfix(self.primary(), no_calls=True)
                if self.is_("<"):
                    self.attempt(lambda: (self.type_arguments(), None if self.is_("(") else self.need("(")))
                args = self.arguments() if self.is_("(") else []
                return Node("new", t.start, self.last, [callee, *args], {"callee": callee})
            if t.text == "import":
                self.next()
                if self.is_("("):
                    args = self.arguments()
                    return Node("value", t.start, self.last, args)
                return Node("value", t.start, self.last)
            if t.text in _RESERVED:
                raise SourceError(f"unexpected {t.text!r} at {t.start}")
            self.next()
            special = t.text in ("this", "super", "null", "true", "false")
            return Node("value" if special else "name", t.start, t.end, [], {"text": t.text})
        if t.kind in ("number", "string", "regex", "private"):
            self.next()
            return Node("value", t.start, t.end)
        if t.kind == "template":
            self.next()
            kids = []
            for tokens in t.parts:
                p = Parser(tokens)
                kids.append(p.expression())
                if p.t.kind != "end":
                    raise SourceError(f"unexpected {p.t.text!r} at {p.t.start}")
            return Node("value", t.start, t.end, kids)
        if t.text == "(":
            self.next()
            old, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = old
            self.need(")")
            return Node("paren", t.start, self.last, [e])
        if t.text == "[":
            self.next()
            kids = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                kids.append(self.assignment())
                if not self.is_("]"):
                    self.need(",")
            return Node("value", t.start, self.last, kids)
        if t.text == "{":
            return self.object()
        if t.text == "@":
            marks = self.decorators()
            c = self._class()
            c.kids = marks + c.kids
            return c
        raise SourceError(f"unexpected {t.text!r} at {t.start}")

    def object(self) -> Node:
        start = self.need("{").start
        kids: list[Node] = []
        while not self.eat("}"):
            if self.eat("..."):
                kids.append(self.assignment())
            else:
                is_async = False
                while self.t.text in ("get", "set", "async") and self.t.kind == "name" and not (self.peek().kind == "punct" and self.peek().text in ("(", ":", ",", "}", "=", "<")):
                    is_async = is_async or self.t.text == "async"
                    self.next()
                self.eat("*")
                plain = self.t
                _, computed = self.key()
                kids += computed
                if self.is_("(") or self.is_("<"):
                    kids.append(self.callable(self.t.start, is_async))
                elif self.eat(":"):
                    kids.append(self.assignment())
                elif self.eat("="):
                    kids.append(self.assignment())
                else:
                    kids.append(Node("name", plain.start, plain.end, [], {"text": plain.text}))
            if not self.is_("}"):
                self.need(",")
        return Node("value", start, self.last, kids)


_STATEMENTS = {"if", "switch", "throw", "return", "break", "continue", "debugger", "try", "for", "while", "do", "var", "let", "const", "function", "async", "class", "abstract", "declare", "interface", "type", "enum", "namespace", "module", "import", "export"}


def parse(source: str) -> Node:
    """The program of a source text; SourceError if it isn't well formed."""
    return Parser(tokenize(source)[0]).program()
