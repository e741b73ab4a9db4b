"""Tokens of TypeScript source: kind, text, start and end (characters), whether a line break stands before."""

from __future__ import annotations

import re
from typing import NamedTuple


class SourceError(ValueError):
    """The text isn't well formed."""


class Token(NamedTuple):
    kind: str  # name, private, number, string, template, regex, punct, end
    text: str
    start: int
    end: int
    fresh: bool
    parts: tuple = ()


_SPACE = re.compile(r"[\s﻿]+|//[^\n\r]*|/\*.*?\*/", re.S)
_NAME = re.compile(r"(?:[^\W\d]|[$_]|\\u\{?[0-9a-fA-F]+\}?)(?:\w|[$‌‍]|\\u\{?[0-9a-fA-F]+\}?)*")
_NUMBER = re.compile(r"0[xXbBoO][0-9a-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:[^'\\\n]|\\(?:\r\n|.))*'|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_PUNCT = re.compile(r"\.\.\.|=>|\?\?=|\*\*=|&&=|\|\|=|<<=|===|!==|\?\.(?!\d)|\?\?|\*\*|\+\+|--|&&|\|\||==|!=|<=|<<|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
#: Most tokens, with the blanks before them: names without escapes, and punctuation that no longer one begins with.
_PLAIN = re.compile(r"([ \t\r\n]*)(?:([A-Za-z_$][\w$]*)(?![\w$\\\u200c\u200d])|[()\[\];,:@~])")
#: After these a slash begins a regular expression, as after any other punctuation but closing brackets.
_OPENERS = {"return", "throw", "typeof", "case", "in", "of", "instanceof", "new", "delete", "void", "do", "else", "await", "yield"}


def tokenize(source: str, at: int = 0, inside: bool = False) -> tuple[list[Token], int]:
    """(tokens, end): all of the source, or, ``inside`` a template, up to the brace that closes the expression."""
    out: list[Token] = []
    n, fresh, depth = len(source), True, 0
    if at == 0 and source.startswith("#!"):
        at = source.find("\n") if "\n" in source else n
    while at < n:
        if m := _PLAIN.match(source, at):
            begin, end = m.span(0)
            if blanks := m[1]:
                begin += len(blanks)
                fresh = fresh or "\n" in blanks or "\r" in blanks
            name = m[2]
            out.append(Token("punct", source[begin:end], begin, end, fresh) if name is None else Token("name", name, begin, end, fresh))
            at, fresh = end, False
            continue
        m = _SPACE.match(source, at)
        if m:
            fresh = fresh or "\n" in m[0] or "\r" in m[0]
            at = m.end()
            continue
        c = source[at]
        if source.startswith("/*", at):
            raise SourceError(f"comment without end at {at}")
        if c == "`":
            token = _template(source, at, fresh)
        elif m := _NAME.match(source, at):
            token = Token("name", m[0], at, m.end(), fresh)
        elif c.isdigit() or c == "." and at + 1 < n and source[at + 1].isdigit():
            m = _NUMBER.match(source, at)
            token = Token("number", m[0], at, m.end(), fresh)
        elif c in "'\"":
            if not (m := _STRING.match(source, at)):
                raise SourceError(f"string without end at {at}")
            token = Token("string", m[0], at, m.end(), fresh)
        elif c == "#" and (m := _NAME.match(source, at + 1)):
            token = Token("private", "#" + m[0], at, m.end(), fresh)
        elif c == "/" and _regex_may_begin(out) and (m := _REGEX.match(source, at)):
            token = Token("regex", m[0], at, m.end(), fresh)
        elif m := _PUNCT.match(source, at):
            if inside and m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
                if depth < 0:
                    out.append(Token("end", "", at, at, True))
                    return out, m.end()
            token = Token("punct", m[0], at, m.end(), fresh)
        else:
            raise SourceError(f"unexpected {c!r} at {at}")
        out.append(token)
        at, fresh = token.end, False
    if inside:
        raise SourceError("template without end")
    out.append(Token("end", "", n, n, True))
    return out, n


def _regex_may_begin(out: list[Token]) -> bool:
    if not out:
        return True
    t = out[-1]
    if t.kind == "punct":
        return t.text not in (")", "]", "}", "++", "--")
    return t.kind == "name" and t.text in _OPENERS


def _template(source: str, start: int, fresh: bool) -> Token:
    at, n, parts = start + 1, len(source), []
    while at < n:
        c = source[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return Token("template", "`", start, at + 1, fresh, tuple(parts))
        elif source.startswith("${", at):
            tokens, at = tokenize(source, at + 2, True)
            parts.append(tokens)
        else:
            at += 1
    raise SourceError(f"template without end at {start}")
