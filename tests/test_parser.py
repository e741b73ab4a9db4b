"""Tokens, syntax and facts of TypeScript texts."""

import pytest

from faultline.parse.extract import classify, extract, try_blocks
from faultline.parse.syntax import parse
from faultline.parse.tokens import SourceError

GOOD = [
    "const a = <T,>(x: T): x is T => x; let f = async <A>(b = c ? d : e): Promise<A> => { await g<B>(h)!.i?.[j]?.(k) }",
    "type A<T> = T extends (infer U)[] ? { [K in keyof U]: () => void } : `x${string}`; type B = | 'a' | -1 | [a: string, b?: number] | typeof x.y | import('m').N<string>",
    "class A<T> extends B<T>(C).D implements E, F.G<H> { static #p = 1; declare x?: string; constructor(private readonly y: Z = new Z()) { super(); } get v() { return 1 } set v(x) {} static { q(); } *gen() {} async *[Symbol.it]() {} abstract; 'str'(): void {} 1() {} @dec({a: 1}) m?(): void; [k: string]: any }",
    "for (const [a, { b = c() }] of d) for (;;) { break } for (let i = 0, n = 1; i < n; i++) continue; for (x in y); lab: while (1) { continue lab } do x(); while (y)",
    "x = a / b / c; y = /re[/]g/gi.test(s); z = a ? (b) : (c); w = a ? (b, c) => d : e; v = `a${`b${c}`}d`; u = a as const satisfies B; t = <any>s; r >>>= 1; q = a > b >> c >= d",
    "import d, * as n from 'm'; import type { T } from './t'; import { type A, b as c } from \"x\"; export * from 'y'; export { a as default, type B } from 'z'; export default abstract class {} ",
    "declare module 'x' { export function f(a: string): void } declare global { interface Window { a: b } } namespace A.B { export const c = 1 } enum E { A = 1, 'B' } const enum F {} export = q",
    "function f(this: X, a?: string, ...r: any[]): asserts a is string {} function g(a: string): void; function g(a: any) {} abstract class Q { abstract m(): void; abstract readonly p: string }",
    "const { a, ...b } = { get: 1, set: 2, async: 3, get x() { return 1 }, async y() {}, *z() {}, [k]: v, 'q': 1, new: 2, w }; o.delete().new.class; if (a < b && c > d) {}",
    "label: { } ; var yield_ = 1, of = 2, type = 3, async = 4; type = 5; async = 6; abstract: 1; let x: unique symbol; let y: new () => A; let z: abstract new (a: B) => C",
    "﻿#!no", "",
]


@pytest.mark.parametrize("source", [g for g in GOOD if not g.startswith("﻿#")])
def test_well_formed(source):
    parse(source)


@pytest.mark.parametrize("source", ["function (", "const = 1", "a b c", "try { }", "'x", "`a${b", "/* x", "class { a( }", "if (", "f(]", "let x: ;", "throw\nx"])
def test_not_well_formed(source):
    with pytest.raises(SourceError):
        parse(source)
    assert extract("f.ts", source).error


def caught(body, param="(e)"):
    blocks = try_blocks("try { v(); } catch " + param + " { " + body + " }")
    assert len(blocks) == 1
    return blocks[0]["caught_types"]


@pytest.mark.parametrize(
    ("body", "types"),
    [
        ("if (e instanceof S) { return; } throw e;", ["S"]),
        ("if (e instanceof S) return; if (e instanceof T) { log(); throw new U(); }", ["S", "T"]),
        ("if (e instanceof S) { log(e); } throw e;", []),
        ("if (e instanceof S) { if (c) return; } throw e;", []),
        ("if (e instanceof S) { if (c) return 1; else return 2; throw e; } throw e;", ["S"]),
        ("if (e instanceof S) { if (c) throw e; return; } throw e;", []),
        ("if (e instanceof S) { throw e; }", []),
        ("if (other instanceof S) return;", []),
        ("if (e instanceof a.S) return;", []),
        ("if (e instanceof S && c) return;", []),
        ("if (c) {} else if (e instanceof S) return;", []),
        ("{ if (e instanceof S) return; }", []),
        ("if (e instanceof S) { { return; } }", []),
        ("if (e instanceof S) { switch (c) { case 1: return; case 2: throw new T(); default: return; } }", ["S"]),
        ("if (e instanceof S) { switch (c) { case 1: return; } }", []),
        ("if (e instanceof S) { switch (c) { case 1: break; default: return; } }", []),
        ("if (e instanceof S) { switch (c) { case 1: case 2: return; default: return; } }", ["S"]),
        ("if (e instanceof S) { switch (c) { default: return; case 2: } }", []),
        ("if (e instanceof S) { switch (c) { case 1: throw e; default: return; } }", []),
        ("if (e instanceof S) { switch (c) { case 1: { if (d) return; else continue; } default: throw new T(); } }", ["S"]),
        ("if (e instanceof S) { while (c) { throw e; } return; }", ["S"]),
    ],
)
def test_caught_types(body, types):
    assert caught(body) == types


def test_catch_without_a_name():
    assert caught("if (e instanceof S) return;", "") == [] and caught("if (e instanceof S) return;", "({ e })") == []


@pytest.mark.parametrize(
    ("text", "params", "want"),
    [
        ("throw new A('x')", [], ("named", "A")), ("throw new a.B()", [], ("unknown", None)), ("throw failError(1)", [], ("named", "failError")), ("throw fail(1)", [], ("unknown", None)),
        ("throw c ? new A() : new B()", [], ("named", "A")), ("throw c ? x : new B()", [], ("named", "B")), ("throw c ? e : x", ["e"], ("unknown", None)), ("throw e;", ["e"], ("rethrow", "e")),
        ("throw e", [], ("unknown", None)), ("throw 'x'", [], ("unknown", None)), ("throw (new A())", [], ("unknown", None)), ("throw ]", [], ("unknown", None)), ("return e", ["e"], ("unknown", None)), ("", [], ("unknown", None)),
    ],
)
def test_classify(text, params, want):
    assert classify(text, params) == want


SOURCE = """/** é @throws {A} */
export const outer = async (p: Left | Right) => {
  inner(1)?.go<T>(x);
  const bad: X | Y = make();
  throw bad;
};
/** @throws {B} */
function named() { function nested() { throw new N(); } [1].map(() => { throw q; }); this.m(); o['k'](); new Z(deep()); super.s(); (f)(); }
abstract class C extends Base implements I, J {
  /** @throws {D} */
  abstract shape(): void;
  /** @throws {E} */
  static async run(e: Err) { try { a(); } catch (e) { throw e; } finally { z(); } throw e; }
  constructor() { super(); }
  get g() { return 1; }
  ['x']() { lost(); }
  field = () => { kept(); };
}
interface I extends K { /** @throws {F} */ load(id: string): void; prop: () => void; }
type U = A | B;
import { h as k } from './other';
outside();
"""


def test_facts():
    f = extract("d/f.ts", SOURCE)
    assert f.error is None
    at = {r["fn"]: r["name"] for r in f.functions}
    assert [r["name"] for r in f.functions] == ["outer", "named", "nested", "run", "constructor", "g"]
    data = SOURCE.encode()
    cut = lambda r, a="start", b="end": data[r[a] : r[b]].decode()
    o, n, _, run = f.functions[:4]
    assert cut(o).startswith("async (p: Left") and cut(o, "name_start", "name_end") == "outer" and o["is_async"] and o["comment"] == "/** é @throws {A} */" and o["name_line"] == 2
    assert cut(n).startswith("function named") and run["class_name"] == "C" and cut(run).startswith("(e: Err)") and run["comment"] == "/** @throws {E} */"
    throws = [(at[r["fn"]], r["kind"], r["name"], r["hint"]) for r in f.throws]
    assert throws == [("outer", "named", "X", None), ("outer", "named", "Y", None), ("nested", "named", "N", None), ("named", "unknown", None, None), ("run", "rethrow", "e", None), ("run", "unknown", None, "Err")]
    assert cut(f.throws[0]) == "throw bad;"
    calls = [(at[r["fn"]], r["callee_name"], cut(r, "callee_start", "callee_end")) for r in f.calls]
    assert [c[:2] for c in calls] == [("outer", "go"), ("outer", "inner"), ("outer", "make"), ("named", "map"), ("named", "m"), ("named", "deep"), ("named", "s"), ("run", "a"), ("run", "z")]
    assert all(name == text for _, name, text in calls) and [r["receiver"] for r in f.calls if r["callee_name"] == "m"] == ["this"]
    t = f.tries[0]
    assert cut(t, "try_start", "try_end") == "{ a(); }" and cut(t, "catch_start", "catch_end") == "catch (e) { throw e; }"
    assert [(r["child"], r["parent"], r["kind"]) for r in f.relations] == [("C", "Base", "extends"), ("C", "I", "implements"), ("C", "J", "implements"), ("I", "K", "extends")]
    assert [(r["type_name"], r["method_name"], r["comment"], r["is_abstract"]) for r in f.signatures] == [("C", "shape", "/** @throws {D} */", True), ("I", "load", "/** @throws {F} */", False)]
    assert [(r["alias"], r["member"]) for r in f.aliases] == [("U", "A"), ("U", "B")]
    assert [(r["local"], r["imported"], r["source"]) for r in f.imports] == [("k", "h", "./other")]
