"""Whole runs over small source trees: reports, exit status, fixes, cache, scan, stream."""

import json
import os

import pytest

from faultline import cli
from faultline.api import Analysis, Options
from faultline.sources import scan
from faultline.sources.cache import Store

FILES = {
    "simple.ts": "class Bad extends Error {}\n\nfunction check(x: string) {\n  if (!x) throw new Bad();\n}\n",
    "fine.ts": "/** @throws {Bad} */\nfunction check() { throw new Bad(); }\nfunction quiet() { try { check(); } catch { return; } }\n",
    "lib/errors.ts": "export class Low extends Error {}\nexport function low(): void { throw new Low(); }\nexport function factory(e: Low) { throw e; }\n",
    "use.ts": "import { low as go, factory } from './lib/errors';\nfunction user() { go(); }\n/** @throws {Low} */\nfunction made() { factory(null!); }\n",
    "types.ts": "class Base extends Error {}\nclass Sub extends Base {}\ntype Both = Base | Other;\n/** @throws {Base} */\nfunction a() { throw new Sub(); }\n/** @throws {Sub} */\nfunction b() { throw new Base(); }\n/** @throws {Both} */\nfunction c() { throw new Other(); }\n/** @throws {Base | Other} */\nfunction d() { const x: Both = f(); throw x; }\nclass A1 { find() { throw new Base(); } }\nclass B1 { find() {} }\n/** @throws {Base} */\nfunction e(p: A1, q: B1) { p.find(); }\nfunction g(p: A1, q: B1) { q.find(); }\n",
    "parent.ts": "interface Repo {\n  /** @throws {Gone} */\n  find(): void;\n}\nclass Sql implements Repo {\n  /** @throws {Other} */\n  find() { throw new Other(); }\n}\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    return tmp_path


def run(capsys, spark, *argv):
    status = cli.main([str(a) for a in argv], spark)
    out = capsys.readouterr()
    return status, out.out, out.err


def test_status_and_reports(spark, tree, capsys):
    status, out, _ = run(capsys, spark, "check", tree / "simple.ts")
    start = FILES["simple.ts"].index("throw")
    assert status == 1 and out == (
        f"error: missing @throws declaration\n  --> {tree}/simple.ts:check\n   |\n   | Bad propagates from Span {{ start: {start}, end: {start + 16} }}\n   |\n   = help: add @throws {{Bad}} to function check\n\nFound 1 errors, 0 LSP violations in 1 files\n"
    )
    assert run(capsys, spark, "check", tree / "fine.ts")[:2] == (0, "No issues found in 1 files\n")
    status, out, _ = run(capsys, spark, "check", "-f", "JSON", tree / "parent.ts")
    got = json.loads(out)
    assert status == 1 and got["diagnostics"] == [] and got["summary"] == {"errors": 0, "lsp_violations": 1, "files_checked": 1}
    assert got["lsp_violations"] == [{"file": f"{tree}/parent.ts", "class": "", "method": "find", "illegal_throws": ["Other"], "parent_type": "Repo", "parent_declared_throws": ["Gone"]}]
    status, out, _ = run(capsys, spark, "check", tree / "use.ts")
    assert status == 1 and "function user" in out and "made" not in out and "Low propagates" in out


def test_types(spark, tree):
    names = lambda **o: sorted(d["function"] for d in Analysis(spark, [str(tree / "types.ts")], options=Options(**o)).findings()[0])
    assert names() == ["b", "find"]
    assert names(types="exact") == ["a", "b", "c", "d", "find"]


def test_errors(spark, tree, capsys):
    assert run(capsys, spark, "check", tree / "none")[0] == 2 and "none" in run(capsys, spark, "fix", tree / "none")[2]
    assert run(capsys, spark, "check", "-f", "yaml", tree)[0] == 2
    (tree / "broken.ts").write_text("function (")
    status, _, err = run(capsys, spark, "check", tree / "broken.ts")
    assert status == 2 and "broken.ts" in err
    assert run(capsys, spark)[:2] == (0, "Use --help for usage information\n")
    (tree / "empty").mkdir()
    assert run(capsys, spark, "check", tree / "empty")[:2] == (0, "No TypeScript files found\n")


BODY = 'function check(x: string) {\n  throw new Bad();\n}\n'
ENTRY = "@throws {Bad} from test.ts:check"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (BODY, f"/**\n * {ENTRY}\n */\n{BODY}"),
        (f"/**\n * Words.\n */\n{BODY}", f"/**\n * Words.\n  * {ENTRY}\n  */\n{BODY}"),
        (f"/** Words. */\n\n{BODY}", f"/** Words.\n * {ENTRY}\n */\n\n{BODY}"),
        (f"/* plain */\n{BODY}", f"/* plain */\n/**\n * {ENTRY}\n */\n{BODY}"),
        (chr(0xFEFF) + BODY, f"{chr(0xFEFF)}/**\n * {ENTRY}\n */\n{BODY}"),
        (BODY.replace("\n", "\r\n"), f"/**\n * {ENTRY}\n */\n{BODY}".replace("\n", "\r\n")),
        (BODY.rstrip("\n"), f"/**\n * {ENTRY}\n */\n{BODY}".rstrip("\n")),
        (f"// é日本\n{BODY}", f"// é日本\n/**\n * {ENTRY}\n */\n{BODY}"),
        (f"/** @throws {{Bad}} */\n{BODY}", None),
    ],
)
def test_fix(spark, tmp_path, capsys, before, after):
    f = tmp_path / "test.ts"
    f.write_bytes(before.encode())
    status, out, _ = run(capsys, spark, "fix", f)
    assert (status, out) == (0, f"Fixed {int(after is not None)} file(s)\n")
    assert f.read_bytes() == (after or before).encode()
    if after:
        assert run(capsys, spark, "check", f)[0] == 0


def test_scan(tmp_path):
    for p in ("a.ts", "b.tsx", "c.mts", "d.cts", "e.TS", "f.ts.bak", ".h.ts", "_g.ts", "sub/i.ts", "node/skip.ts", "sub/k.test.ts", ".hid/l.ts", "empty.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("" if p == "empty.ts" else "let a = 1;")
    (tmp_path / ".gitignore").write_text("# note\nnode/\n")
    names = lambda *a, **k: [os.path.relpath(f, tmp_path) for f in scan.list_sources([str(tmp_path)], *a, **k)]
    assert names() == ["_g.ts", "a.ts", "b.tsx", "c.mts", "d.cts", "empty.ts", "sub/i.ts", "sub/k.test.ts"]
    assert names(["**/*.test.ts", "**/{a,b}.*", "*/[!a-z]g.ts"]) == ["c.mts", "d.cts", "empty.ts", "sub/i.ts"]
    assert names(max_files=2) == ["_g.ts", "a.ts"]
    twice = scan.list_sources([str(tmp_path / "a.ts"), str(tmp_path / "sub" / ".." / "a.ts")])
    assert len(twice) == 1
    for bad in ("[a", "{a"):
        with pytest.raises(scan.ScanError):
            names([bad])


def test_cache(spark, tree, tmp_path):
    folder = str(tmp_path / "store")
    run = lambda: [d["function"] for d in Analysis(spark, [str(tree / "simple.ts")], options=Options(cache_dir=folder)).findings()[0]]
    assert run() == ["check"] == run()
    (tree / "simple.ts").write_text("function other() { throw new Bad(); }")
    assert run() == ["other"]
    s = Store.load(spark, folder, "faultline-1", "elsewhere")
    assert set(s.tables) == {"files"} and s.save() and not s.save()
    with open(os.path.join(folder, "current.json"), "w") as f:
        f.write("{")
    assert Store.load(spark, folder, "faultline-1", "x").tables == {}
    a = spark.createDataFrame([("k", "1"), ("l", "1")], "key string, fingerprint string")
    s = Store(spark, str(tmp_path / "other"), "t", "w")
    s.update("diagnostics", a, ["key"])
    s.update("diagnostics", spark.createDataFrame([("k", "2")], "key string, fingerprint string"), ["key"])
    assert s.save() and {tuple(r) for r in Store.load(spark, s.folder, "t", "w").get("diagnostics").collect()} == {("k", "2"), ("l", "1")}
    assert Store.load(spark, s.folder, "t2", "w").tables == {}


def test_stream(spark, tree, tmp_path):
    from faultline.streaming.incremental import current, follow

    target, mark = str(tmp_path / "facts"), str(tmp_path / "mark")
    follow(spark, str(tree), target, mark).awaitTermination()
    assert current(spark, target).count() == len(FILES)
    (tree / "new.ts").write_text("function n() { throw new Bad(); }")
    follow(spark, str(tree), target, mark).awaitTermination()
    rows = current(spark, target).collect()
    assert len(rows) == len(FILES) + 1 and sum(len(r.functions) for r in rows if r.path.endswith("new.ts")) == 1


def test_no_cap_on_files_by_default(spark, tmp_path):
    for i in range(1001):
        (tmp_path / f"f{i}.ts").write_text("")
    assert len(Analysis(spark, [str(tmp_path)]).files) == 1001
