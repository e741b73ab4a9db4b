"""Registered queries against their SQL in DuckDB, and the entry module without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["throw_sites", "rethrow_blocks", "uncaught_direct", "caught_direct", "throws_in_blocks", "call_edges", "propagated_set", "missing_declarations", "type_ancestors", "lsp_violations", "resolve_coalesce", "doc_throws_parse", "offset_line_col", "jsdoc_locate", "help_types", "stale_diagnostics", "fix_line_rewrite", "extract_throws", "fixed_sources", "edge_pass", "extract_methods", "extract_scopes", "extract_switches", "scopes_uncaught", "scan_listing", "scan_contents", "config_references", "config_closure", "resolution_fingerprint", "dep_fingerprint", "definition_hits", "type_check_through", "workspace_change", "whole_runs"]


def test_every_query_has_sql_or_is_named():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(SOME) <= set(o)
    assert all(k.startswith(("op", "pipeline")) for k in set(q) - set(o))


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    want = sorted(repr(plain([row[columns.index(c)] for c in sorted(columns)])) for row in r.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(plain(list(row))) for row in df.select(*sorted(df.columns)).collect()) == want


def test_entry_without_the_subpackage(tmp_path):
    """The core imports, and has its queries, where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith(('faultline.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 40 and not [q for q in e.queries() if q.startswith('op')]\n"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_a_missing_dependency_leaves_the_core(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys\nclass No:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'regex':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 40\n"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
