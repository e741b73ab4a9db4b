"""Named queries over the test tables, each with its SQL counterpart (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import docs, text
from ..operators import catching, declarations, graph, propagation, resolution
from ..operators.typing import StructuralResolver
from ..operators.fingerprint import closure_fingerprints
from ..sources import config, scan
from .facts import CLOSURE, load, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# facts


@query(sql("SELECT fn, s AS start, e AS \"end\", kind, name FROM throws"))
def throw_sites(spark, d):
    return load(spark, d).throws


@query(sql("SELECT fn, block_no, ts AS try_start, te AS try_end, cs AS catch_start, ce AS catch_end, ct AS caught FROM tries"))
def try_blocks(spark, d):
    return load(spark, d).tries.withColumn("caught", F.get("caught_types", F.lit(0))).drop("caught_types")


@query(sql("SELECT fn, block_no, rethrows FROM flagged"))
def rethrow_blocks(spark, d):
    f = load(spark, d)
    return catching.with_rethrow_flag(f.tries, f.throws).select("fn", "block_no", "rethrows")


@query(sql("SELECT fn, s AS start, kind, name FROM direct"))
def uncaught_direct(spark, d):
    f = load(spark, d)
    return f.direct.select("fn", "start", "kind", "name")


@query(sql("SELECT t.fn, t.s AS start, t.name FROM throws t WHERE t.kind <> 'rethrow' AND EXISTS (SELECT 1 FROM catchers c WHERE c.fn = t.fn AND t.s >= c.ts AND t.s < c.te AND (c.ct IS NULL OR (t.kind = 'named' AND c.ct = t.name)))"))
def caught_direct(spark, d):
    f = load(spark, d)
    return catching.caught_at(f.throws.withColumn("pos", F.col("start")), f.catch, "left_semi").select("fn", "start", "name")


@query(sql("SELECT t.fn, t.s AS start, CAST(count(*) AS BIGINT) AS blocks FROM throws t JOIN tries c ON c.fn = t.fn AND t.s >= c.ts AND t.s < c.te GROUP BY ALL"))
def throws_in_blocks(spark, d):
    """The interval join itself: how many try blocks hold each throw."""
    f = load(spark, d)
    w = catching.bin_width(f.tries, "try_start", "try_end")
    b = catching.binned(f.tries, w).select("fn", "bin", "try_start", "try_end")
    p = f.throws.select("fn", "start", F.floor(F.col("start") / w).alias("bin"))
    return p.join(b, ["fn", "bin"]).where(catching.contains(F.col("try_start"), F.col("try_end"), F.col("start"))).groupBy("fn", "start").agg(F.count("*").alias("blocks"))


# graph


def _edges(f):
    return f.sites


@query(sql("SELECT caller, callee, CAST(count(*) AS BIGINT) AS n_sites, CAST(min(s) AS BIGINT) AS first_site, CAST(max(s) AS BIGINT) AS last_site FROM calls WHERE caller IN (SELECT fn FROM functions) AND callee IN (SELECT fn FROM functions) GROUP BY ALL"))
def call_edges(spark, d):
    f = load(spark, d)
    e = graph.call_edges(f.calls, f.functions)
    return e.select("caller", "callee", F.size("sites").cast("long").alias("n_sites"), F.col("sites")[0]["start"].alias("first_site"), F.element_at("sites", -1)["start"].alias("last_site"))


@query(sql("SELECT caller, callee, s AS start FROM calls WHERE caller IN (SELECT fn FROM functions) AND callee IN (SELECT fn FROM functions)"))
def call_sites(spark, d):
    f = load(spark, d)
    return graph.sites_of(graph.call_edges(f.calls, f.functions)).select("caller", "callee", "start")


@query(sql("SELECT caller, callee FROM edges"))
def callees(spark, d):
    return graph.callees(_edges(load(spark, d)))


@query(sql("SELECT root, fn FROM reach", "reach(root, fn) AS (SELECT caller, callee FROM edges UNION SELECT r.root, e.callee FROM reach r JOIN edges e ON e.caller = r.fn)"))
def transitive_callees(spark, d):
    return graph.reachable(_edges(load(spark, d)))


@query(sql("SELECT DISTINCT a.root, e.caller, e.callee FROM (SELECT root, fn FROM reach UNION SELECT fn, fn FROM functions) a JOIN edges e ON e.caller = a.fn", "reach(root, fn) AS (SELECT caller, callee FROM edges UNION SELECT r.root, e.callee FROM reach r JOIN edges e ON e.caller = r.fn)"))
def reachable_edges(spark, d):
    return graph.reachable_edges(_edges(load(spark, d)))


def _blocked(f):
    return f.blocked


@query(sql("SELECT p.caller, p.callee, p.kind, p.name FROM edge_pass p JOIN (SELECT DISTINCT fn, kind, name FROM direct) x ON x.fn = p.callee AND x.kind = p.kind AND x.name IS NOT DISTINCT FROM p.name"))
def edge_pass(spark, d):
    """Which direct errors of the callee an edge lets pass."""
    f = load(spark, d)
    direct = f.direct.select(F.col("fn"), "kind", "name").distinct().withColumn("callee0", F.col("fn"))
    up = propagation.passing(direct, graph.callees(_edges(f)), _blocked(f))
    return up.select(F.col("fn").alias("caller"), F.col("callee0").alias("callee"), "kind", "name")


# propagation and declarations


def _propagated(f):
    direct = f.direct
    return propagation.propagate(direct, _edges(f), _blocked(f), ["fn", "kind", "name"])


@query(sql("SELECT fn, kind, name FROM closure", CLOSURE))
def propagated_set(spark, d):
    return _propagated(load(spark, d)).select("fn", "kind", "name")


@query(sql("SELECT fn, kind, name, CAST(min(depth) AS INTEGER) AS depth FROM steps GROUP BY ALL", "steps(fn, kind, name, depth) AS (SELECT DISTINCT fn, kind, name, 0 FROM direct UNION SELECT p.caller, c.kind, c.name, c.depth + 1 FROM steps c JOIN edge_pass p ON p.callee = c.fn AND p.kind = c.kind AND p.name IS NOT DISTINCT FROM c.name WHERE c.depth < 2)"))
def propagated_depth2(spark, d):
    """What reaches each function over at most two calls, with the least number of calls."""
    f = load(spark, d)
    return propagation.propagate(f.direct, _edges(f), _blocked(f), ["fn", "kind", "name"], most=2)


_PATHS = """
hops(fn, origin, start, kind, name, path, depth) AS (SELECT fn, fn, s, kind, name, CAST([] AS BIGINT[]), 0 FROM direct
  UNION ALL SELECT p.caller, h.origin, h.start, h.kind, h.name, list_prepend(p.caller, h.path), h.depth + 1 FROM hops h JOIN edge_pass p ON p.callee = h.fn AND p.kind = h.kind AND p.name IS NOT DISTINCT FROM h.name
  WHERE h.depth < 2 AND p.caller <> h.origin AND NOT list_contains(h.path, p.caller))
"""


@query(sql("SELECT fn, origin, start, kind, name, array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM hops", _PATHS))
def propagated_paths(spark, d):
    """Every way of every throw over at most two calls, with multiplicity."""
    f = load(spark, d)
    direct = f.direct.select("fn", "start", "kind", "name")
    p = propagation.paths(direct, _edges(f), _blocked(f), 2)
    return p.select("fn", "origin", "start", "kind", "name", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


@query(sql("SELECT c.fn, c.kind, c.name FROM closure c WHERE NOT (c.kind = 'named' AND EXISTS (SELECT 1 FROM declared x WHERE x.fn = c.fn AND x.error_type = c.name))", CLOSURE))
def missing_declarations(spark, d):
    """The flagship: errors that leave a function, by itself or through calls, and that it doesn't declare."""
    f = load(spark, d)
    return declarations.missing_declarations(_propagated(f).select("fn", "kind", "name"), f.declared)


_TREE = [("E0", "E1"), ("E1", "E2"), ("E3", "E4"), ("E5", "E2"), ("E6", "E5")]
_TREE_SQL = "tree(child, parent) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TREE) + "), up(t, a) AS (SELECT child, parent FROM tree UNION SELECT u.t, x.parent FROM up u JOIN tree x ON x.child = u.a)"


@query(sql("SELECT c.fn, c.kind, c.name FROM closure c WHERE NOT (c.kind = 'named' AND EXISTS (SELECT 1 FROM declared x WHERE x.fn = c.fn AND (x.error_type = c.name OR EXISTS (SELECT 1 FROM up WHERE up.t = c.name AND up.a = x.error_type))))", CLOSURE, _TREE_SQL))
def missing_structural(spark, d):
    """Missing declarations where a declared ancestor covers its descendants."""
    f = load(spark, d)
    tree = spark.createDataFrame(_TREE, "child string, parent string")
    return declarations.missing_declarations(_propagated(f).select("fn", "kind", "name"), f.declared, StructuralResolver(tree))


@query(sql("SELECT c.fn, c.kind, c.name FROM (SELECT DISTINCT fn, kind, name FROM direct) c WHERE NOT (c.kind = 'unknown' AND c.fn IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AND NOT (c.kind = 'named' AND EXISTS (SELECT 1 FROM declared x WHERE x.fn = c.fn AND x.error_type = c.name))"))
def unknown_declared(spark, d):
    """Some functions declare ``unknown``, which covers their unknown errors."""
    f = load(spark, d)
    extra = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("fn"), F.lit("unknown").alias("error_type"))
    return declarations.missing_declarations(f.direct.select("fn", "kind", "name").distinct(), f.declared.unionByName(extra))


@query(sql("SELECT DISTINCT c.fn, CASE WHEN c.kind = 'unknown' AND c.s % 3 = 0 THEN 'named' ELSE c.kind END AS kind, CASE WHEN c.kind = 'unknown' AND c.s % 3 = 0 THEN 'E1' ELSE c.name END AS name FROM direct c WHERE NOT EXISTS (SELECT 1 FROM declared x WHERE x.fn = c.fn AND x.error_type = CASE WHEN c.kind = 'unknown' AND c.s % 3 = 0 THEN 'E1' ELSE c.name END) OR c.kind = 'rethrow'"))
def unknown_resolved(spark, d):
    """Unknown errors whose type is known at their origin count as named."""
    f = load(spark, d)
    direct = f.direct
    known = direct.where("kind = 'unknown' and start % 3 = 0").select("fn", "start", F.lit("E1").alias("type"))
    none = spark.createDataFrame([], "child string, parent string")
    p = direct.select("fn", "kind", "name", F.col("fn").alias("origin_fn"), F.col("start").alias("origin_start"))
    return declarations.missing_declarations(p, f.declared, StructuralResolver(none, known=known)).select("fn", "kind", "name").distinct()


# type hierarchy: suppliers implement nations, nations extend regions


def _hierarchy(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return s.unionByName(n)


_HIER = "rel(child, parent) AS (SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), anc(t, a, depth) AS (SELECT child, parent, 1 FROM rel UNION SELECT x.t, r.parent, x.depth + 1 FROM anc x JOIN rel r ON r.child = x.a)"


@query("WITH RECURSIVE " + _HIER + " SELECT t AS type, a AS ancestor, CAST(depth AS INTEGER) AS depth FROM anc")
def type_ancestors(spark, d):
    return graph.ancestors(_hierarchy(spark, d))


def _signatures(spark, d):
    """Every part declares a method of a nation or a region."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("R"), F.col("p_size") % 5)).otherwise(F.concat(F.lit("N"), F.col("p_size") % 25))
    return p.select(kind.alias("type_name"), F.concat(F.lit("m"), F.col("p_partkey") % 4).alias("method_name"), F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), F.col("p_partkey") % 7))).alias("declared"), F.col("p_partkey").alias("ordinal"))


_SIG = "sigs AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'R' || (p_size % 5) ELSE 'N' || (p_size % 25) END AS type_name, 'm' || (p_partkey % 4) AS method_name, CASE WHEN p_partkey % 5 <> 0 THEN 'E' || (p_partkey % 7) END AS decl, p_partkey AS ordinal FROM part), lastsig AS (SELECT * FROM sigs QUALIFY row_number() OVER (PARTITION BY type_name, method_name ORDER BY ordinal DESC) = 1)"


@query("WITH " + _SIG + " SELECT type_name, method_name, decl, ordinal FROM lastsig")
def method_lookup_last(spark, d):
    return declarations.last_signature(_signatures(spark, d)).select("type_name", "method_name", F.get("declared", F.lit(0)).alias("decl"), "ordinal")


_METHODS = "meth AS (SELECT DISTINCT s_suppkey AS fn, 'S' || s_suppkey AS class_name, 'm' || (s_suppkey % 4) AS method_name FROM supplier), thrown AS (SELECT DISTINCT user_id AS fn, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'named' END AS kind, CASE WHEN event_id % 11 <> 0 THEN 'E' || (event_id % 7) END AS name FROM events WHERE event_type = 'error')"


@query("WITH RECURSIVE " + ", ".join([_HIER, _SIG, _METHODS]) + " SELECT DISTINCT m.fn, l.type_name AS parent_type, m.method_name, t.kind, t.name FROM meth m JOIN (SELECT DISTINCT t, a FROM anc) x ON x.t = m.class_name JOIN lastsig l ON l.type_name = x.a AND l.method_name = m.method_name JOIN thrown t ON t.fn = m.fn WHERE (t.kind = 'named' AND t.name IS DISTINCT FROM l.decl) OR (t.kind <> 'named' AND l.decl IS NULL)")
def lsp_violations(spark, d):
    """Methods that throw what the same method of an ancestor doesn't declare."""
    methods = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fn"), F.concat(F.lit("S"), "s_suppkey").alias("class_name"), F.concat(F.lit("m"), F.col("s_suppkey") % 4).alias("method_name"))
    e = table(spark, d, "events").where("event_type = 'error'")
    unknown = F.col("event_id") % 11 == 0
    thrown = e.select(F.col("user_id").alias("fn"), F.when(unknown, "unknown").otherwise("named").alias("kind"), F.when(~unknown, F.concat(F.lit("E"), F.col("event_id") % 7)).alias("name")).distinct()
    return declarations.substitution_violations(methods, thrown, _hierarchy(spark, d), _signatures(spark, d))


# call resolution: orders are calls, customers definitions


def _definitions(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("fn"), F.concat(F.lit("f"), F.col("c_nationkey")).alias("file"), F.concat(F.lit("g"), F.col("c_custkey") % 40).alias("name"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 9).alias("end"), (F.col("c_custkey") % 97).alias("name_line"), (F.col("c_custkey") % 3 > 0).alias("has_body"))


def _calls(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("call"), F.concat(F.lit("f"), F.col("o_custkey") % 25).alias("file"), F.concat(F.lit("g"), F.col("o_orderkey") % 53).alias("callee_name"), F.col("o_orderkey").alias("callee_start"), (F.col("o_orderstatus") == "F").alias("resolved"))


def _targets(spark, d):
    return _calls(spark, d).where("resolved").select("file", "callee_start", F.concat(F.lit("f"), F.col("call") % 25).alias("def_file"), (F.col("call") % 97).alias("def_line"))


_RESOLVE = """defs AS (SELECT c_custkey AS fn, 'f' || c_nationkey AS file, 'g' || (c_custkey % 40) AS name, c_custkey * 10 AS start, c_custkey % 97 AS line, c_custkey % 3 > 0 AS has_body FROM customer),
calls AS (SELECT o_orderkey AS call, 'f' || (o_custkey % 25) AS file, 'g' || (o_orderkey % 53) AS callee_name, o_orderstatus = 'F' AS resolved FROM orders),
exact AS (SELECT c.call, max_by(f.fn, f.start) AS callee FROM calls c JOIN defs f ON c.resolved AND f.file = 'f' || (c.call % 25) AND f.line = c.call % 97 GROUP BY c.call),
firsts AS (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY has_body DESC, start) = 1),
fallback AS (SELECT c.call, f.fn AS callee FROM calls c JOIN firsts f ON f.file = c.file AND f.name = c.callee_name)"""


@query("WITH " + _RESOLVE + " SELECT call, callee FROM exact")
def resolve_by_line(spark, d):
    return resolution.by_line(_calls(spark, d), _targets(spark, d), _definitions(spark, d)).select("call", "callee")


@query("WITH " + _RESOLVE + " SELECT call, callee FROM fallback")
def resolve_fallback(spark, d):
    return resolution.by_name(_calls(spark, d), _definitions(spark, d)).select("call", "callee")


@query("WITH " + _RESOLVE + " SELECT c.call, coalesce(e.callee, f.callee) AS callee FROM calls c LEFT JOIN exact e USING (call) LEFT JOIN fallback f USING (call) WHERE coalesce(e.callee, f.callee) IS NOT NULL")
def resolve_coalesce(spark, d):
    return resolution.resolve(_calls(spark, d), _targets(spark, d), _definitions(spark, d), ["call"]).select("call", "callee")


# doc comments and texts, built from parts


def _doc(c):
    return F.concat(F.lit("/**\n * About it\n * @throws {"), F.col("p_brand"), F.when(c("p_size") % 3 == 0, F.concat(F.lit(" | "), "p_type", F.lit(" |"))).otherwise(F.lit("")), F.lit("}"), F.when(c("p_size") % 2 == 0, F.concat(F.lit(" when "), "p_name")).otherwise(F.lit("")), F.when(c("p_size") % 5 < 2, F.concat(F.lit(" from src/"), "p_type", F.lit(".ts:f"), "p_size")).otherwise(F.lit("")), F.lit("\n * @throws Plain"), F.when(c("p_size") % 7 == 0, F.lit(" with words")).otherwise(F.lit("")), F.lit("\n * @throws {Open\n */"))


_DOC = "parts AS (SELECT p_partkey, p_brand, p_type, p_name, p_size, p_size % 3 = 0 AS two, p_size % 2 = 0 AS told, p_size % 5 < 2 AS origin FROM part)"
_DOC_ROWS = """rows AS (SELECT p_partkey, p_brand AS type_name, CASE WHEN told THEN 'when ' || p_name END AS description, CASE WHEN origin THEN 'src/' || p_type || '.ts' END AS from_file, CASE WHEN origin THEN 'f' || p_size END AS from_func FROM parts
UNION ALL SELECT p_partkey, p_type, CASE WHEN told THEN 'when ' || p_name END, CASE WHEN origin THEN 'src/' || p_type || '.ts' END, CASE WHEN origin THEN 'f' || p_size END FROM parts WHERE two
UNION ALL SELECT p_partkey, 'Plain', CASE WHEN p_size % 7 = 0 THEN 'with words' END, NULL, NULL FROM parts)"""


def _declared_in_docs(spark, d):
    p = table(spark, d, "part").select("p_partkey", _doc(F.col).alias("comment"))
    return p.select("p_partkey", F.inline(docs.declarations(F.col("comment"))))


@query("WITH " + ", ".join([_DOC, _DOC_ROWS]) + " SELECT * FROM rows")
def doc_throws_parse(spark, d):
    return _declared_in_docs(spark, d)


@query("WITH " + ", ".join([_DOC, _DOC_ROWS]) + " SELECT type_name, CAST(count(*) AS BIGINT) AS n FROM rows GROUP BY type_name")
def doc_union_split(spark, d):
    return _declared_in_docs(spark, d).groupBy("type_name").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name || ' from here' WHEN p_size % 4 = 1 THEN p_name ELSE p_name || ' from nowhere at all' END AS description, CASE WHEN p_size % 4 = 1 THEN 'a:b.ts' END AS from_file, CASE WHEN p_size % 4 = 1 THEN 'f' || p_size END AS from_func FROM part")
def doc_from_clause(spark, d):
    x = F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit(" from here"))).when(F.col("p_size") % 4 == 1, F.concat("p_name", F.lit(" from a:b.ts:f"), "p_size", F.lit(" and so on"))).otherwise(F.concat("p_name", F.lit(" from nowhere at all")))
    return table(spark, d, "part").select("p_partkey", docs.origin(x).alias("o")).select("p_partkey", "o.*")


@query("SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 1) THEN 'named' WHEN p_size % 5 = 2 THEN 'rethrow' ELSE 'unknown' END AS kind, CASE WHEN p_size % 5 = 0 THEN p_type WHEN p_size % 5 = 1 THEN 'make' || p_type || 'Error' WHEN p_size % 5 = 2 THEN 'e' END AS name FROM part")
def throw_classify_text(spark, d):
    k = F.col("p_size") % 5
    x = F.when(k == 0, F.concat(F.lit("throw new "), "p_type", F.lit("('"), "p_name", F.lit("');"))).when(k == 1, F.concat(F.lit("throw make"), "p_type", F.lit("Error(1)"))).when(k == 2, F.lit("throw e;")).when(k == 3, F.lit("throw new ns.Failure()")).otherwise(F.lit("throw other"))
    return table(spark, d, "part").select("p_partkey", text.thrown_text(x, F.array(F.lit("e"))).alias("t")).select("p_partkey", "t.*")


_TEXT = "docs AS (SELECT doc_id, coalesce(text, '') AS t, encode(coalesce(text, '')) AS b FROM documents), mids AS (SELECT doc_id, t, length(t) // 2 AS half FROM docs)"


@query("WITH " + _TEXT + " SELECT doc_id, CAST(octet_length(encode(left(t, half))) AS BIGINT) AS at_byte, CAST(1 + length(left(t, half)) - length(replace(left(t, half), chr(10), '')) AS INTEGER) AS line, CAST(1 + length(list_last(string_split(left(t, half), chr(10)))) AS INTEGER) AS col FROM mids")
def offset_line_col(spark, d):
    """Line and column of the byte offset in the middle of each whole text."""
    t = F.coalesce("text", F.lit(""))
    half = F.octet_length(F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))).cast("long")
    rows = table(spark, d, "documents").select("doc_id", t.alias("t"), half.alias("at_byte"))
    return rows.select("doc_id", "at_byte", text.line_of(F.col("t"), F.col("at_byte").cast("int")).alias("line"), text.column_of(F.col("t"), F.col("at_byte").cast("int")).alias("col"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/** ' || p_name || ' */' END AS comment FROM part")
def jsdoc_locate(spark, d):
    """The doc comment right before a function, if there is one."""
    head = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/** other */ x;\n/** "), "p_name", F.lit(" */\n  "))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/** "), "p_name", F.lit(" */\nlet é = 1;\n"))).otherwise(F.lit("// none\n"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(head, F.lit("function f() {}")).alias("t"), F.octet_length(head).alias("at"))
    return rows.select("p_partkey", text.preceding_doc(F.col("t"), F.col("at")).alias("comment"))


# scans, filters, reports and cache tables, on the urls of pages and on the facts


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/en/.*$') AND NOT regexp_matches(url, '^.*page=.*$')")
def glob_exclude(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return p.where(~scan.not_excluded(F.col("url"), ["**/en/*"])).where(scan.not_excluded(F.col("url"), ["*page=*"]))


_FILE = "files AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_size % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mts' WHEN 3 THEN '.cts' WHEN 4 THEN '.TS' ELSE '.ts.bak' END AS path FROM part)"


def _files(spark, d):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".mts", ".cts", ".TS", ".ts.bak")]), F.col("p_size") % 6 + 1)
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ends).alias("path"))


@query("WITH " + _FILE + " SELECT * FROM files WHERE path LIKE '%.ts' OR path LIKE '%.tsx' OR path LIKE '%.mts' OR path LIKE '%.cts'")
def ext_filter(spark, d):
    return _files(spark, d).where(scan.is_source(F.col("path")))


@query(sql("SELECT fn, kind, name FROM closure WHERE fn IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", CLOSURE))
def entry_semi(spark, d):
    """Results for entry files only."""
    entry = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("fn"))
    return _propagated(load(spark, d)).select("fn", "kind", "name").join(entry, "fn", "left_semi")


_MISSING = "missing AS (SELECT c.fn, c.kind, c.name FROM closure c WHERE NOT (c.kind = 'named' AND EXISTS (SELECT 1 FROM declared x WHERE x.fn = c.fn AND x.error_type = c.name)))"


@query(sql("SELECT CAST((SELECT count(*) FROM missing) AS BIGINT) AS errors, CAST((SELECT count(DISTINCT fn) FROM missing) AS BIGINT) AS functions_with_errors, CAST((SELECT count(*) FROM functions) AS BIGINT) AS files_checked", CLOSURE, _MISSING))
def report_summary(spark, d):
    f = load(spark, d)
    checked = f.functions.count()
    return missing_declarations(spark, d).agg(F.count("*").alias("errors"), F.countDistinct("fn").alias("functions_with_errors"), F.lit(checked).cast("long").alias("files_checked"))


@query(sql("SELECT fn, '{\"error_type\":\"' || coalesce(name, 'Unknown') || '\",\"origin_file\":\"\"}' AS json FROM missing WHERE kind <> 'rethrow'", CLOSURE, _MISSING))
def report_json_rows(spark, d):
    m = missing_declarations(spark, d).where("kind != 'rethrow'")
    return m.select("fn", F.to_json(F.struct(F.coalesce("name", F.lit("Unknown")).alias("error_type"), F.lit("").alias("origin_file"))).alias("json"))


@query(sql("SELECT fn, string_agg(label, ', ' ORDER BY s, label) AS types FROM (SELECT fn, s, label, lag(label) OVER (PARTITION BY fn ORDER BY s, label) AS was FROM (SELECT fn, s, coalesce(name, 'unknown') AS label FROM direct)) WHERE was IS NULL OR was <> label GROUP BY fn"))
def help_types(spark, d):
    """Types in order of place, equal neighbours once."""
    f = load(spark, d)
    rows = f.direct.withColumn("label", F.coalesce("name", F.lit("unknown")))
    return declarations.help_types(rows, ["fn"], ["start", "label"])


@query(sql("SELECT fn, '@throws {' || coalesce(CASE WHEN kind <> 'unknown' THEN name END, 'unknown') || '} from f' || (fn % 10) || '.ts:fn' || fn AS entry FROM missing", CLOSURE, _MISSING))
def fix_entries(spark, d):
    from ..sinks import entry_text

    m = missing_declarations(spark, d)
    path = F.concat(F.lit("src/f"), F.col("fn") % 10, F.lit(".ts"))
    return m.select("fn", entry_text(F.col("kind"), F.col("name"), path, F.concat(F.lit("fn"), "fn")).alias("entry"))


@query(sql("SELECT 'f' || (fn % 10) AS file, CAST(count(*) AS BIGINT) AS n, string_agg(fn || ':' || coalesce(name, 'unknown'), ',' ORDER BY fn, coalesce(name, 'unknown')) AS items FROM missing GROUP BY 1", CLOSURE, _MISSING))
def group_by_file(spark, d):
    m = missing_declarations(spark, d).select(F.concat(F.lit("f"), F.col("fn") % 10).alias("file"), "fn", F.coalesce("name", F.lit("unknown")).alias("label"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("fn", "label"))), lambda x: F.concat(x["fn"].cast("string"), F.lit(":"), x["label"]))
    return m.groupBy("file").agg(F.count("*").alias("n"), F.array_join(items, ",").alias("items"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS content_hash FROM pages")
def content_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("content_hash"))


def _cached(spark, d):
    """A cache that holds an older state: pages whose number is divisible by 3 have changed, by 5 are new."""
    p = content_hash(spark, d)
    return p.where("page_id % 5 != 0").select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))


@query("SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 <> 0")
def cache_hits(spark, d):
    from ..sources.cache import hits

    return hits(content_hash(spark, d).withColumnRenamed("page_id", "path"), _cached(spark, d)).select(F.col("path").alias("page_id"))


@query("SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0")
def cache_misses(spark, d):
    from ..sources.cache import misses

    return misses(content_hash(spark, d).withColumnRenamed("page_id", "path"), _cached(spark, d)).select(F.col("path").alias("page_id"))


def _digest(group: str, part: str, source: str, name: str = "fingerprint") -> str:
    """SQL of operators.fingerprint."""
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(sha256({part}), {15 * k + 1}, 15) AS UBIGINT)) AS VARCHAR)" for k in range(4))
    return f"SELECT {group}, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {sums})) AS {name} FROM {source} GROUP BY {group}"


_REACH = "reach(root, fn) AS (SELECT caller, callee FROM edges UNION SELECT r.root, e.callee FROM reach r JOIN edges e ON e.caller = r.fn)"
_FACTS = "fact AS (SELECT fn, kind || '/' || coalesce(name, '') || '/' || s AS fact FROM throws), own AS (" + _digest("fn", "fact", "fact", "facts") + "), below AS (" + _digest("root", "r.fn || ':' || coalesce(facts, '')", "(SELECT root, fn FROM reach UNION SELECT fn, fn FROM functions) r LEFT JOIN own ON own.fn = r.fn", "below") + ")"


@query(sql("SELECT root AS fn, sha256('mode:' || below) AS fingerprint FROM below", _REACH, _FACTS))
def dep_fingerprint(spark, d):
    """What a function's result depends on: its own facts and those of all it reaches."""
    f = load(spark, d)
    roots = f.functions.withColumnRenamed("fn", "root")
    fact = F.concat("kind", F.lit("/"), F.coalesce("name", F.lit("")), F.lit("/"), F.col("start").cast("string"))
    return closure_fingerprints(_edges(f), roots, f.throws.select("fn", fact.alias("fact")), "mode")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 0 AND l_returnflag = 'R')")
def stale_diagnostics(spark, d):
    """Cached diagnostics still valid: the fingerprint matches and no type check they used has changed."""
    from ..sources.cache import valid_diagnostics

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    cached = o.withColumn("fingerprint", F.when(F.col("key") % 4 == 0, F.lit("old")).otherwise(F.lit("new")))
    deps = table(spark, d, "lineitem").where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("key"), F.col("l_partkey").cast("string").alias("path"), F.col("l_returnflag").alias("content_hash"))
    now = deps.select("path", F.when(F.col("content_hash") == "R", F.lit("changed")).otherwise(F.col("content_hash")).alias("h"), F.col("content_hash").alias("was")).distinct()
    current = now.select(F.concat("path", F.lit("/"), "was").alias("path"), F.col("h").alias("content_hash")).distinct()
    deps = deps.select("key", F.concat("path", F.lit("/"), "content_hash").alias("path"), "content_hash")
    return valid_diagnostics(cached, o.withColumn("fingerprint", F.lit("new")), deps, current).select("key")


@query(sql("SELECT fn, CAST(min(depth) AS INTEGER) AS depth FROM found GROUP BY fn", "found(fn, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.callee, f.depth + 1 FROM found f JOIN edges e ON e.caller = f.fn WHERE f.depth < 10)"))
def discovery_bfs(spark, d):
    """Files found from an entry file by following calls, in rounds; at most ten."""
    from ..sources.discovery import discover

    e = graph.callees(_edges(load(spark, d))).toDF("path", "target")
    return discover(spark.createDataFrame([(0,)], "path long"), e, 10).select(F.col("path").alias("fn"), "depth")


_CONFIGS = """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_size % 5 AS kind, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS j FROM part),
refs AS (SELECT '/w/p' || k || '/tsconfig.json' AS path, CASE WHEN kind = 4 THEN 'references' ELSE 'extends' END AS kind,
  CASE kind WHEN 0 THEN '../p' || j || '/tsconfig' WHEN 1 THEN '../none' || k || '.json' WHEN 2 THEN '@x/base' WHEN 3 THEN '<non-string>' ELSE '../p' || j END AS reference,
  CASE WHEN kind IN (0, 4) AND j IN (SELECT k FROM c) THEN '/w/p' || j || '/tsconfig.json' END AS target,
  CASE WHEN kind IN (0, 4) AND j IN (SELECT k FROM c) THEN NULL WHEN kind IN (0, 1, 4) THEN '<missing>' WHEN kind = 2 THEN '<package-ref>' ELSE '<invalid>' END AS marker, k, j, c.kind AS shape FROM c)"""


def _config_files(spark, d):
    """A configuration a part: it extends another, a file that isn't there, a package, no string, or refers to a project."""
    p = table(spark, d, "part")
    k, j = F.col("p_partkey").cast("string"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.lit(max(1, p.count()))).cast("string")
    kind = F.col("p_size") % 5
    content = F.when(kind == 0, F.concat(F.lit('{"extends": "../p'), j, F.lit('/tsconfig"}'))).when(kind == 1, F.concat(F.lit('{"extends": "../none'), k, F.lit('.json"}'))).when(kind == 2, F.lit('{"extends": "@x/base"}')).when(kind == 3, F.lit('{"extends": 5}')).otherwise(F.concat(F.lit('{"references": [{"path": "../p'), j, F.lit('"}]}')))
    return p.select(F.concat(F.lit("/w/p"), k, F.lit("/tsconfig.json")).alias("path"), content.alias("content"))


@query(_CONFIGS + " SELECT path, kind, reference, target, marker FROM refs")
def config_references(spark, d):
    """What configurations refer to, and which references lead nowhere."""
    return config.references(_config_files(spark, d))


@query(_CONFIGS + ", reach(root, path) AS (SELECT path, target FROM refs WHERE target IS NOT NULL UNION SELECT r.root, x.target FROM reach r JOIN refs x ON x.path = r.path WHERE x.target IS NOT NULL) SELECT root, path FROM reach")
def config_closure(spark, d):
    """Configurations that extend others: all that each depends on."""
    return config.closure(config.references(_config_files(spark, d)))


@query(
    _CONFIGS + """, contents AS (SELECT path, CASE shape WHEN 0 THEN '{"extends": "../p' || j || '/tsconfig"}' WHEN 1 THEN '{"extends": "../none' || k || '.json"}' WHEN 2 THEN '{"extends": "@x/base"}' WHEN 3 THEN '{"extends": 5}' ELSE '{"references": [{"path": "../p' || j || '"}]}' END AS content FROM refs),
entries AS (SELECT 0 AS k, path || '=' || sha256(content) AS part FROM contents UNION ALL SELECT 0, path || '#' || kind || '#' || reference || '=' || marker FROM refs WHERE marker IS NOT NULL),
digests AS (""" + _digest("k", "part", "entries") + ") SELECT fingerprint FROM digests"
)
def resolution_fingerprint(spark, d):
    """The digest of all files that decide what names resolve to."""
    files = _config_files(spark, d)
    return config.resolution_fingerprint(files, config.references(files))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber AS start, 'd' || l_suppkey AS def_file, l_partkey AS def_line FROM lineitem WHERE l_linenumber % 2 = 1 AND l_partkey % 3 <> 0 AND l_orderkey % 2 = 0 AND l_suppkey % 5 <> 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier)")
def definition_hits(spark, d):
    """Cached definitions that still hold: same call, same definition file, same resolution."""
    from ..sources import cache

    li = table(spark, d, "lineitem")
    call = [F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"), F.concat(F.lit("f"), "l_partkey").alias("callee_name")]
    calls = li.select(*call, F.col("l_linestatus").alias("content_hash"))
    was = F.when(F.col("l_partkey") % 3 == 0, F.lit("old")).otherwise(F.col("l_linestatus")).alias("content_hash")
    cached = li.where("l_linenumber % 2 = 1").select(*call, was, F.concat(F.lit("d"), "l_suppkey").alias("def_file"), F.lit("v1").alias("def_hash"), F.col("l_partkey").alias("def_line"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("r1")).otherwise(F.lit("r0")).alias("resolution"))
    now = table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("path"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("v2")).otherwise(F.lit("v1")).alias("content_hash"))
    return cache.definition_hits(calls, cached, now, "r1").select("file", "start", "def_file", "def_line")


def _type_checks(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.col("p_brand").alias("content_hash"), F.lit("s").alias("scope"), F.col("p_type").alias("thrown"), F.col("p_name").alias("declared"), "p_partkey", "p_size")
    cached = p.where("p_partkey % 4 != 0").withColumn("content_hash", F.when(F.col("p_partkey") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash"))).withColumn("fits", F.col("p_size") % 2 == 0)
    return p.drop("p_partkey", "p_size"), cached.drop("p_partkey", "p_size")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, p_size % 2 = 0 AS fits FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 7 <> 0")
def type_check_hits(spark, d):
    """Type checks that the cache answers."""
    from ..sources.cache import type_check_hits as hits

    return hits(*_type_checks(spark, d)).select("file", "fits")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 THEN p_size % 2 = 0 ELSE p_type = p_name OR p_name LIKE '%a%' END AS fits, p_partkey % 4 <> 0 AND p_partkey % 7 <> 0 AS cached FROM part")
def type_check_through(spark, d):
    """Type checks by the cache where it knows them, else by the resolver; all are recorded as dependencies."""
    from ..sources.cache import read_through

    pairs, cached = _type_checks(spark, d)
    decide = lambda rows: rows.withColumn("fits", (F.col("thrown") == F.col("declared")) | F.col("declared").contains("a"))
    return read_through(pairs, cached, decide).select("file", "fits", "cached")


@query("SELECT t.name AS name, t.run, CASE WHEN t.run = 'other' AND t.name <> 'files' THEN NULL ELSE (SELECT count(*) FROM region) END AS n FROM (VALUES ('files', 'same'), ('diagnostics', 'same'), ('files', 'other'), ('diagnostics', 'other')) t(name, run)")
def workspace_change(spark, d):
    """A saved store as the same workspace finds it, and another one: extractions stay, all else is gone."""
    from ..sources.cache import Store
    from ..storage import new_path

    folder = new_path(spark, "store").removeprefix("file://")
    one, rows = Store(spark, folder, "t", "w1"), table(spark, d, "region").select(F.col("r_name").alias("path"))
    for t in ("files", "diagnostics"):
        one.update(t, rows, ["path"])
    one.save()
    moved = Store.load(spark, folder, "t", "w1")
    moved.set_workspace("w2")
    out = [(t, run, None if s.get(t) is None else s.get(t).count()) for run, s in (("same", Store.load(spark, folder, "t", "w1")), ("other", moved)) for t in ("files", "diagnostics")]
    return spark.createDataFrame(out, "name string, run string, n long")


@query("SELECT doc_id, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_lines, sha256(CASE WHEN doc_id % 3 = 0 THEN '/**' || chr(10) || ' */' || chr(10) ELSE '' END || coalesce(text, '')) AS digest FROM documents")
def fix_line_rewrite(spark, d):
    """Lines inserted before the first line of every third text; the rest of the text stays as it was."""
    from ..sinks import insert_lines

    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    ins = t.where(F.col("path").cast("long") % 3 == 0).select("path", F.lit(0).alias("line"), F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("/**").alias("t")), F.struct(F.lit(1).alias("o"), F.lit(" */").alias("t")))).alias("x")).select("path", "line", F.col("x.o").alias("ordinal"), F.col("x.t").alias("text"))
    out = insert_lines(t, ins)
    return out.select(F.col("path").cast("long").alias("doc_id"), (F.regexp_count("content", F.lit("\n")) + 1).cast("long").alias("n_lines"), F.sha2("content", 256).alias("digest"))


# whole sources, generated from parts: one file a part


def _generated(spark, d):
    """A file a part: ``run`` throws an error named after the part's type, ``guard`` calls it inside a try whose catch deals
    with everything, with that type, or with another type; ``outer`` calls ``guard``."""
    k = F.col("p_size") % 3
    catch = F.when(k == 0, F.lit("{ return; }")).when(k == 1, F.concat(F.lit("{ if (e instanceof "), "p_type", F.lit("Error) return; throw e; }"))).otherwise(F.lit("{ if (e instanceof Other) return; throw e; }"))
    body = F.concat(
        F.lit("// "), "p_name", F.lit(" é\nclass "), "p_type", F.lit("Error extends Error {}\nfunction run(x: string) {\n  if (!x) throw new "), "p_type", F.lit("Error(`"), "p_brand", F.lit("${x}`);\n}\n"),
        F.lit("/** Guards. */\nconst guard = (x: string) => {\n  try { run(x); } catch (e) "), catch, F.lit("\n};\n/**\n * @throws {"), "p_brand", F.lit("}\n */\nexport function outer() { guard('a'); }\n"),
    )
    return table(spark, d, "part").select(F.format_string("/src/p%d.ts", "p_partkey").alias("path"), body.alias("content")).withColumn("content_hash", F.sha2("content", 256))


def _program(spark, d):
    from ..sources.extraction import extractions, program

    return program(extractions(_generated(spark, d)))


@query("SELECT '/src/p' || p_partkey || '.ts' AS file, f.name, CAST(f.line AS INTEGER) AS name_line, f.comment FROM part, (VALUES ('run', 3, NULL), ('guard', 7, '/** Guards. */'), ('outer', 13, '')) f(name, line, comment0), LATERAL (SELECT CASE WHEN f.name = 'outer' THEN '/**' || chr(10) || ' * @throws {' || p_brand || '}' || chr(10) || ' */' ELSE f.comment0 END AS comment)".replace("f.comment FROM", "comment FROM"))
def extract_functions(spark, d):
    return _program(spark, d).functions.select("file", "name", "name_line", "comment")


@query("SELECT '/src/p' || p_partkey || '.ts' AS file, 'run' AS fn_name, 'named' AS kind, p_type || 'Error' AS name FROM part UNION ALL SELECT '/src/p' || p_partkey || '.ts', 'guard', 'rethrow', 'e' FROM part WHERE p_size % 3 <> 0")
def extract_throws(spark, d):
    p = _program(spark, d)
    return p.throws.join(p.functions.select("fn", "file", F.col("name").alias("fn_name")), "fn").select("file", "fn_name", "kind", "name")


@query("SELECT '/src/p' || p_partkey || '.ts' AS file, c.fn_name, c.callee_name FROM part, (VALUES ('guard', 'run'), ('outer', 'guard')) c(fn_name, callee_name)")
def extract_calls(spark, d):
    p = _program(spark, d)
    return p.calls.join(p.functions.select("fn", "file", F.col("name").alias("fn_name")), "fn").select("file", "fn_name", "callee_name")


@query("SELECT '/src/p' || p_partkey || '.ts' AS file, CASE p_size % 3 WHEN 1 THEN p_type || 'Error' WHEN 2 THEN 'Other' END AS caught FROM part")
def extract_caught_types(spark, d):
    p = _program(spark, d)
    return p.tries.join(p.functions.select("fn", "file"), "fn").select("file", F.array_join("caught_types", ",").alias("c")).select("file", F.nullif("c", F.lit("")).alias("caught"))


_FOUND = "found AS (SELECT p_partkey, f.fn_name, p_type || 'Error' AS name, f.ord FROM part, (VALUES ('run', 0), ('guard', 1), ('outer', 2)) f(fn_name, ord) WHERE f.fn_name = 'run' OR p_size % 3 = 2)"


def _source_findings(spark, d):
    p = _program(spark, d)
    c = p.calls.join(p.functions.select("fn", "file"), "fn")
    calls = resolution.by_name(c, p.functions).select(F.col("fn").alias("caller"), "callee", "start", "end")
    direct = catching.uncaught(p.throws.select("fn", "start", "end", "kind", "name"), p.tries).select("fn", "kind", "name", F.col("fn").alias("origin_fn"), F.col("start").alias("origin_start"))
    up = propagation.propagate(direct, calls, catching.blocked_edges(calls, catching.catchers(p.tries, p.throws)))
    return p, declarations.missing_declarations(up, p.declared)


@query("WITH " + _FOUND + " SELECT '/src/p' || p_partkey || '.ts' AS file, fn_name, name FROM found")
def source_findings(spark, d):
    """The whole analysis, from source texts to missing declarations."""
    p, missing = _source_findings(spark, d)
    return missing.join(p.functions.select("fn", "file", F.col("name").alias("fn_name")), "fn").select("file", "fn_name", "name")


@query(
    "SELECT '/src/p' || p_partkey || '.ts' AS path, '// ' || p_name || ' é' || chr(10) || 'class ' || p_type || 'Error extends Error {}' || chr(10) || '/**' || chr(10) || ' * @throws {' || p_type || 'Error} from p' || p_partkey || '.ts:run' || chr(10) || ' */' || chr(10) || 'function run(x: string) {' || chr(10) || '  if (!x) throw new ' || p_type || 'Error(`' || p_brand || '${x}`);' || chr(10) || '}' || chr(10)"
    " || CASE WHEN p_size % 3 = 2 THEN '/** Guards.' || chr(10) || ' * @throws {' || p_type || 'Error} from p' || p_partkey || '.ts:run' || chr(10) || ' */' ELSE '/** Guards. */' END || chr(10) || 'const guard = (x: string) => {' || chr(10) || '  try { run(x); } catch (e) ' || CASE p_size % 3 WHEN 0 THEN '{ return; }' WHEN 1 THEN '{ if (e instanceof ' || p_type || 'Error) return; throw e; }' ELSE '{ if (e instanceof Other) return; throw e; }' END || chr(10) || '};' || chr(10) || '/**' || chr(10) || ' * @throws {' || p_brand || '}' || chr(10)"
    " || CASE WHEN p_size % 3 = 2 THEN '  * @throws {' || p_type || 'Error} from p' || p_partkey || '.ts:run' || chr(10) || '  */' ELSE ' */' END || chr(10) || 'export function outer() { guard(''a''); }' || chr(10) AS content FROM part"
)
def fixed_sources(spark, d):
    """The sources with the missing declarations written in."""
    from ..sinks import fixes, insert_lines

    p, missing = _source_findings(spark, d)
    o = p.functions.select(F.col("fn").alias("origin_fn"), F.col("file").alias("origin_file"), F.col("name").alias("origin_name"))
    m = missing.join(o, "origin_fn").select("fn", "kind", "name", "origin_file", "origin_name", F.col("depth").alias("ordinal"))
    files = _generated(spark, d).select("path", "content")
    return insert_lines(files, fixes(files, p.functions, m))


from . import shapes  # noqa: E402, F401  more queries, registered here
