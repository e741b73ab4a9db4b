"""Lookups in cache tables."""

from faultline.sources import cache


def test_repeated_calls_find_each_definition_once(spark):
    key = "file string, content_hash string, start int, end int, callee_name string"
    call = ("a.ts", "h", 3, 4, "f")
    calls = spark.createDataFrame([call, call, ("a.ts", "new", 7, 8, "g")], key)
    rows = [(*call, "d1", "v1", 5, "r"), (*call, "d2", "v1", 6, "r"), (*call, "d3", "v1", 7, "r"), ("a.ts", "old", 7, 8, "g", "d1", "v1", 5, "r"), (*call, "d1", "v1", 9, "before")]
    cached = spark.createDataFrame(rows, key + ", def_file string, def_hash string, def_line int, resolution string")
    now = spark.createDataFrame([("d1", "v1"), ("d2", "v1"), ("d3", "v2")], "path string, content_hash string")
    assert sorted(map(tuple, cache.definition_hits(calls, cached, now, "r").collect())) == [(*call, "d1", 5), (*call, "d2", 6)]
