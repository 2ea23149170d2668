"""Passages with places, their fate in a later revision, and scans by ranges of paths."""

from pyspark.sql import functions as F

from quillon.operators import passages, paths, search
from quillon.plans.language import parse


def test_places(spark):
    texts = spark.createDataFrame([(1, "Grüße: a b  a b\na b."), (2, "nothing here"), (3, None), (4, "one two three four five one two three four six"), (5, "")], "key int, text string")
    want = spark.createDataFrame([("ab", "a b a b"), ("single", "nothing"), ("four", "one two three four"), ("long", "one two three four six"), ("none", "two one"), ("empty", " "), ("null", None)], "passage string, text string")
    got = {(r.passage, r.key, r.number, r.start, r.end) for r in passages.occurrences(texts, want).collect()}
    assert got == {("ab", 1, 1, 7, 15), ("ab", 1, 2, 12, 19), ("single", 2, 1, 0, 7), ("four", 4, 1, 0, 18), ("four", 4, 2, 24, 42), ("long", 4, 1, 24, 46)}
    assert passages.occurrences(texts, want.limit(0)).collect() == []


def test_fates(spark):
    a = "intro\nalpha beta gamma\nmiddle\nalpha beta gamma\n"
    rows = [("same", a, a, 6, 22), ("moved", a, "new\n" + a, 30, 46), ("one copy gone", a, "intro\nalpha beta gamma\n", 6, 22), ("gone", "alpha beta gamma\nrest", "rest", 0, 16), ("edited", "alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", 0, 30), ("blank", "a \n", "b", 1, 3)]
    got = {r.id: (r.fate, r.to_start, r.to_end) for r in passages.projected(spark.createDataFrame(rows, "id string, before string, after string, start int, end int")).collect()}
    assert got == {"same": ("present", 6, 22), "moved": ("present", 34, 50), "one copy gone": ("unresolved", None, None), "gone": ("absent", None, None), "edited": ("unresolved", None, None), "blank": ("unresolved", None, None)}


def test_path_ranges_prune(spark, tmp_path):
    files = spark.range(20_000).select(F.col("id").alias("file_key"), F.concat(F.lit("d"), F.format_string("%03d", (F.col("id") % 200).cast("int")), F.lit("/f"), F.col("id").cast("string"), F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.lit("p").alias("project"))
    t = paths.ordered_table(files, str(tmp_path / "files"), 8)
    q = parse("file:*.rs path:d042/")
    assert paths.literal_path(q) == "d042/" and paths.literal_path(parse("file:* path:a/* -path:b path:c")) == "c" and paths.literal_path(parse("file:*")) is None
    found = search.file_search(t, q)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(path,d042/)" in plan and "LessThan(path,d0420)" in plan
    assert found.count() == 100 and {r.path.split("/")[0] for r in found.collect()} == {"d042"}
    near = paths.below(t, "d042")
    assert near.select(F.input_file_name()).distinct().count() == 1  # of eight
    assert {r.path for r in paths.below(spark.createDataFrame([("a/b",), ("a/bc",), ("a/b/c",), ("a/b-",), ("a/b0",), ("a/b.x",)], "path string"), "a/b").collect()} == {"a/b", "a/b/c"}
