import pytest
from pyspark.sql import functions as F

from quillon.functions import compact
from quillon.operators import csharp, render, tracing


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_render(spark):
    df = spark.createDataFrame([("a.rs", 3, "x", False), ("a.rs", 9, "y", True), ("b.rs", 1, "z", False)], "path string, line int, source string, uncertain boolean").orderBy("path", "line")
    text = render.results(df, 2)
    assert text.splitlines() == ["### a.rs", "- `x`:3", "- `y`:9 (possible)", "Showing 2 of 3. Narrow the query or raise `limit:`."]
    assert render.inline("a`b") == "``a`b``"
    assert "1 other file" in render.choices(list("abcde"), "file", "x")
    long = "".join(f"diff {k}\n" + "+ line é\n" * 300 for k in range(20))
    got, at = "", 0
    while at is not None:
        part, at = render.page(long, at, 4000)
        got += part
        assert len(part.encode()) <= 4000
    assert got == long
    with pytest.raises(ValueError):
        render.page(long, 3)


def test_compact(spark):
    assert compact.compacted("int  x = 1 ; // c\n  return  x + +y; /* z */ \"a  b\"") == 'int x=1;return x+ +y;"a  b"'
    doc = '/// <summary>Uses <see cref="T:A.B"/> &lt;x&gt;.</summary>\n/// <param name="p">the p</param>'
    assert spark.range(1).select(compact.xml_doc(F.lit(doc))).first()[0] == "Uses `A.B` <x>. p: the p"


def test_overloads(spark):
    calls = spark.createDataFrame([(1, "f", ["int"]), (2, "f", ["byte"]), (3, "f", ["bool"]), (4, "f", ["Widget"])], "call int, name string, arguments array<string>")
    cands = spark.createDataFrame([("i", "f", ["int"]), ("l", "f", ["long"]), ("d", "f", ["double"])], "id string, name string, parameters array<string>")
    found = csharp.best(csharp.applicable(calls, cands))
    assert rows(found.where("call in (1, 2)"), "call", "id") == [(1, "i"), (2, "i")]
    assert found.where("call = 3").count() == 0 and found.where("call = 4 and uncertain").count() == 3
    sites = spark.createDataFrame([(1, "A.B", "T", ["X"]), (2, "C", "T", ["X"])], "site int, namespace string, written string, imports array<string>")
    types = spark.createDataFrame([("A.T",), ("X.T",)], "qualified string")
    assert rows(csharp.resolved_types(sites, types), "site", "type") == [(1, "A.T"), (2, "X.T")]
    assert spark.range(1).select(csharp.substituted(F.lit("Map<K, List<V>>"), {"K": "V", "V": "int"})).first()[0] == "Map<V, List<int>>"
    parts = spark.createDataFrame([("T", ["B", "A"]), ("T", ["A", "C"])], "type string, bases array<string>")
    assert csharp.merged_bases(parts).first()["bases"] == ["A", "B", "C"]


def test_tracing(spark):
    assert tracing.rejected("a\nb\nc", "a\nX\nc", "a\nb\nc") and not tracing.rejected("a\nb\nc", "a\nX\nc", "a\nX\nc")
    pairs = spark.createDataFrame([("f", "g")], "old string, new string")
    co = spark.createDataFrame([("main", "f", "x = f(1)")], "caller string, callee string, body string")
    cn = spark.createDataFrame([("main", "g", "x = g(1)")], "caller string, callee string, body string")
    assert tracing.caller_evidence(co, cn, pairs).first()["callers"] is True
    assert rows(tracing.wrappers(pairs, spark.createDataFrame([("f", "return g(x)")], "name string, body string"))) == [("f", "g")]
    lines = spark.createDataFrame([(1, 0, "one"), (1, 1, ""), (1, 2, "two"), (1, 3, "one")], "key int, n int, line string")
    assert rows(tracing.context_lines(lines).where("n = 1"), "after") == [("two",)]
