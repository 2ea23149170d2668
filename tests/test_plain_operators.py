"""Operators that no registered query reaches, each on a small case worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import sequences as S
from quillon.functions import text as X
from quillon.operators import assets, csharp, history, incremental, joins, monitor, navigation, search, tracing
from quillon.operators.graph import History, closure
from quillon.plans.language import parse


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def test_contained_by_span_and_by_owner(spark):
    d = [("p", 1, "A", "A", "class", "", 0, 100), ("p", 1, "f", "A.f", "method", "A", 10, 20), ("p", 2, "g", "A.B::g", "method", "A.B", 5, 9), ("p", 2, "AB", "AB", "class", "", 50, 60), ("p", 2, "h", "AB.h", "method", "AB", 51, 52), ("q", 3, "k", "A.k", "method", "A", 0, 1)]
    df = spark.createDataFrame([(*x, "x", "rust", "") for x in d], "project string, file_key int, name string, qualified string, kind string, owner string, start int, end int, path string, language string, namespace string")
    found = lambda q: [r[0] for r in rows(search.declarations(df, parse(q)), "qualified")]
    assert found("method:* in:A") == ["A.B::g", "A.f"]
    assert found("method:* -in:A") == ["A.k", "AB.h"]
    assert found("method:* in:A -in:f") == ["A.B::g"]


def test_bound_names(spark):
    """Locals first, then what the project sees; a name that several mean is uncertain, one that none means has no target."""
    occ = spark.createDataFrame([("p", 1, 5, "x"), ("p", 1, 50, "x"), ("p", 1, 60, "y"), ("p", 1, 70, "z"), ("q", 2, 5, "x"), ("q", 2, 5, "x")], "project string, file_key int, at int, name string")
    decls = spark.createDataFrame([("p", 1, "x", "f.x", "local", 0, 10, False), ("p", 9, "x", "P.x", "field", 0, 1, False), ("q", 8, "x", "Q.x", "field", 0, 1, False), ("q", 8, "y", "Q.y", "field", 0, 1, False), ("r", 7, "y", "Q.y", "field", 0, 1, True)], "project string, file_key int, name string, qualified string, kind string, start int, end int, metadata boolean")
    sees = spark.createDataFrame([("p", "p"), ("p", "q"), ("p", "r"), ("q", "q")], "project string, sees string")
    got = rows(search.bound(occ, decls, sees), "project", "at", "name", "target", "uncertain")
    assert got == sorted([("p", 5, "x", "f.x", False), ("p", 50, "x", "P.x", True), ("p", 50, "x", "Q.x", True), ("p", 60, "y", "Q.y", False), ("p", 70, "z", None, True), ("q", 5, "x", "Q.x", False), ("q", 5, "x", "Q.x", False)], key=str)


def test_hints_and_places(spark):
    projects = spark.createDataFrame([("core",)], "project string")
    assert "other" in search.filter_hint(projects, parse("f project:other")) and search.filter_hint(projects, parse("f project:c*")) is None
    assert "namespace" in search.filter_hint(projects, parse("f namespace:a*")) and "lang" in search.filter_hint(projects, parse("f lang:c lang:rust"))
    files = spark.createDataFrame([(1, "a.rs", "fn f() {\n  g();\n}\n")], "file_key int, path string, content string")
    decls = spark.createDataFrame([(1, "f", 0, 17), (1, "all", 0, 18), (2, "no", 0, 99)], "file_key int, name string, start int, end int")
    assert [r.name for r in search.locate(decls, files, "a.rs", 2, 3).collect()] == ["f", "all"]


def test_postings_and_paths(spark):
    index = spark.createDataFrame([("w", "a", 1), ("w", "b", 2)], "space string, term string, file_key int")
    gone, new = spark.createDataFrame([(2,)], "file_key int"), spark.createDataFrame([("w", "c", 2), ("w", "a", 1)], "space string, term string, file_key int")
    assert rows(joins.maintain(index, gone, new), "term", "file_key") == [("a", 1), ("c", 2)]
    p = spark.createDataFrame([(1, "d/a.c"), (2, "d/b.c"), (3, "d/e/b.c"), (4, "top")], "n int, path string")
    assert rows(navigation.shortened(p, "n"), "n", "shown") == [(1, "d/a.c"), (2, "d/b.c"), (3, "d/e/b.c"), (4, "top")]
    assert rows(navigation.shortened(p.where("n <> 3"), "n"), "n", "shown")[1] == (2, "…/b.c")
    assert navigation.browse(spark.createDataFrame([("a/b/x",), ("a/b/y",), ("c/z",)], "path string")) == "c/ …1 files\na/b/ …2 files\n"


def test_fuzzy_paths_against_brute_force(spark):
    def osa(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    paths = ["src/reader/lexer.rs", "src/raeder/lexer.rs", "src/readers/lexer.rs", "a/b/src/reader/lexre.rs", "src/parser/lexer.rs", "src/reader/other.rs"]
    query = "src/raeder/lexre.rs"
    want = {(p, osa("/".join(p.split("/")[-3:]), query)) for p in paths}
    got = {(r.path, r.distance) for r in navigation.tiers(spark.createDataFrame([(p,) for p in paths], "path string"), query).collect()}
    assert got == {(p, n) for p, n in want if n <= 3} and len(got) == 4


def test_history_pieces(spark):
    rec = spark.createDataFrame([("c", False, True, "b"), ("c", True, False, "a"), ("d", False, False, "x")], "commit string, uncertain boolean, changed boolean, note string")
    assert rows(history.combined(rec)) == [("c", True, True, ["a", "b"]), ("d", False, False, ["x"])]
    one = spark.range(1).select(*(history.passage(F.split(F.lit(a), " "), F.split(F.lit(b), " ")).alias(f"c{k}") for k, (a, b) in enumerate([("one two", "one two"), ("alpha beta gamma delta eta", "alpha beta gamma delta"), ("aa bb", "aa cc"), ("aa bb", "cc dd")]))).first()
    assert tuple(one) == ("exact", "edited", "weak", "none")
    zero = F.lit(0)
    assert spark.range(1).select(history.score(F.lit(90), F.lit(1), F.lit(1), zero, F.lit(1), zero, zero, zero, F.lit(1)).alias("s")).first().s == 45 + 24 + 8 + 12 + 24
    moved = spark.createDataFrame([("a/x", "b/x", "1"), ("a/y", "b/y", "2"), ("c/x", "d/x", "3"), ("c/y", "e/y", "4"), ("f/x", "g/x", "5")], "old_path string, new_path string, blob string")
    assert rows(history.moved_directories(moved)) == [("a", "b")]
    pairs = spark.createDataFrame([("o", "n", "f", "f2", 50), ("p", "q", "h", "h2", 90)], "old_owner string, new_owner string, old string, new string, similarity int")
    members = spark.createDataFrame([("o", "n", "g", "g2", 85), ("p", "q", "h", "h2", 90)], "old_owner string, new_owner string, old string, new string, similarity int")
    assert rows(tracing.sibling_evidence(pairs, members), "old", "group") == [("f", True), ("h", False)]
    ch, ex = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, commit string"), spark.createDataFrame([("b", "1"), ("b", "1")], "path string, commit string")
    assert rows(tracing.visible_changes(ch, ex), "path", "hidden") == [("a", False), ("b", True)]
    h = History({"d": ["b", "c"], "e": ["c", "b"], "b": ["a"], "c": ["a"], "a": []})
    assert h.bases("d", "e") == ["b", "c"] and h.bases("b", "c") == ["a"] and h.bases("d", "b") == ["b"]


def test_incremental_pieces(spark, tmp_path):
    paths, changed = spark.createDataFrame([("a/b/c",), ("a/bb",), ("d",)], "path string"), spark.createDataFrame([("a/b",), ("d",)], "path string")
    assert rows(incremental.affected(paths, changed)) == [("a/b/c",), ("d",)]
    d = lambda *x: spark.createDataFrame([(1, h) for h in x], "file_key int, header string")
    imports = spark.createDataFrame([(1, "std")], "file_key int, name string")
    rev = lambda *a: incremental.declaration_revision(*a).first().revision
    assert rev(d("f", "g")) == rev(d("g", "f")) != rev(d("f"))
    assert rev(d("f"), imports) != rev(d("f")) and rev(d("f"), imports.limit(0)) == rev(d("f"))
    g = lambda *x: incremental.generation(spark.createDataFrame(list(x), "file_key int, stamp string"), "v", F.lit("all")).first().generation
    assert g((1, "a"), (2, "b")) == g((2, "b"), (1, "a")) != g((1, "a"), (2, "c"))
    first = incremental.publish(spark.range(3), str(tmp_path), "s1")
    assert incremental.publish(spark.range(9), str(tmp_path), "s1") == first and spark.read.parquet(first).count() == 3


def test_monitor_pieces(spark):
    r = spark.createDataFrame([("a", 1, None, 5), ("a", 1, 9, 6), ("b", 2, None, 7), ("c", 0, None, 1)], "id string, start_ms long, end_ms long, updated_ms long")
    assert [x.id for x in monitor.active(r).collect()] == ["c", "b"]
    assert rows(monitor.unfinished(monitor.active(r), 50), "id", "status", "end_ms") == [("b", "unfinished", 50), ("c", "unfinished", 50)]
    s = spark.createDataFrame([("a", [("read", 0, 5, False), ("read", 5, 7, True)]), ("b", [("read", 0, 1, False)])], "id string, stages array<struct<name:string,start_ms:long,end_ms:long,waiting:boolean>>")
    assert rows(monitor.stages(s)) == [("read", False, 2, 6), ("read", True, 1, 2)]
    out, cursor = monitor.export(r, 5)
    assert rows(out, "id", "updated_ms") == [("a", 6), ("b", 7)] and out.agg(cursor).first()[0] == 7


def test_assets_and_scopes(spark):
    composed = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, alive boolean")
    types = spark.createDataFrame([(1, "Hero", ["Base"]), (2, "Base", []), (3, "Base", [])], "id long, type string, ancestry array<string>")
    assert rows(assets.instances(composed, types, "Base"), "id") == [(1,), (2,)] and rows(assets.instances(composed, types, "Base", exact=True), "id") == [(2,)]
    refs = spark.createDataFrame([("a", 1, "m.Array.data[0]"), ("a", 1, "m.Array.data[2]"), ("a", 1, "n")], "asset string, id long, field string")
    sizes = spark.createDataFrame([("a", 1, "m", 1)], "asset string, id long, field string, size int")
    assert rows(assets.truncated(refs, sizes), "field") == [("m.Array.data[0]",), ("n",)]
    sites = spark.createDataFrame([(1, "A.B", "T", ["I"])], "site int, namespace string, written string, imports array<string>")
    assert [x.qualified for x in csharp.lookup_scopes(sites).orderBy("distance").collect()] == ["A.B.T", "A.T", "T", "I.T"]


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.declaration_excerpt(F.lit("f() {}"), F.lit("f()"), 100)) == "f() {}" and one(X.declaration_excerpt(F.lit("f() {" + "x" * 99), F.lit("f()"), 50)) == "f()\n// ..."
    assert [tuple(x) for x in one(S.edit_script(F.lit("a\nb\nc"), F.lit("a\nx\nc\nd")))] == [(1, 2, 1, 2), (3, 3, 3, 4)]
    body = " ".join(f"word{k}" for k in range(80))
    assert one(S.body_anchors(F.lit(body), F.lit(body + " more"))) is True and one(S.body_anchors(F.lit("a b"), F.lit("a b"))) is False
    assert tuple(one(S.diff_counts(F.lit("a\nb"), F.lit("b\nc\nd")))) == (2, 1)


@pytest.mark.parametrize("length", [3, 30])
def test_closure_of_long_chains(spark, length):
    e = spark.createDataFrame([(k, k + 1) for k in range(length)] + [(length, 0)], "src int, dst int")
    assert rows(closure(e, spark.createDataFrame([(0, 0)], "root int, node int")), "node", "depth") == sorted(((k, k) for k in range(length + 1)), key=str)
