"""Asset targets and scripts, metadata that projects see, long spans, and native names."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import assets, joins, search
from quillon.plans.compile import Corpus, plan
from quillon.plans.language import QueryError, parse


def test_targets(spark):
    a = spark.createDataFrame([("p/é", "A/x.prefab", "g1"), ("q", "A/y.prefab", "g2"), ("r", "A/y.prefab", "g3"), ("s", "B", "g3")], "asset string, path string, guid string")
    h = lambda asset, n: spark.range(1).select(assets.handle(F.lit(asset), F.lit(n))).first()[0]
    texts = ["A/x.prefab", "g1", "A/y.prefab", "g3", "none", h("p/é", 5), h("gone", 5), "unity@***#1", "unity@_w#1"]
    got = {r.text: (r.asset, r.object, r.problem) for r in assets.targets(spark.createDataFrame([(t,) for t in texts], "text string"), a).collect()}
    assert [got[t] for t in texts] == [("p/é", None, None), ("p/é", None, None), (None, None, "ambiguous"), (None, None, "ambiguous"), (None, None, "not found"), ("p/é", "5", None), (None, None, "other workspace"), (None, None, "not found"), (None, None, "not found")]
    edges = spark.createDataFrame([("q", 1, "p/é", 5), ("q", 2, "p/é", 6), ("p/é", 5, "q", 1)], "asset string, id long, to string, target long")
    c = Corpus(a, edges=edges, assets=a)
    assert plan(c, parse("references:g1")).count() == 2 and plan(c, parse(f'references:"{h("p/é", 5)}"')).count() == 1 and plan(c, parse("dependencies:A/x.prefab")).count() == 1
    with pytest.raises(QueryError, match="several assets"):
        plan(c, parse("references:A/y.prefab"))


def test_script_types(spark):
    refs = spark.createDataFrame([("a", 1, "m_Script", "g1", 11), ("a", 2, "m_Script", "g2", 11), ("a", 3, "m_Script", "g3", 11), ("a", 4, "m_Script", "g1", 0), ("a", 5, "other", "g1", 11)], "asset string, id long, field string, guid string, target long")
    guids = spark.createDataFrame([("g1", "s1", "x/A.cs"), ("g2", "s2", "x/lib.dll"), ("g3", "s3", "a.cs"), ("g3", "s4", "b.cs")], "guid string, asset string, path string")
    types = spark.createDataFrame([("s1", "N.A"), ("s2", "N.L"), ("s3", "N.B")], "asset string, type string")
    assert [tuple(r) for r in assets.script_types(refs, guids, types).collect()] == [("a", 1, "N.A")]


def test_memberships(spark):
    rows = spark.createDataFrame([("p", "a.cs", False, 1), ("q", "b.cs", False, 2), ("p", "l.dll", True, 3), ("q", "l.dll", True, 4), ("q", "m.dll", True, 5)], "project string, path string, metadata boolean, n int")
    sees = spark.createDataFrame([("p", "p"), ("p", "q"), ("q", "q")], "project string, sees string")
    assemblies = spark.createDataFrame([("p", "l.dll", []), ("q", "l.dll", ["X"]), ("q", "m.dll", ["X", "global"])], "project string, path string, aliases array<string>")
    assert {(r.viewer, r.n) for r in joins.visible_memberships(rows, sees, assemblies).collect()} == {("p", 1), ("p", 2), ("q", 2), ("p", 3), ("q", 5)}
    pairs = spark.createDataFrame([(((m1, f1, p1)), ((m2, f2, p2)), want) for (m1, f1, p1), (m2, f2, p2), want in [((True, 1, "p"), (True, 1, "q"), True), ((True, 1, "p"), (True, 2, "p"), False), ((False, 1, "p"), (False, 2, "p"), True), ((False, 1, "p"), (False, 1, "q"), False), ((True, 1, "p"), (False, 1, "p"), False)]], "a struct<metadata:boolean,file_key:int,project:string>, b struct<metadata:boolean,file_key:int,project:string>, want boolean")
    assert pairs.where(joins.same_domain("a", "b") != F.col("want")).count() == 0


def test_spans_of_all_lengths(spark):
    r = random.Random(4)
    spans = [(r.randrange(3), s := r.randrange(1 << 20), s + max(1, int(4 ** r.uniform(0, 11))), str(k)) for k in range(300)]
    points = [(r.randrange(3), r.randrange(1 << 21)) for _ in range(300)]
    got = {(x.k, x.at, x.label) for x in joins.within_bins(spark.createDataFrame(spans, "k int, start long, end long, label string"), spark.createDataFrame(points, "k int, at long"), ["k"], 64).collect()}
    assert got == {(k, at, n) for k, at in points for j, s, e, n in spans if k == j and s <= at < e}
    empty = spark.createDataFrame([], "k int, start long, end long, label string")
    assert joins.within_bins(empty, spark.createDataFrame(points, "k int, at long"), ["k"]).count() == 0


def test_native_names_once_a_file(spark):
    d = spark.createDataFrame([(1, "c", "f", "f", "function", 0, 9), (2, "header", "f", "n::f", "function", 0, 9), (3, "hlsl", "f", "f", "function", 0, 9), (4, "cpp", "f", "f", "local", 5, 50)], "file_key int, language string, name string, qualified string, kind string, start int, end int")
    o = spark.createDataFrame([(4, "cpp", "f", 10), (4, "cpp", "f", 60), (4, "cpp", "f", 70), (5, "shaderlab", "f", 1), (6, "rust", "f", 1)], "file_key int, language string, name string, at int")
    inc = spark.createDataFrame([(4, 2)], "file_key int, target int")
    assert sorted((r.file_key, r.at, r.target, r.near, r.uncertain) for r in search.native_bound(o, d, inc).collect()) == [(4, 10, "f", 0, False), (4, 60, "f", 2, True), (4, 60, "n::f", 1, True), (4, 70, "f", 2, True), (4, 70, "n::f", 1, True), (5, 1, "f", 2, True)]
