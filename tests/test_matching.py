"""Regions between revisions: pairing against one best pair after another, rival claims, classes, and traces on tables."""

import random

from pyspark.sql import functions as F

from quillon.operators import matching as M
from quillon.operators import tracing as T

SCORED = "at string, to string, here string, there string, score int, similarity int, same_path boolean, same_name boolean"


def greedy(old, new):
    """Of (key, path, name, blob) all pairs, the best first; ties by the old key, then the new one."""
    points = lambda a, b: 4 * (a[1] == b[1]) + 2 * (a[2] == b[2]) + (a[3] == b[3])
    left, right, out = {a[0] for a in old}, {b[0] for b in new}, set()
    for _, i, j in sorted((-points(a, b), a[0], b[0]) for a in old for b in new if points(a, b)):
        if i in left and j in right:
            out.add((i, j))
            left.discard(i)
            right.discard(j)
    if len(old) == len(new) == 1 and left:
        return {(old[0][0], new[0][0])}
    return out | {(i, None) for i in left} | {(None, j) for j in right}


def test_pairing_is_greedy(spark):
    r = random.Random(3)
    sides = [[(f"c{c}", k, r.choice("pqr"), r.choice("mno"), r.choice("xyz")) for c in range(8) for k in r.sample(range(100), r.randint(1, 14))] for _ in range(2)]
    sides[0] += [("lone", 1, "p", "m", "x")]
    sides[1] += [("lone", 2, "q", "n", "y"), ("new", 5, "p", "m", "x")]
    kind = "commit string, key int, path string, name string, blob string"
    got = {}
    for x in M.paired(*(spark.createDataFrame(s, kind) for s in sides)).collect():
        got.setdefault(x.commit, set()).add((x.old, x.new))
    for c in {x[0] for s in sides for x in s}:
        assert got[c] == greedy(*([x[1:] for x in s if x[0] == c] for s in sides)), c


def test_pairing_of_a_large_commit(spark):
    n = 100_000
    side = lambda shift: spark.range(n).select(F.lit("c").alias("commit"), (F.col("id") + shift).alias("key"), F.concat(F.lit("p"), (F.col("id") % 5000).cast("string")).alias("path"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), F.lit("b").alias("blob"))
    out = M.paired(side(0), side(n)).cache()
    assert out.count() == n and out.where("new - old = 100000").count() == n


def test_files_keep_their_paths(spark):
    kind = "commit string, key int, path string, name string, blob string, kind string"
    a = spark.createDataFrame([("c", 1, "p", "f", "x", "file"), ("c", 2, "q", "f", "y", "file")], kind)
    b = spark.createDataFrame([("c", 3, "r", "f", "x", "file"), ("c", 4, "q", "g", "z", "file")], kind)
    assert {(x.old, x.new) for x in M.paired(a, b).collect()} == {(2, 4), (1, None), (None, 3)}


def links(spark, rows, forward=False, **flags):
    """rows: (here, there, score, similarity[, same_path, same_name])."""
    df = spark.createDataFrame([("a", "b", *x[:2], *x[2:4], *(x[4:] or (True, True))) for x in rows], SCORED)
    for name, pairs in flags.items():
        df = df.withColumn(name, F.concat_ws("-", "here", "there").isin(*pairs))
    return {(x.here, x.there): (x.relation, x.uncertain) for x in M.classified(df, forward).collect()}


def test_competition(spark):
    ask = lambda rows: {(x.here, x.there): x.competition for x in M.competition(spark.createDataFrame([("a", "b", *x, True, True) for x in rows], SCORED)).collect()}
    assert ask([("h", "t", 90, 100)]) == {("h", "t"): "none"}
    assert ask([("h", "t", 70, 80), ("r", "t", 90, 100)]) == {("h", "t"): "stronger", ("r", "t"): "none"}
    assert ask([("h", "t", 86, 80), ("r", "t", 90, 100)]) == {("h", "t"): "uncertain", ("r", "t"): "uncertain"}  # not by more than the margin
    assert ask([("h", "t", 70, 80), ("r", "t", 90, 60)])["h", "t"] == "uncertain"  # not alike enough
    assert ask([("h", "t", 70, 80), ("r", "t", 90, 100), ("s", "t", 88, 100)])["h", "t"] == "uncertain"  # two rivals
    assert ask([("h", "t", 70, 80), ("r", "t", 90, 100), ("r", "u", 99, 100)])["h", "t"] == "none"  # the rival prefers another
    assert ask([("h", "t", 70, 80), ("r", "t", 90, 100), ("r", "u", 95, 100)])["h", "t"] == "uncertain"
    assert ask([("h", "t", 50, 80), ("r", "t", 58, 100)])["h", "t"] == "none"  # no rival is good enough


def test_classes(spark):
    assert links(spark, [("h", "t", 90, 100)]) == {("h", "t"): ("continue", False)}
    assert links(spark, [("h", "t", 90, 100, False, True)]) == {("h", "t"): ("move", False)}
    assert links(spark, [("h", "t", 90, 100, True, False)]) == {("h", "t"): ("rename", False)}
    assert links(spark, [("h", "t", 90, 100, True, False)], anonymous=["h-t"]) == {("h", "t"): ("continue", False)}
    assert links(spark, [("h", "t", 90, 100, False, True)], kept=["h-t"]) == {("h", "t"): ("copy", False)}
    assert links(spark, [("h", "t", 90, 60, False, True)], kept=["h-t"]) == {("h", "t"): ("copy", True)}
    assert links(spark, [("h", "t", 90, 100, False, True)], True, kept=["h-t"]) == {("h", "t"): ("move", False)}
    assert links(spark, [("h", "t", 90, 100)], wrapped=["h-t"]) == {("h", "t"): ("wrapper", False)}
    assert links(spark, [("h", "t", 90, 100)], fragment_there=["h-t"]) == {("h", "t"): ("extract", False)}
    assert links(spark, [("h", "t", 90, 100), ("h", "u", 80, 90)], fragment_there=["h-t"]) == {("h", "u"): ("continue", False)}  # whole ones first
    assert links(spark, [("h", "t", 90, 100), ("h", "u", 85, 90), ("h", "v", 80, 90)]) == {("h", "t"): ("continue", True), ("h", "u"): ("continue", True)}
    assert links(spark, [("h", "t", 59, 100)]) == {}
    rival = [("h", "t", 70, 80), ("r", "t", 90, 100)]
    assert links(spark, rival) == {("r", "t"): ("continue", False)}
    assert links(spark, rival, origin=["h-t"]) == {("h", "t"): ("copy", False), ("r", "t"): ("continue", False)}
    assert links(spark, rival, True, origin=["h-t"]) == {("r", "t"): ("continue", False)}
    assert links(spark, [*rival, ("h", "u", 62, 80)])["h", "u"] == ("continue", False)  # what is claimed doesn't hide the next


def test_traces(spark):
    edges = [("m", "a"), ("m", "b"), ("a", "r"), ("b", "r"), ("r", "z"), ("x", "r")]
    follow = {("m", "a", "f"): ["f"], ("m", "b", "f"): ["g"], ("a", "r", "f"): ["f"], ("b", "r", "g"): ["h", "f"], ("r", "z", "h"): ["h"]}
    rows = [(at, to, here, t) for (at, to, here), ts in follow.items() for t in ts]
    kind = "at string, to string, here string, there string"
    got = T.backwards(spark.createDataFrame(rows, kind), spark.createDataFrame([("q", "m", "f")], "target string, commit string, region string"))
    assert {(x.commit, x.region, x.far) for x in got.collect()} == {("m", "f", 0), ("a", "f", 1), ("b", "g", 1), ("r", "f", 2), ("r", "h", 2), ("z", "h", 3)}
    back = [(p, c, k, k) for c, p in edges for k in "fh"]
    inside = spark.createDataFrame([("q", c) for c in "mabrz"], "target string, commit string")
    known = spark.createDataFrame([("q", "r", "f"), ("q", "z", "h"), ("q", "a", "f")], "target string, commit string, region string")
    got = T.forwards(spark.createDataFrame(back, kind), known, inside)
    assert {(x.commit, x.region) for x in got.collect()} == {("b", "f"), ("m", "f")}  # x lies outside, r is known


def test_unchanged_regions_are_not_searched(spark):
    e = spark.createDataFrame([("c2", "c1"), ("c3", "c2")], "at string, to string")
    r = spark.createDataFrame([("c1", "1", "p", "f", "o", "x"), ("c2", "2", "p", "f", "o", "x"), ("c2", "3", "q", "f", "o", "x"), ("c3", "4", "p2", "f", "o", "x")], "commit string, region string, path string, name string, owner string, blob string")
    got = {(x.here, x.there): (x.relation, x.reason) for x in M.mapping(e, r).collect()}
    assert got == {("2", "1"): ("continue", "unchanged"), ("4", "2"): ("move", "competing predecessors"), ("4", "3"): ("move", "competing predecessors")}


def test_mapping_shuffles_each_side_once(spark):
    """However many joins and windows follow, what is written next depends on tables dealt by `to`."""
    from quillon.operators import tables

    edges = spark.range(1, 40).selectExpr("cast(id as string) at", "cast(id - 1 as string) to")
    r = spark.range(40).crossJoin(spark.range(4).toDF("r")).selectExpr("cast(id as string) commit", "concat('g', r) region", "concat('d', r, '/', id div 5 % 2) path", "concat('g', r) name", "'o' owner", "cast((id + 2 * r) div 3 as string) blob")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = M._sides(edges, r)
        with tables.together(spark):
            scored = tables.dealt(M._candidates(a, b), "to")
            assert "Exchange" not in M._candidates(a, b)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in M.classified(scored)._jdf.queryExecution().executedPlan().toString()
        got, want = M.mapping(edges, r), M.classified(M.candidates(edges, r))
        assert got.where("reason <> 'unchanged'").exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
