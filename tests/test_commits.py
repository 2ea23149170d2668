"""The commit graph as tables against walks in plain Python, on random graphs."""

import random

import pytest

from quillon.operators import graph as G
from quillon.operators.graph import Commits, History

KIND = "id string, pos int, parent string"


def graph(seed, n, roots=1):
    """Commits that mostly follow the last one, with branches, merges and runs."""
    r = random.Random(seed)
    parents = {f"c{k}": [] for k in range(roots)}
    heads = list(parents)
    for k in range(roots, n):
        c, kind = f"c{k}", r.random()
        if kind < 0.15:
            ps = [r.choice(list(parents))]
        elif kind < 0.35 and len(parents) > 1:
            ps = r.sample(sorted(parents), 2)
        else:
            ps = [heads[-1]]
        parents[c] = ps
        heads.append(c)
    return parents


def table(spark, parents):
    rows = [(c, k, p) for c, ps in parents.items() for k, p in enumerate(ps)] + [(c, 0, None) for c, ps in parents.items() if not ps]
    return spark.createDataFrame(rows, KIND)


def cut(parents, tips):
    """Removes each commit in turn and looks whether an end is still reached."""
    h = History(parents)
    nodes = set().union(*(h.ancestors(t) for t in tips))
    out = []
    for v in nodes:
        if [v] == tips:
            continue
        seen, todo = set(), [t for t in tips if t != v]
        while todo:
            c = todo.pop()
            if c not in seen and c != v:
                seen.add(c)
                todo += [p for p in parents.get(c, []) if p != v]
        if not any(not parents.get(c) for c in seen):
            out.append(v)
    far = {t: 0 for t in tips}
    for c in sorted(nodes, key=lambda c: -int(c[1:])):
        for p in parents[c]:
            far[p] = max(far.get(p, 0), far[c] + 1)
    return min(out, key=lambda v: far[v], default=None)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    parents = graph(seed, 60, roots=1 + seed % 2)
    h, tip = History(parents), "c59"
    c = Commits(table(spark, parents), [tip])
    got = {r.id: r.far for r in c.ancestors().collect()}
    assert got.keys() == h.ancestors(tip)
    assert all(got[p] > got[x] for x in got for p in parents[x])  # children come first
    order = sorted((r.position, r.id) for r in c.order().collect())
    assert [x for _, x in order] == h.order(tip) and [k for k, _ in order] == list(range(len(order)))
    assert [r.id for r in c.cut().collect()] == [x for x in [cut(parents, [tip])] if x]
    two = Commits(table(spark, parents), ["c59", "c52"])
    assert sorted(r.id for r in two.bases().collect()) == h.bases("c59", "c52")
    assert [r.id for r in two.cut().collect()] == [x for x in [cut(parents, ["c59", "c52"])] if x]


def test_long_run_with_a_merge(spark):
    n = 3000
    parents = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(n)}
    parents["c2000"], parents["c1500"] = ["c1999", "c1000"], ["c1499", "c700"]
    c = Commits(table(spark, parents), [f"c{n - 1}"])
    assert c.knots.count() == 7 and {r.id: r.far for r in c.ancestors().collect()} == {f"c{k}": n - 1 - k for k in range(n)}
    assert [r.id for r in c.order().orderBy("position").collect()] == History(parents).order(f"c{n - 1}")


def test_small_cases(spark):
    alone = Commits(spark.createDataFrame([("a", 0, None)], KIND), ["a"])
    assert [(r.id, r.far) for r in alone.ancestors().collect()] == [("a", 0)] and alone.cut().collect() == [] and [r.id for r in alone.order().collect()] == ["a"]
    two = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b")], KIND)  # parents that the table doesn't hold are ends
    assert Commits(two, ["m"]).cut().collect() == [] and Commits(two, ["a", "b"]).bases().collect() == []
    assert {r.id for r in Commits(two, ["m", "a"]).bases().collect()} == {"a"}
    with pytest.raises(ValueError, match="cycle"):
        Commits(spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("t", 0, "a"), ("b", 1, "x")], KIND), ["t"]).ancestors().collect()


def test_runs_are_followed_once(spark, monkeypatch):
    """Pointers that have met their end are written once, and only those still open go on."""
    written = []
    monkeypatch.setattr(G, "stored", lambda df: written.append(df.localCheckpoint()) or written[-1])
    step = [(f"r{k}", f"r{k - 1}") for k in range(1, 200)] + [(f"s{k}", f"e{k}") for k in range(1000)]
    got = {r.id: (r.end, r.hops, r.last) for r in G._jumped(spark.createDataFrame(step, "id string, to string")).collect()}
    assert got == {f"r{k}": ("r0", k, "r1") for k in range(1, 200)} | {f"s{k}": (f"e{k}", 1, f"s{k}") for k in range(1000)}
    assert sum(df.count() for df in written) < 4600  # 1199 rows a round, for nine rounds, before
