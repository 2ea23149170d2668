import pytest

from quillon.operators import search
from quillon.plans.history import Repository, run
from quillon.plans.language import QueryError


@pytest.fixture(scope="module")
def repo(spark):
    trees = {"t1": {"src/a.rs": "A1", "doc.md": "D1"}, "t2": {"src/a.rs": "A2", "doc.md": "D1"}, "t3": {"src/a.rs": "A1", "doc.md": "D2"}, "t4": {"src/a.rs": "A2", "doc.md": "D2", "new.rs": "N"}}
    commits = spark.createDataFrame([("1" * 40, "t1", "d", "root"), ("2" * 40, "t2", "d", "edit a"), ("3" * 40, "t3", "d", "edit doc"), ("4" * 40, "t4", "d", "merge")], "id string, tree string, date string, subject string")
    parents = spark.createDataFrame([("2" * 40, 0, "1" * 40), ("3" * 40, 0, "1" * 40), ("4" * 40, 0, "2" * 40), ("4" * 40, 1, "3" * 40)], "id string, pos int, parent string")
    entries = spark.createDataFrame([(t, p, b, 1) for t, e in trees.items() for p, b in e.items()], "tree string, path string, blob string, mode int")
    blobs = spark.createDataFrame([("A1", "x\ny\n"), ("A2", "x\nz\n"), ("D1", "one\n"), ("D2", "one\ntwo\n"), ("N", "n\n")], "blob string, text string")
    refs = spark.createDataFrame([("HEAD", "head", "4" * 40), ("v1", "tag", "1" * 40)], "name string, kind string, id string")
    return Repository(commits, parents, entries, blobs, refs)


def test_log(repo):
    assert [r.subject for r in run(repo, "log").collect()] == ["merge", "edit a", "edit doc", "root"] or [r.subject for r in run(repo, "log").collect()] == ["merge", "edit doc", "edit a", "root"]
    assert [r.subject for r in run(repo, "log path:src").collect()] == ["edit a", "root"]
    assert [r.subject for r in run(repo, "log path:src skip:1 limit:1").collect()] == ["root"]
    assert [r.paths for r in run(repo, "log limit:1").collect()] == [["new.rs"]]


def test_diff_and_show(repo):
    d = run(repo, "diff v1..HEAD -path:doc.md").collect()
    assert [(r.path, r.status, r.added, r.removed) for r in d] == [("new.rs", "added", 1, 0), ("src/a.rs", "modified", 1, 1)]
    assert "-y\n+z\n" in d[1].patch
    assert [r.path for r in run(repo, "show HEAD parent:2").collect()] == ["new.rs", "src/a.rs"]
    assert [r.status for r in run(repo, "show 1111111").collect()] == ["added", "added"]
    with pytest.raises(QueryError):
        run(repo, "show HEAD parent:3")
    with pytest.raises(ValueError):
        run(repo, "show 1111")


def test_native(spark):
    o = spark.createDataFrame([(1, "c", "f", 10), (1, "c", "v", 20)], "file_key int, language string, name string, at int")
    d = spark.createDataFrame([(1, "c", "v", "v", "local", 0, 50), (2, "cpp", "v", "v", "field", 0, 5), (2, "header", "f", "f", "function", 0, 5), (3, "cpp", "f", "n::f", "function", 0, 5), (4, "hlsl", "f", "f", "function", 0, 5)], "file_key int, language string, name string, qualified string, kind string, start int, end int")
    inc = spark.createDataFrame([(1, 2)], "file_key int, target int")
    assert sorted((r.name, r.target, r.near, r.uncertain) for r in search.native_bound(o, d, inc).collect()) == [("f", "f", 1, True), ("f", "n::f", 2, True), ("v", "v", 0, False)]
    t = spark.createDataFrame([("A", ["public n::Base<int>"]), ("B", ["Other"])], "name string, bases array<string>")
    assert [r.name for r in search.native_derived(t, "Base").collect()] == ["A"]
    fr = spark.createDataFrame([("x", "x.prefab", 100, "m_Name: Hero\nm_Tag: Hero")], "asset string, path string, start long, text string")
    ob = spark.createDataFrame([("x", 90, 115, "first"), ("x", 115, 200, "second")], "asset string, start long, end long, label string")
    assert sorted((r.at, r.label) for r in search.asset_text(fr, ob, "Hero").collect()) == [(108, "first"), (120, "second")]
