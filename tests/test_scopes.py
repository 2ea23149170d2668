"""Names in scopes, aliases, and hierarchies by written bases."""

import random

from quillon.operators import graph as G
from quillon.operators import hierarchy as H
from quillon.operators import scopes as S
from quillon.plans.compile import Corpus, plan
from quillon.plans.language import parse

DECL = "project string, file_key int, path string, language string, kind string, name string, qualified string, owner string, namespace string, bases array<string>, modifiers array<string>, start int, end int"
IMPORT = "file_key int, pos int, path string, alias string"


def decl(kind, qualified, bases=(), file_key=1, project="p", modifiers=(), language="csharp"):
    owner, _, name = qualified.rpartition("::" if "::" in qualified else ".")
    return (project, file_key, f"src/{file_key}.cs", language, kind, name, qualified, owner, owner, list(bases), list(modifiers), 0, 10)


def test_aliases_through_aliases(spark):
    rows = [(1, 0, "N.T", "A"), (1, 1, "Other", "A"), (1, 2, "A.In", "B"), (1, 3, "B.X", "C"), (2, 0, "Z", "A"), (3, 0, "Q.x", "P"), (3, 1, "P.y", "Q"), (3, 2, "P.z", "R"), (4, 0, "A.b", "A"), (4, 1, None, "N"), (5, 0, "N.T", "")]
    rows += [(9, k, f"L{k + 1}.x" if k < 40 else "End", f"L{k}") for k in range(41)]
    got = {(r.file_key, r.alias): r.path for r in S.aliases(spark.createDataFrame(rows, IMPORT)).collect()}
    assert got[1, "A"] == "N.T" and got[1, "B"] == "N.T.In" and got[1, "C"] == "N.T.In.X" and got[2, "A"] == "Z"
    assert (got[3, "P"], got[3, "Q"], got[3, "R"], got[4, "A"]) == ("Q.x", "P.y", "P.z", "A.b")  # cycles stay as written
    assert got[9, "L0"] == "End" + ".x" * 40 and (5, "") not in got


def test_nearest_scope_wins(spark):
    d = spark.createDataFrame([decl("class", "A.B.T"), decl("class", "A.T"), decl("class", "T"), decl("class", "I.T"), decl("class", "I.U"), decl("class", "J.U"), decl("class", "A.T", project="q"), decl("class", "A.B.O.In"), decl("class", "K.W")], DECL)
    imports = spark.createDataFrame([(1, 0, "I", ""), (1, 1, "J", None), (1, 2, "K.W", ""), (2, 0, "I", "Al")], IMPORT)
    sees = spark.createDataFrame([("p", "p"), ("q", "q"), ("r", "p"), ("r", "q")], "project string, sees string")
    ask = [("p", 1, "A.B", "T"), ("p", 1, "A", "T"), ("p", 1, "C.D", "T"), ("p", 1, "", "T"), ("p", 1, "A.B", "global::T"), ("p", 1, "X", "U"), ("p", 1, "A.B", "O.In"), ("p", 1, "A", "A.T<int>"), ("r", 1, "A", "T"), ("p", 1, "Q", "W"), ("p", 2, "Q", "U"), ("p", 2, "Q", "Al.U"), ("p", 1, "Q", "None")]
    sites = spark.createDataFrame([(*x, k) for k, x in enumerate(ask)], "project string, file_key int, scope string, written string, n int")
    got = {}
    for r in S.bound_in_scope(sites, d, imports, sees).collect():
        got.setdefault(ask[r.n], set()).add((r.of, r.target, r.uncertain))
    one = lambda t, p="p": {(p, t, False)}
    none = {(None, None, True)}
    want = [one("A.B.T"), one("A.T"), one("T"), one("T"), one("T"), {("p", "I.U", True), ("p", "J.U", True)}, one("A.B.O.In"), one("A.T"), {("p", "A.T", True), ("q", "A.T", True)}, one("K.W"), none, one("I.U"), none]
    assert [got[a] for a in ask] == want


def test_modules(spark):
    plain = spark.createDataFrame([(1, "T", "T", "", ""), (2, "T", "T", "", ""), (3, "f", "T::f", "T", "")], "file_key int, name string, qualified string, owner string, namespace string")
    d = S.contextual(plain, spark.createDataFrame([(1, "p", "k::a"), (2, "p", "k::b"), (2, "q", "w"), (3, "p", None)], "file_key int, project string, module string"))
    assert {(r.project, r.qualified, r.owner) for r in d.collect()} == {("p", "k::a::T", "k::a"), ("p", "k::b::T", "k::b"), ("q", "w::T", "w"), ("p", "T::f", "T")}
    sites = spark.createDataFrame([("p", 9, "k::a", w) for w in ("T", "super::b::T", "crate::b::T", "self::T", "X", "X::y", "Other::T", "k::b::T")], "project string, file_key int, module string, written string")
    imports = spark.createDataFrame([(9, 0, "crate::b::T", "X")], IMPORT)
    got = {r.written: r.target for r in S.bound_in_scope(sites, d, imports).collect()}
    assert got == {"T": "k::a::T", "super::b::T": "k::b::T", "crate::b::T": "k::b::T", "self::T": "k::a::T", "X": "k::b::T", "X::y": None, "Other::T": None, "k::b::T": "k::b::T"}


def test_implementations_and_overrides(spark):
    d = spark.createDataFrame(
        [
            decl("interface", "Contract"), decl("method", "Contract.Run"), decl("class", "Parent", ["Contract"]), decl("method", "Parent.Run", modifiers=["virtual"]), decl("interface", "Read"), decl("class", "Reader", ["Read"]),
            decl("class", "Leaf", ["Alias"], 2), decl("method", "Leaf.Run", file_key=2, modifiers=["override"]), decl("class", "Deep", ["Leaf"], 2), decl("method", "Deep.Run", file_key=2, modifiers=["new"]), decl("class", "X.Parent"), decl("class", "X.Own", ["Parent"], 3),
            decl("trait", "k::Read", file_key=5, project="r", language="rust"), decl("struct", "k::Reader", ["Read"], 5, "r", language="rust"), decl("class", "Loop", ["Pool"]), decl("class", "Pool", ["Loop"]), decl("method", "Parent.Other"),
        ],
        DECL,
    )
    imports = spark.createDataFrame([(2, 0, "Parent", "Alias")], IMPORT)
    c = Corpus(d, declarations=d, imports=imports)
    ask = lambda q: {r.qualified for r in plan(c, parse(q)).collect()}
    assert ask("impl:Contract") == {"Parent", "Leaf", "Deep"} and ask("impl:Contract path:src/2.cs") == {"Leaf", "Deep"}
    assert ask("derived:Parent") == {"Leaf", "Deep", "X.Own"}  # both types of the name
    assert ask("derived:Contract") == set() and ask("impl:Loop") == {"Pool"}
    assert ask("impl:Contract.Run") == {"Parent.Run", "Leaf.Run", "Deep.Run"} and ask("impl:Contract.Run path:src/2.cs") == {"Leaf.Run", "Deep.Run"}
    assert ask("impl:Parent.Run") == {"Leaf.Run"} and ask("impl:Read lang:rust") == {"k::Reader"} and ask("impl:Read -lang:rust") == {"Reader"}


def test_closure_of_random_graphs(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(90)]
    got = {(x.root, x.node): x.depth for x in G.closure(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(k, k) for k in range(0, 60, 7)], "root int, node int")).collect()}
    want = {}
    for root in range(0, 60, 7):
        level, depth = {root}, 0
        while level:
            want |= {(root, n): depth for n in level}
            level, depth = {b for a, b in edges if a in level and (root, b) not in want}, depth + 1
    assert got == want


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DECL), spark.createDataFrame([], IMPORT)
    assert S.aliases(i).collect() == [] and H.subtypes(d, i, d.select("project", "qualified")).collect() == []


def test_a_name_is_asked_once_for_all_files_alike(spark, monkeypatch):
    asked, own = [], S.full_names
    monkeypatch.setattr(S, "full_names", lambda df, imports: asked.append(df.count()) or own(df, imports))
    d = spark.createDataFrame([decl("class", "A.T"), decl("class", "I.U"), decl("class", "T")], DECL)
    imports = spark.createDataFrame([(1, 0, "I", ""), (2, 0, "I", "Al"), (3, 0, "B.x", "Al"), (3, 1, "A", "B"), (4, 0, "A", "B")], IMPORT)
    sites = [("p", k, "A", w) for k in [*range(100), None] for w in ("T", "U", "Al.U", "B.T", None)]
    got = {}
    for r in S.bound_in_scope(spark.createDataFrame(sites, "project string, file_key int, scope string, written string"), d, imports).collect():
        got.setdefault(r.file_key, {})[r.written] = r.target
    assert len(got) == 101 and sum(map(len, got.values())) == len(sites)
    alone = {"T": "A.T", "U": None, "Al.U": None, "B.T": None, None: None}
    assert got.pop(1) == alone | {"U": "I.U"} and got.pop(2) == alone | {"Al.U": "I.U"}
    assert got.pop(3) == got.pop(4) == alone | {"B.T": "A.T"} and all(x == alone for x in got.values())
    assert asked[0] <= 5 * 2 + 3  # not once for each file
