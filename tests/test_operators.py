import pytest
from pyspark.sql import functions as F

from quillon.operators import assets, history, incremental, joins, monitor, navigation, search
from quillon.operators import graph as G
from quillon.plans.compile import Corpus, run
from quillon.plans.language import parse
from quillon.sources import extract, files
from quillon.streaming import journal


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_text_search(spark):
    f = spark.createDataFrame([(1, "a.txt", "éx foo foo\r\nbar\nfoo"), (2, "b.txt", "FOO\nno"), (3, "c.txt", None)], "file_key int, path string, content string")
    assert rows(search.text_matches(f, "foo"), "path", "line", "column", "at") == [("a.txt", 1, 4, 4), ("a.txt", 3, 1, 17)]
    assert len(rows(search.text_matches(f, "foo", loose=True))) == 3
    assert rows(search.text_matches(f, "bar\nf"), "path", "line", "column") == [("a.txt", 2, 1)]


def test_innermost(spark):
    spans = spark.createDataFrame([(1, 0, 9000, "out"), (1, 10, 20, "in"), (1, 12, 22, "late")], "k int, start int, end int, label string")
    points = spark.createDataFrame([(1, 15), (1, 5000), (1, 9000), (2, 3)], "k int, at int")
    assert sorted(joins.innermost(spans, points, ["k"], ["at"]).select("k", "at", "label").collect(), key=str) == sorted([(1, 15, "late"), (1, 5000, "out"), (1, 9000, None), (2, 3, None)], key=str)


def test_binding(spark):
    d = spark.createDataFrame(
        [("p", 1, "x", "local", "f.x", 0, 50, False), ("p", 2, "g", "method", "A.g", 0, 9, False), ("q", 3, "g", "method", "B.g", 0, 9, False), ("p", 4, "h", "method", "M.h", 0, 9, True), ("p", 5, "h", "method", "M.h", 0, 9, False)],
        "project string, file_key int, name string, kind string, qualified string, start int, end int, metadata boolean",
    )
    o = spark.createDataFrame([("p", 1, "x", 10, False, "direct"), ("p", 1, "g", 20, True, "none"), ("p", 1, "h", 30, True, "none"), ("p", 1, "nope", 40, True, "none")], "project string, file_key int, name string, at int, call boolean, write string")
    out = {(r.name, r.target, r.uncertain) for r in search.bound(o, d).collect()}
    assert out == {("x", "f.x", False), ("g", "A.g", False), ("h", "M.h", False), ("nope", None, True)}
    sees = joins.visibility(spark.createDataFrame([("p",), ("q",)], "project string"), spark.createDataFrame([("p", "q", ["global"])], "project string, target string, aliases array<string>"))
    assert {(r.target, r.uncertain) for r in search.bound(o, d, sees).where("name = 'g'").collect()} == {("A.g", True), ("B.g", True)}
    c = Corpus(o, d, o)
    assert {r.target for r in run(c, "calls:*").collect()} == {"A.g", "M.h", "unresolved:nope"}
    assert [r.target for r in run(c, "writes:x").collect()] == ["f.x"]


def test_containment_and_includes(spark):
    d = spark.createDataFrame([("p", 1, "a.cs", "C", "class", "N.C", "N", 0, 100), ("p", 1, "a.cs", "m", "method", "N.C.m", "N.C", 10, 20), ("p", 2, "b.cs", "m", "method", "N.D.m", "N.D", 10, 20)], "project string, file_key int, path string, name string, kind string, qualified string, owner string, start int, end int").withColumn("language", F.lit("csharp"))
    assert rows(search.declarations(d, parse("method:m in:C")), "qualified") == [("N.C.m",)]
    assert rows(search.declarations(d, parse("method:m -in:C")), "qualified") == [("N.D.m",)]
    inc = spark.createDataFrame([(1, "src", "a.h"), (1, "src", "lib/b.h"), (1, "src", "c.h")], "file_key int, directory string, written string")
    f = spark.createDataFrame([(10, "src/a.h"), (11, "x/lib/b.h"), (12, "x/c.h"), (13, "y/c.h")], "file_key int, path string")
    assert rows(joins.include_targets(inc, f), "written", "target", "uncertain") == [("a.h", 10, False), ("lib/b.h", 11, True)]
    roots = spark.createDataFrame([("x", "X"), ("x/lib", "L")], "prefix string, logical string")
    assert ("L/b.h",) in rows(joins.display_paths(f, roots), "display")


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    s = spark.createDataFrame([("a", "a")], "root string, node string")
    assert rows(G.closure(e, s)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]


def test_commit_graph(spark):
    h = G.History({"m": ["a", "b"], "a": ["r"], "b": ["r"], "r": ["z"], "z": []})
    assert h.order("m")[0] == "m" and h.order("m").index("r") > max(h.order("m").index("a"), h.order("m").index("b"))
    assert h.bases("a", "b") == ["r"] and h.cut("m") == "r" and h.cut("z") is None
    t = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b"), ("a", 0, None), ("b", 0, None)], "id string, pos int, parent string")
    assert G.History.of(t).parents["m"] == ["a", "b"]


PREFAB = """%YAML 1.1
--- !u!1 &10
GameObject:
  m_Name: Root
  m_Component:
  - component: {fileID: 11}
  m_Icon: {fileID: 0}
--- !u!114 &11 stripped
MonoBehaviour:
  m_Script: {fileID: 11500000, guid: ABcd, type: 3}
"""


def test_assets(spark):
    f = spark.createDataFrame([("p", PREFAB)], "asset string, content string")
    assert rows(assets.documents(f), "class", "id", "stripped") == [(1, 10, False), (114, 11, True)]
    refs = rows(assets.extract(f), "id", "field", "guid", "target")
    assert (11, "m_Script", "abcd", 11500000) in refs and (10, "m_Component.Array.data[0].component", "", 11) in refs
    h = spark.range(1).select(assets.handle(F.lit("a?>/b"), F.lit(3))).first()[0]
    assert h.startswith("unity@") and h.endswith("#3") and "=" not in h and "+" not in h


def test_composition(spark):
    objects = spark.createDataFrame([("base", "gb", 1, False, "Root"), ("base", "gb", 2, False, "Leg"), ("base", "gb", 3, False, "Foot"), ("scene", "gs", 9, False, "Own")], "asset string, guid string, id long, stripped boolean, name string")
    placements = spark.createDataFrame([("scene", 100, "gb"), ("scene", 200, "gb")], "asset string, id long, source_guid string")
    overrides = spark.createDataFrame([("scene", 100, 0, "gb", 1, "m_Name", "First"), ("scene", 100, 1, "gb", 1, "m_Name", "Last")], "asset string, placement long, pos int, guid string, id long, property string, value string")
    removals = spark.createDataFrame([("scene", 200, "gb", 2)], "asset string, placement long, guid string, id long")
    out = assets.compose(objects, placements, overrides, removals)
    got = {r.path: (r.name, r.alive) for r in out.where("asset = 'scene'").collect()}
    assert got == {"9": ("Own", True), "100/1": ("Last", True), "100/2": ("Leg", True), "100/3": ("Foot", True), "200/1": ("Root", True), "200/2": ("Leg", False), "200/3": ("Foot", True)}
    parents = spark.createDataFrame([("scene", "200/3", "200/2"), ("scene", "100/3", "100/2")], "asset string, path string, parent string")
    dead = {r.path for r in assets.cascade(out, parents).where("not alive").collect()}
    assert dead == {"200/2", "200/3"}


def test_history(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "path string, blob string, mode int")
    new = spark.createDataFrame([("a", "1", 1), ("b", "9", 1), ("d", "3", 1)], "path string, blob string, mode int")
    assert rows(history.change_set(old, new), "path", "status") == [("b", "modified"), ("c", "removed"), ("d", "added")]
    s = spark.createDataFrame([("a", "x", 90), ("a", "y", 70), ("b", "y", 65), ("c", "z", 64), ("c", "w", 61)], "old string, new string, score int")
    assert rows(history.mutual_best(s)) == [("a", "x", 90)]
    assert rows(history.assigned(s), "old", "new", "uncertain") == [("a", "x", False), ("b", "y", False), ("c", "w", True), ("c", "z", True)]
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    a = spark.createDataFrame([(1, "same text here"), (2, text)], "key int, text string")
    b = spark.createDataFrame([(7, "same text here"), (8, text + " mu")], "key int, text string")
    assert [(r.old, r.new) for r in history.renames(a, b).orderBy("old").collect()] == [(1, 7), (2, 8)]


def test_monitor(spark):
    d = monitor.DAY_MS
    r = spark.createDataFrame([("1", "k", "r", 5, 9, "noop", False), ("2", "k", "r", d + 1, d + 4, "noop", False), ("3", "k", "r", 6, 8, "noop", True), ("4", "k", "r", 7, None, "noop", False)], journal.RECORDS)
    assert rows(monitor.daily(r)) == [(0, "k", "r", 1, 4), (1, "k", "r", 1, 3)]
    assert rows(monitor.retainable(r, 2)) == [(1,)]
    assert monitor.fold([0, 30_000, monitor.HALF_LIFE_MS])[0] == pytest.approx(1.5)
    c = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0), ("b", 2, 4.0)], "owner string, inode int, bytes double")
    assert rows(monitor.attributed(c)) == [("a", 5.0), ("b", 9.0)]


def test_journal_stream(spark, tmp_path):
    day = monitor.DAY_MS
    folder = str(tmp_path / "in")
    write = lambda *x: spark.createDataFrame(x, journal.RECORDS).coalesce(1).write.mode("append").parquet(folder)
    write(("1", "k", "r", 5, 9, "noop", False), ("2", "k", "r", 3 * day, 3 * day + 1, "noop", False))
    check = str(tmp_path / "check")
    journal.start(journal.source(spark, folder), "daily_rows", check).awaitTermination()
    write(("3", "k", "r", 6, 8, "noop", False))  # late, for day 0
    q = journal.daily(journal.source(spark, folder)).writeStream.format("memory").queryName("daily_rows_2").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("daily_rows_2")) == [(0, "k", "r", 2, 6), (3, "k", "r", 1, 1)]


def test_navigation(spark):
    f = spark.createDataFrame([("a/b/x.rs", "1"), ("a/b/y.rs", "22"), ("z.rs", "")], "path string, content string")
    assert rows(navigation.roll_up(f)) == [("", 3, 3), ("a", 2, 3), ("a/b", 2, 3)]
    assert "a/b/ …2 files" in navigation.browse(f)
    t = lambda q: [(r.path, r.tier) for r in navigation.tiers(f, q).orderBy("distance", "path").collect()]
    assert t("z.rs") == [("z.rs", 0)] and t("x.rs") == [("a/b/x.rs", 1)] and t("X.RS") == [("a/b/x.rs", 2)] and t("b/") == [("a/b/x.rs", 3), ("a/b/y.rs", 3)] and t("b/xr.s") == [("a/b/x.rs", 4)]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_bytes("fn é() {}".encode())
    (tmp_path / "src/b.txt").write_bytes("hé".encode("utf-16"))
    (tmp_path / "src/c.txt").write_bytes(b"a\x01b")
    (tmp_path / "src/d.bin").write_bytes(b"zz")
    got = {r.path: (r.language, r.content) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"src/a.rs": ("rust", "fn é() {}"), "src/b.txt": ("text", "hé")}
    assert rows(spark.createDataFrame([("src/a.rs",), ("gen/b.rs",), ("x.rs",)], "p string").where(files.selected("p", ["**/*.rs"], [], ["src/**"], ["gen/**"]))) == [("x.rs",)]


def test_extraction(spark):
    src = "using X = A.B;\nnamespace N {\n  [Serializable]\n  public class C : Base, I {\n    int f;\n    public void Run(int a, string b) { f = Go(a); Other(out f); } // Run(\n  }\n}\n"
    f = spark.createDataFrame([("k", src)], "file_key string, content string")
    facts = extract.extracted(f).collect()
    decl = {r.qualified: r for r in facts if r.fact == "declaration"}
    assert set(decl) == {"N", "N.C", "N.C.Run"} and decl["N.C"].bases == ["Base", "I"] and decl["N.C.Run"].parameters == ["int", "string"] and decl["N.C"].attributes == ["Serializable"]
    assert {r.name for r in facts if r.kind == "call"} == {"Go", "Other"}
    assert {(r.name, r.write) for r in facts if r.fact == "occurrence" and r.kind == "value"} >= {("f", "direct"), ("f", "out")}
    assert [(r.name, r.qualified) for r in facts if r.fact == "import"] == [("X", "A.B")]


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "file_key string, stamp string")
    b = spark.createDataFrame([("x", "2"), ("z", "1")], "file_key string, stamp string")
    ch = incremental.stamp_changes(a, b)
    assert rows(ch) == [("x", "changed"), ("y", "removed"), ("z", "added")]
    out = incremental.applied(a, ch, b.where("file_key in ('x', 'z')"))
    assert rows(out) == [("x", "2"), ("z", "1")]


def test_renames_lose_no_pair_of_common_trigrams(spark):
    head = " ".join(f"h{k % 7}{k}" for k in range(40))
    tail = lambda s, k: " ".join(f"{s}{k}x{j}" for j in range(60))
    old = {k: f"{head} {tail('o', k)}" for k in range(300)} | {900: head + " one", 901: "a b", 902: "twice the very same words", 903: "twice the very same words", 904: "p q r s t u v w x y z a b c d"}
    new = {k: f"{head} {tail('n', k)}" for k in range(1000, 1300)} | {1900: head + " two", 1901: "a  b", 1902: "twice the very same words", 1904: "p q r s t u v w x y z a b c e", 1905: "p q r s t u v w x y z a b c e"}
    grams = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in (old | new).items()}
    score = {}
    for i, s in old.items():
        for j, t in new.items():
            both = len(grams[i]) + len(grams[j])
            score[i, j] = 100 if s.split() == t.split() else 200 * len(grams[i] & grams[j]) // both if grams[i] and grams[j] else 0
    want = set()
    for (i, j), n in score.items():
        rivals = [score[i, k] for k in new if k != j] + [score[k, j] for k in old if k != i]
        if n >= 60 and n - max(rivals) > 6:
            want.add((i, j, n))
    df = lambda x: spark.createDataFrame(list(x.items()), "key long, text string")
    assert {(900, 1900), (901, 1901)} == {w[:2] for w in want}
    assert {tuple(r) for r in history.renames(df(old), df(new)).collect()} == want


def test_passages_of_few_words_and_inside_quotes(spark, tmp_path):
    from quillon import catalog

    docs = ["say 'x' then", 'he said "the quick brown fox jumps over it" twice', "one two three four five sixteen", "tiny", None, "!!"]
    items = ["x", "quick brown fox jumps over", "two three four five six", "tin", "!", "one two", "not here at all my friend"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {k: n for k, p in enumerate(items) if (n := sum(p in (t or "") for t in docs))}
    assert dict(catalog.passage_occurrence(spark, str(tmp_path)).collect()) == want


def test_similarity_of_whole_texts(spark):
    long = " ".join(f"w{k}" for k in range(1500))
    a = {1: long + " same end of both texts", 2: "other words " * 400 + "same end of both texts", 3: "it's \"quoted\" here", 4: "a b", 5: "", 6: "nothing in common at all"}
    b = {1: long, 2: "same end of both texts", 3: "it's \"quoted\" here too", 4: "a  b", 5: "x"}
    df = lambda x: spark.createDataFrame(list(x.items()), "key long, text string")
    words = lambda t: ["it", "'", "s", '"quoted"', *t.split()[2:]] if "quoted" in t else t.split()
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = set()
    for i, s in a.items():
        for j, t in b.items():
            x, y = grams(words(s)), grams(words(t))
            if words(s) == words(t) or x & y:
                want.add((i, j, 100 if words(s) == words(t) else 200 * len(x & y) // (len(x) + len(y))))
    assert {tuple(r) for r in history.similar(df(a), df(b)).collect()} == want and {w[:2] for w in want} == {(1, 1), (1, 2), (2, 2), (3, 3), (4, 4)}


def test_neighbours_across_ranges_of_ids(spark, tmp_path):
    from quillon import catalog

    ids = [0, 1, 1023, 1024, 5000, 5001, 90000]
    spark.createDataFrame([(k, "a b c d " + "e " * (k % 3)) for k in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in catalog.trigram_similarity(spark, str(tmp_path)).collect()) == ids[:-1]
