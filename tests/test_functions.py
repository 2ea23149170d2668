import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.functions import sequences as S
from quillon.functions import text as X
from quillon.sources import preprocess as P


def value(spark, column, **given):
    df = spark.range(1)
    for k, v in given.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text", ["", "s", "stone", "Stone", "stone wall", "st\none", "ßtone", "stone*", "s.one", "onestone"])
def test_wildcard(spark, text):
    """Only * is special, it stands for anything, and the whole text must match with its case."""
    rule = {"s*one": lambda t: len(t) >= 4 and t.startswith("s") and t.endswith("one"), "*": lambda t: True, "*on*": lambda t: "on" in t, "s.one": lambda t: t == "s.one", "stone": lambda t: t == "stone", "ß*": lambda t: t.startswith("ß")}
    for pattern, yes in rule.items():
        assert value(spark, N.wildcard(pattern, "v"), v=text) is yes(text), pattern


@pytest.mark.parametrize(
    ("name", "asked"),
    [
        ("OpenFile", {"OpenFile": (0, 0), "openfile": (None, 1), "open": (None, 2), "of": (None, 3), "file": (None, 4), "close": (None, None)}),
        ("read_all_rows", {"read_all_rows": (0, 0), "READ_ALL_ROWS": (None, 1), "rea": (None, 2), "rar": (None, 3), "rows": (None, 4), "xr": (None, None)}),
    ],
)
def test_name_rank(spark, name, asked):
    """Exact names only, or loosely: equal without case, then the beginning, the words' initials, any part."""
    for pattern, (exact, loose) in asked.items():
        assert (value(spark, N.name_rank(pattern, "v", False), v=name), value(spark, N.name_rank(pattern, "v", True), v=name)) == (exact, loose), pattern


@pytest.mark.parametrize(("target", "sep"), [("Box.Open", "."), ("lid::open", "::"), ("Room.Box.Open", ".")])
def test_qualified(spark, target, sep):
    """A qualified target matches the whole name, or whole components at its end."""
    rank = lambda v, loose=False: value(spark, N.qualified_name_rank(target, "v", loose), v=v)
    assert rank(target) == 0 and rank(f"House{sep}{target}") == 1 and rank(f"House{sep}Big{target}") is None and rank(f"{target}{sep}x") is None
    assert rank(f"a{sep}{target}", True) < rank(f"a{sep}{target}".upper(), True)


def test_names(spark):
    assert value(spark, N.simple_name("v"), v="a::b.c") == "c"
    assert value(spark, N.attribute_name("v"), v="#[SerializableAttribute(1)]") == "Serializable"
    assert value(spark, N.normalized_type("v"), v="this List<int> x") == "List<System.Int32>x"
    assert value(spark, N.type_path("v"), v="global::A.B<C<int>>.D`2") == "A.B.D"
    assert value(spark, N.type_path("v"), v="A<" * 20 + "x" + ">" * 20 + ".B<C") == "A.B"
    assert value(spark, N.signature_matches("v", ["System.Int32", "List< string >"]), v=["int", "List<string>"]) is True
    assert value(spark, N.signature_matches("v", ["int"]), v=["long"]) is False
    for name, out in {"crate::x": "m::x", "self::x": "m::n::x", "super::x": "m::x", "super::super::x": "m::x", "::x": "x", "x": "m::n::x", "": "m::n"}.items():
        assert value(spark, N.context_name("v", F.lit("m::n")), v=name) == out
    assert value(spark, N.satisfies("v", ["A", "B"]), v=["A||C", "!D"]) is True
    assert value(spark, N.satisfies("v", ["A"]), v=["!A"]) is False
    assert value(spark, N.version_matches("v", "[1.2,2.0)"), v="1.10.3") is True
    assert value(spark, N.version_matches("v", "(1.2,2.0]"), v="1.2.0") is False
    assert value(spark, N.native_simple_name("v"), v="a::b<c::d>") == "b"
    assert value(spark, N.path_matches("src/*.rs", "v"), v="src/a/b.rs") is True
    assert value(spark, N.path_matches("src", "v"), v="src/a/b.rs") is True
    assert value(spark, N.file_matches("src/*.rs", "v"), v="src/a/b.rs") is False
    assert value(spark, N.history_path("src/*.rs", "v"), v="src/a/b.rs") is False
    assert value(spark, N.file_language("C", "v"), v="header") is not None


def test_positions(spark):
    text = "né\r\nzwei drei\n\nx drei"
    assert value(spark, X.occurrences("v", "drei"), v=text) == [10, 18]
    assert value(spark, X.line_of("v", F.lit(10)), v=text) == 2
    assert value(spark, X.column_of("v", F.lit(10)), v=text) == 6
    assert value(spark, X.byte_offset("v", F.lit(10)), v=text) == 10
    assert value(spark, X.offset_of("v", F.lit(2), F.lit(6)), v=text) == 10
    assert value(spark, X.line_text("v", F.lit(10)), v=text) == "zwei drei"
    assert value(spark, X.occurrences("v", "aa"), v="aaaaa") == [1, 3]
    assert value(spark, X.split_lines("v"), v="a\nb\n") == ["a", "b"]
    assert value(spark, X.dedent("v"), v="f()\n    a\n      b\n") == "f()\na\n  b\n"
    assert value(spark, X.slice_lines("v", 2, 3), v="a\nb\nc\n") == "b\nc"
    row = value(spark, X.location_suffix("v"), v="src/a.rs:10-20")
    assert tuple(row) == ("src/a.rs", 10, 20)
    assert tuple(value(spark, X.location_suffix("v"), v="a.rs#L3")) == ("a.rs", 3, 3)
    assert tuple(value(spark, X.location_suffix("v"), v="a.rs(7)")) == ("a.rs", 7, 7)


def test_similarity(spark):
    sim = lambda a, b: value(spark, X.similarity(X.tokens("a"), X.tokens("b")), a=a, b=b)
    assert sim("a b c d", "a b c d") == 100
    assert sim("a b c d", "a b c e") == 50
    assert sim("a b", "a c") == 0
    assert value(spark, X.tokens("v"), v='f("a b", \'c\') != x_1') == ["f", "(", '"a b"', ",", "'c'", ")", "!", "=", "x_1"]
    assert value(spark, X.distinctive(X.tokens("v"), 2), v="return alpha self beta") is True


def test_patches_reconstruct():
    all_ = [list(p) for n in range(6) for p in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(all_, all_):
        out, at = [], 0
        for i, i2, j, j2 in S.edits(a, b):
            out += a[at:i] + b[j:j2]
            at = i2
        assert out + a[at:] == b


def test_alignment_is_longest_where_nothing_is_unique():
    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(12))] * 2 for _ in range(2))
        got = S._common(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)


def test_alignment_keeps_to_unique_lines():
    a, b = "{ one } { two } { three }".split(), "{ zero } { two } { three } { }".split()
    got = S.matches(a, b)
    assert all(a[i] == b[j] for i, j in got) and {(4, 4), (7, 7)} <= set(got)
    assert S.matches(["x"] * 600, ["y", *["x"] * 600]) == [(k, k + 1) for k in range(600)]
    assert S.tokens("naïve 'a' \"b c\"!") == [("naïve", 0, 5), ("'a'", 6, 9), ('"b c"', 10, 15), ("!", 15, 16)]


def test_unified():
    old = "".join(f"{k}\n" for k in range(20))
    new = old.replace("3\n", "x\n", 1).replace("19\n", "19")
    patch = S.unified(old, new, "a", "b")
    assert patch.count("@@ -") == 2 and "\\ No newline at end of file" in patch and S.unified(old, old, "a", "b") == ""


def test_distance():
    assert S.distance("ab", "ba", 1) == 1 and S.distance("abc", "xyz", 2) is None and S.distance("kitten", "sitting", 3) == 3
    assert S.map_range("a b c", "x a b c", 2, 5) == (4, 7)
    rng = random.Random(3)
    body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    assert S.anchored(body, body.replace("w", "w", 1) + " tail") and not S.anchored(body, "other " * 120)
    assert S.fragments("a b c d e", "x a b c d e y") == [(2, 11)]


def test_preprocess():
    src = "#if A && !B\nx\n#elif C == true\ny\n#else\nz\n#endif\nw\n"
    keep = lambda d: "".join(P.preprocess(src, d).split())
    assert (keep(["A"]), keep(["A", "B"]), keep(["B", "C"]), len(P.preprocess(src, []))) == ("xw", "zw", "yw", len(src))
    assert P.evaluate("(A || B) && C != false", {"B", "C"})
    for bad in ("#endif\n", "#if A\n", "#if (\n#endif\n"):
        with pytest.raises(P.PreprocessorError):
            P.preprocess(bad, [])
