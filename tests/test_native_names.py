from pyspark.sql import functions as F

from quillon.functions import names as N


def test_native_name_rank(spark):
    cases = [
        ("a::b", "a::b", False, 0), ("b", "a::b", False, 1), ("a::b", "b", False, None), ("b", "a::c", False, None), ("V", "ns::V<int>", False, 1), ("V<int>", "ns :: V < int >", False, 1), ("V<int>", "ns::V<long>", False, None), ("V", "V<a::b<c>>", False, 0),
        ("x::V", "x<y::z>::V", False, 0), ("operator==", "T::operator ==", False, 1), ("operator ==", "T::operator==", False, 1), ("operator==", "T::operator!=", False, None), ("operator<", "T::operator<", False, 1), ("get*", "T::getAll", False, 1), ("B", "a::b", True, 1), ("ge", "T::getAll", True, 2),
        ("ga", "T::getAll", True, 3), ("All", "T::getAll", True, 4), ("t::All", "T::getAll", True, 4), ("T<b>::f", "n::T<b>::f", False, 1), ("", "a", False, None), ("a", None, False, None),
    ]
    df = spark.createDataFrame([(k, w) for k, (_, w, *_) in enumerate(cases)], "k int, w string")
    ranks = df.select("k", *(N.native_name_rank(p, "w", loose).alias(f"r{k}") for k, (p, _, loose, _) in enumerate(cases))).collect()
    got = {r.k: r[f"r{r.k}"] for r in ranks}
    assert {k: got[k] for k in got if got[k] != cases[k][3]} == {}


def test_native_signatures(spark):
    df = spark.createDataFrame([(["const  T &", "std::vector< int >*"],), (["T const&", "std::vector<int>*"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(N.native_signature_matches("p", ["const T&", "std::vector<int> *"])).collect()] == [True, False, False]
    assert df.select(F.exists("p", lambda x: N.native_tokens(x) == "const T &")).first()[0]
