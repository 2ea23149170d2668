from quillon.operators import packages


def test_versions(spark):
    kind = "name string, version string, dependency string, least string"
    rows = [("app", "1.0", "a", "1.2"), ("app", "1.0", "b", "1.0"), ("a", "1.2", "c", "1.9"), ("a", "1.10", "d", "1.0"), ("b", "1.0", "a", "1.10"), ("c", "1.9", "e", "2.0"), ("d", "1.0", "app", "1.0"), ("d", "1.0", "gone", "3.0"), ("e", "2.0", None, None)]
    roots = spark.createDataFrame([("app", "1.0")], "name string, version string")
    got = {(r.name, r.version, r.available) for r in packages.selected(spark.createDataFrame(rows, kind), roots).collect()}
    assert got == {("app", "1.0", True), ("a", "1.10", True), ("b", "1.0", True), ("d", "1.0", True), ("gone", "3.0", False)}  # c and e were asked for by a 1.2 only
    assert packages.selected(spark.createDataFrame([], kind), roots.limit(0)).collect() == []
