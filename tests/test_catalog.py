"""Registered queries against their SQL on the small tables, where these are there."""

import os

import pytest

from quillon import catalog

SF = "/root/testdata/sf0.001"
FEW = ["text_lines", "text_offsets", "lang_negated", "qualified_suffix", "browse_rollup", "calls_outgoing", "innermost_owner", "override_last_wins", "trigram_similarity", "content_identity", "writes_flag", "uses_sites", "uses_visible", "contained_places", "derived_types", "journal_compact", "stamps_incremental", "object_handle"]


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", FEW)
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    assert canonical(catalog.queries()[name](spark, SF).toPandas()) == canonical(c.execute(catalog.oracle_sql()[name]).df())


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares a query with its SQL on tables of one's own, as DataFrames by name."""
    duckdb = pytest.importorskip("duckdb")

    def go(name, **tables):
        c = duckdb.connect()
        for k, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
            c.execute(f"create or replace view {k} as select * from '{tmp_path}/{k}.parquet/*.parquet'")
        got = canonical(catalog.queries()[name](spark, str(tmp_path)).toPandas())
        assert got == canonical(c.execute(catalog.oracle_sql()[name]).df())
        return got

    return go


def test_derived_scoped_gives_a_type_of_several_declarations_once(spark, against_sql):
    orders = spark.range(1, 2101).selectExpr("id as o_orderkey", "id % 21 as o_custkey")
    orders = orders.union(orders.selectExpr("o_orderkey + 10500", "o_custkey"))  # the same names again
    documents = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert against_sql("derived_scoped", orders=orders, documents=documents)


def test_registry():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) >= 45
