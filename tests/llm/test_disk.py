"""What operators leave on the disks: tables that nobody reads any more, shuffle files of written tables, copies of tables that files hold."""

import glob
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import common, jaccard_join, line_dedup

ROWS = [(k % 30 if k % 7 else None, "\n".join(f"line {j % 9} of text {k // 2} with words {k // 2 * j} and {j}, which go on" for j in range(12)) + "\nx" * (k % 2), k) for k in range(80)]


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.splitlines() if "shuffle_" in x}


def tables(spark):
    return set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/q-*"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    t = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while shuffled(spark) - before and time.time() < end:  # executors are told, not waited for
        time.sleep(0.1)
    assert shuffled(spark) <= before and t.count() == 7


@pytest.fixture
def docs(spark, tmp_path):
    held = spark.createDataFrame(ROWS, "doc_id long, text string, k int")
    held.repartition(3, "k").write.parquet(str(tmp_path / "docs.parquet"))
    return held, spark.read.parquet(str(tmp_path / "docs.parquet"))


@pytest.mark.parametrize("stage", [lambda d: jaccard_join.one_of_each(d, n=2, num=8, den=10), line_dedup.deduplicated])
def test_stages_leave_the_rows_that_go_and_nothing_else(spark, docs, stage):
    held, filed = docs
    was = tables(spark)
    out = stage(filed)
    assert len(tables(spark) - was) == 1  # no copy of the documents and no table on the way
    rows = [tuple(r) for r in out.collect()]
    assert 0 < len(rows) < len(ROWS) or any(len(r[1]) < len(ROWS[r[2]][1]) for r in rows)
    assert Counter(rows) == Counter(tuple(r) for r in out.collect()) and {(r[0], r[1]) for r in rows} == {(r[0], r[1]) for r in stage(held).collect()}


def test_rows_of_files_have_one_number_each_at_every_reading(spark, docs):
    _, filed = docs
    was = tables(spark)
    base, row = common.numbered(filed.select("k", "text").where("k > 2"))
    first = {r.k: r[row] for r in base.collect()}
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert {r.k: r[row] for r in base.select("k", row).collect()} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    assert len(set(first.values())) == len(first) == 77 and tables(spark) == was


def test_rows_that_are_not_of_files_are_written(spark, docs):
    _, filed = docs
    for df in (filed.selectExpr("explode(array(1, 2)) x", "k"), filed.unionAll(filed), filed.where("rand(1) < 0.9"), filed.join(filed.select("k"), "k"), filed.limit(5), filed.withColumn("_metadata", F.lit(1))):
        was = tables(spark)
        base, row = common.numbered(df)
        assert len(tables(spark) - was) == 1 and base.select(row).distinct().count() == base.count()


def test_scratch_deletes_what_does_not_leave(spark):
    was = tables(spark)
    with common.scratch(spark) as last:
        common.stored(spark.range(2))
        with common.scratch(spark) as inner:
            x = inner(common.stored(spark.range(5)))
        assert len(tables(spark) - was) == 2 and x.count() == 5
        y = last(x.groupBy().count())
    (left,) = tables(spark) - was
    assert y.first()[0] == 5 and os.path.isdir(left)
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        common.stored(spark.range(2))
        raise ZeroDivisionError
    assert tables(spark) - was == {left}
