"""Disks while queries go from table to table: what a written table was shuffled by, and tables that nobody reads any more."""

import glob
import os

from pyspark.sql import functions as F

from quillon.operators import tables as B
from quillon.operators import tracing as T


def shuffled(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.splitlines() if "shuffle_" in x}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    t = B.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    d = B.dealt(spark.range(1000), "id")
    assert shuffled(spark) <= before and t.count() == 7 and d.count() == 1000


def test_discarded_tables_are_gone(spark):
    t, d = B.stored(spark.range(3)), B.dealt(spark.range(3), "id")
    at = [os.path.dirname(f).removeprefix("file:").replace("///", "/") for f in (t.inputFiles()[0], d.inputFiles()[0])]
    assert all(map(os.path.isdir, at))
    B.discard(t, d)
    assert not any(map(os.path.isdir, at))


def test_traces_leave_few_files(spark):
    n = 60
    links = spark.range(n).select(F.col("id").alias("at"), (F.col("id") + 1).alias("to"), F.lit("g").alias("here"), F.lit("g").alias("there"))
    one = lambda c: spark.createDataFrame([("t", str(c), "g")], "target string, commit string, region string")
    inside = spark.range(n + 1).select(F.lit("t").alias("target"), F.col("id").alias("commit"))
    before, old = shuffled(spark), set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/t-*"))
    forward, back = T.forwards(links, one(0), inside), T.backwards(links, one(0))
    assert shuffled(spark) <= before
    assert len(set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/t-*")) - old) < 40
    assert {int(x.commit) for x in forward.collect()} == set(range(1, n + 1)) and {(int(x.commit), x.far) for x in back.collect()} == {(k, k) for k in range(n + 1)}
