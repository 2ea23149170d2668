"""Tables written on the way: where lineage ends, and where rounds of an iteration are kept."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Rows up to which a side is broadcast, if a row has a few words at most.
SMALL = 100_000


def folder(spark: SparkSession) -> str:
    """A new folder in the one that spark.checkpoint.dir names; a temporary one only where none is named and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="quillon-")
        _OWN["dir"] = base
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, conf: str, value: str):
    before = spark.conf.get(conf)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def lean(spark: SparkSession):
    """While this lasts, what a written table was shuffled by is gone from the disks once it stands: nothing reads it again."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: lineage ends, and a lost executor costs nothing."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    with lean(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df as a table in buckets of a key, for several joins and groupings by it and more: under together() they shuffle nothing."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    name, n = f"t_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with lean(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() or dealt() wrote for these very tables; nothing that is still to run may read them."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def together(spark: SparkSession):
    """While this lasts, sides that are dealt by one of a join's keys are joined as they lie."""
    return _set(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


class Rounds:
    """What an iteration has found so far: each round is written once, into one table."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.path, self.n = spark, schema, folder(spark), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and gives it back as read."""
        at = f"{self.path}/{self.n:06d}"
        with lean(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{k:06d}" for k in range(self.n)))
