"""The corpus tables' shape, made from the generic tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files `source/lang/id.txt`."""
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_key"), path.alias("path"), F.col("source").alias("project"), F.col("lang").alias("language"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files by the path of their URL, host first."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("file_key"), F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"), F.col("html").alias("content"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as declarations within each other."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rnc = c.join(rn, F.col("c_nationkey") == F.col("n_nationkey"))
    dot = lambda *x: F.concat_ws(".", *x)
    make = lambda df, kind, key, name, qualified, owner, space: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"), qualified.alias("qualified"), owner.alias("owner"), space.alias("namespace"))
    out = make(r, "namespace", "r_regionkey", "r_name", F.col("r_name"), F.lit(""), F.lit(""))
    out = out.unionByName(make(rn, "module", "n_nationkey", "n_name", dot("r_name", "n_name"), F.col("r_name"), F.col("r_name")))
    return out.unionByName(make(rnc, "class", "c_custkey", "c_name", dot("r_name", "n_name", "c_name"), dot("r_name", "n_name"), dot("r_name", "n_name")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment: region over nation over customer, as (src, dst)."""
    p = places(spark, sf_dir).where("owner <> ''")
    return p.select(F.col("owner").alias("src"), F.col("qualified").alias("dst"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operation records: value is the seconds taken, props.k above 90 a detail, purchases plain successes."""
    e = read(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("repository"), F.floor(start).alias("start_ms"), (F.floor(start) + F.floor(F.coalesce("value", F.lit(0.0)))).alias("end_ms"), F.when(F.col("event_type") == "purchase", "success").otherwise("noop").alias("status"), F.coalesce(k > 90, F.lit(False)).alias("detailed"))
