"""Packages that roots need: one version of each name, the greatest that anything asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .graph import closure


def selected(packages: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, version, available) of what roots(name, version) need, through packages(name, version, dependency, least).

    A request for a version is for that one or a greater one. All requests that can arise are followed, each
    name keeps the greatest version asked for, and of these only what the roots still need by them remains: a version
    that was passed over asks for nothing. Cycles are fine. A version that no row describes has no dependencies and isn't
    available; a row of null dependency describes a package that has none.
    """
    node = lambda n, v: F.struct(F.col(n).alias("name"), F.col(v).alias("version"))
    asks = packages.where("dependency is not null")
    edges = asks.select(node("name", "version").alias("src"), node("dependency", "least").alias("dst"))
    seeds = roots.select(F.lit(0).alias("root"), node("name", "version").alias("node"))
    every = closure(edges, seeds).select("node.name", "node.version").distinct()
    best = every.groupBy("name").agg(F.max_by("version", F.struct(N.version_key("version"), "version")).alias("version"))
    kept = asks.join(best, ["name", "version"], "left_semi").select(F.col("name").alias("src"), F.col("dependency").alias("dst"))
    need = closure(kept, roots.select(F.lit(0).alias("root"), F.col("name").alias("node"))).select(F.col("node").alias("name")).distinct()
    here = packages.select("name", "version").distinct().withColumn("available", F.lit(True))
    return best.join(need, "name", "left_semi").join(here, ["name", "version"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
