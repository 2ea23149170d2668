"""Parts of C# binding that are relations between tables: conversions, better candidates, partial types, lookup scopes.

Typed resolution of whole expressions needs a compiler's front end and isn't here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Implicit numeric conversions, each type with those it widens to.
WIDENS = {
    "sbyte": "short int long float double decimal nint", "byte": "short ushort int uint long ulong float double decimal nint nuint", "short": "int long float double decimal nint", "ushort": "int uint long ulong float double decimal nint nuint",
    "int": "long float double decimal nint", "uint": "long ulong float double decimal nuint", "long": "float double decimal", "ulong": "float double decimal", "char": "ushort int uint long ulong float double decimal nint nuint", "float": "double", "nint": "long float double decimal", "nuint": "ulong float double decimal",
}
PRIMITIVES = sorted({*WIDENS, "double", "decimal", "bool", "string", "object"})


def widening(spark: SparkSession) -> DataFrame:
    """(source, target): a hundred rows at most, so a broadcast is safe."""
    return spark.createDataFrame([(a, b) for a, bs in WIDENS.items() for b in bs.split()], "source string, target string")


def widens(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for source, targets in WIDENS.items():
        out |= (a == source) & b.isin(*targets.split())
    return out


def conversion(a: Column, b: Column) -> Column:
    """identity, implicit, rejected, or unknown where a type's own conversions would decide."""
    known = a.isin(*PRIMITIVES) & b.isin(*PRIMITIVES)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "identity").when(widens(a, b) | (b == "object"), "implicit").when((a == "null") & b.isin("string", "object"), "implicit").when((a == "null") & b.isin(*PRIMITIVES), "rejected").when(known, "rejected").otherwise("unknown")


def applicable(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """calls(call, name, arguments) with candidates(id, name, parameters) of the name whose parameters the arguments convert to.

    `params`, defaults and named arguments are unknown to this; a call with an unknown conversion is uncertain.
    """
    pairs = calls.join(candidates, "name").where(F.size("arguments") == F.size("parameters"))
    each = F.transform(F.arrays_zip(F.col("arguments").alias("a"), F.col("parameters").alias("p")), lambda x: conversion(x["a"], x["p"]))
    out = pairs.withColumn("conversions", each).where(~F.array_contains("conversions", "rejected"))
    return out.withColumn("uncertain", F.array_contains("conversions", "unknown"))


def best(found: DataFrame) -> DataFrame:
    """Of each call's applicable candidates those that no other beats: as good for every argument, better for one."""
    cost = F.transform("conversions", lambda c: F.when(c == "identity", 0).when(c == "implicit", 1).otherwise(2))
    rows = found.withColumn("cost", cost)
    a, b = rows.select("call", "id", "cost", "parameters").alias("a"), rows.select("call", "id", "cost", "parameters").alias("b")
    better = F.forall(F.arrays_zip(F.col("b.cost").alias("x"), F.col("a.cost").alias("y"), F.col("b.parameters").alias("p"), F.col("a.parameters").alias("q")), lambda z: (z["x"] < z["y"]) | (z["x"] == z["y"]) & ((z["p"] == z["q"]) | (z["x"] == 0) | (z["x"] == 1) & widens(z["p"], z["q"])))
    beaten = a.join(b, (F.col("a.call") == F.col("b.call")) & (F.col("a.id") != F.col("b.id")) & better & (F.col("a.parameters") != F.col("b.parameters"))).select("a.call", "a.id").distinct()
    return rows.join(beaten, ["call", "id"], "left_anti").drop("cost")


def merged_bases(parts: DataFrame) -> DataFrame:
    """parts(type, bases) of partial types: the union of their bases."""
    return parts.groupBy("type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bases")))).alias("bases"))


def lookup_scopes(sites: DataFrame) -> DataFrame:
    """sites(site, namespace, written, imports): the full names that a written type may have, the nearest scope first."""
    parts = F.split("namespace", r"\.")
    own = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.concat_ws(".", F.array_join(F.slice(parts, 1, k), "."), "written"))
    imported = F.transform("imports", lambda i: F.concat_ws(".", i, "written"))
    return sites.select("site", F.posexplode(F.concat(F.when(F.col("namespace") == "", F.array().cast("array<string>")).otherwise(own), F.array("written"), imported)).alias("distance", "qualified"))


def resolved_types(sites: DataFrame, types: DataFrame) -> DataFrame:
    """Each site with the type(qualified) of the nearest scope; uncertain where imports offer several."""
    found = lookup_scopes(sites).join(types.select("qualified").distinct(), "qualified")
    return found.groupBy("site").agg(F.min_by("qualified", "distance").alias("type"), (F.count("*") > 1).alias("several"))


def substituted(ty: Column, arguments: dict[str, str]) -> Column:
    """A written type with its parameters replaced, all at once."""
    out = ty
    for k, name in enumerate(arguments):
        out = F.regexp_replace(out, rf"(?<![\w.]){name}(?![\w])", f"\u0001{k}\u0002")
    for k, value in enumerate(arguments.values()):
        out = F.replace(out, F.lit(f"\u0001{k}\u0002"), F.lit(value))
    return out
