"""Incremental indexing: what changed, what content is, and which facts are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_key, change) of stamps(file_key, stamp): added, removed or changed."""
    both = old.withColumnRenamed("stamp", "was").join(new, "file_key", "full").where("not (was <=> stamp)")
    return both.select("file_key", F.when(F.col("was").isNull(), "added").when(F.col("stamp").isNull(), "removed").otherwise("changed").alias("change"))


def content_identity(version: str, language: Column, content: Column, profile: Column) -> Column:
    """Equal for equal bytes under equal rules: the profile is what else decides the facts (active text, edition)."""
    return F.sha2(F.concat_ws("\u0000", F.lit(version), language, F.coalesce(profile, F.lit("")), F.sha2(content, 256)), 256)


def declaration_revision(decls: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(file_key, revision): hash of the headers of decls(file_key, header) and of imports(file_key, name); changed bodies leave it as it is."""
    parts = decls.select("file_key", F.concat(F.lit("d"), "header").alias("part"))
    if imports is not None:
        parts = parts.unionByName(imports.select("file_key", F.concat(F.lit("i"), "name").alias("part")).distinct())
    return parts.groupBy("file_key").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("part"))), 256).alias("revision"))


def generation(files: DataFrame, version: str, group: Column) -> DataFrame:
    """(group, generation): hash over a group's files and their stamps."""
    return files.groupBy(group.alias("group")).agg(F.sha2(F.concat_ws("\n", F.lit(version), F.sort_array(F.collect_list(F.concat_ws("\u0001", "file_key", "stamp")))), 256).alias("generation"))


def applied(facts: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """facts(file_key, ...) without those of changed files, with the fresh ones."""
    return facts.join(changes.select("file_key"), "file_key", "left_anti").unionByName(fresh)


def affected(paths: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths that equal, or lie below, a changed path."""
    from ..functions.text import prefixes

    up = paths.select("path", F.explode(F.concat(F.array("path"), prefixes("path"))).alias("c"))
    return up.join(changed.select(F.col("path").alias("c")), "c", "left_semi").select("path").distinct()


def publish(df: DataFrame, folder: str, snapshot: str) -> str:
    """Writes a snapshot's table once; a second writer of the same snapshot finds it there."""
    path = f"{folder.rstrip('/')}/snapshot={snapshot}"
    df.write.mode("ignore").parquet(path)
    return path
