"""Files by path: tables that lie in its order, and ranges of them for literal `path:` filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.language import Query


def literal_path(q: Query) -> str | None:
    """The first positive `path:` filter that is no glob: all results lie at or below it."""
    return next((f.value for f in q.of("path") if not f.negate and not any(c in f.value for c in "*?[{}\\")), None)


def ordered_table(files: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """files written in the order of their paths, over as many parts as the session shuffles into: a range of paths lies in few files, and few row groups of them."""
    rows = files.repartitionByRange(parts, "path") if parts else files.repartitionByRange("path")
    rows.sortWithinPartitions("path").write.mode("overwrite").parquet(path)
    return files.sparkSession.read.schema(files.schema).parquet(path)


def below(files: DataFrame, literal: str | None) -> DataFrame:
    """files at a path or below it, as comparisons that a scan decides by the least and greatest path of a row group; no literal, no restriction."""
    if literal is None:
        return files
    d = literal.rstrip("/") + "/"
    p = F.col("path")
    return files.where((p == literal) | (p >= d) & (p < d[:-1] + chr(ord("/") + 1)))


def candidate_files(files: DataFrame, q: Query) -> DataFrame:
    """Files that a query may find: those of its literal path. The filters themselves still have to be applied."""
    return below(files, literal_path(q))
