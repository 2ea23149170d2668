"""Operation records: daily roll-ups, compaction, retention, and cache usage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
KEEP_DAYS = 365
HALF_LIFE_MS = 86_400_000
RECENT_MS = 15 * 60_000
RECORD_MS = 60_000


def day(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("long")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "kind", "repository").agg(F.count("*").alias("count"), F.sum(F.greatest(F.coalesce("end_ms", "start_ms") - F.col("start_ms"), F.lit(0))).alias("total_duration_ms"))


def daily(records: DataFrame) -> DataFrame:
    """No-ops without detail, by day of their start, kind and repository: late ones go to their own day."""
    return _sums(records.where("status = 'noop' and not detailed and end_ms is not null").withColumn("day", day(F.col("start_ms"))))


def compacted(records: DataFrame, summaries: DataFrame, today: int) -> tuple[DataFrame, DataFrame]:
    """(records that stay, summaries): plain successes of days older than KEEP_DAYS join the summaries."""
    r = records.withColumn("day", day(F.col("start_ms")))
    old = (F.col("day") < today - KEEP_DAYS) & (F.col("status") == "success") & ~F.col("detailed")
    add = _sums(r.where(old))
    total = summaries.unionByName(add).groupBy("day", "kind", "repository").agg(F.sum("count").alias("count"), F.sum("total_duration_ms").alias("total_duration_ms"))
    return r.where(~old | old.isNull()).drop("day"), total


def retainable(records: DataFrame, today: int) -> DataFrame:
    """Closed days without an operation still active, oldest first."""
    days = records.select(day(F.col("start_ms")).alias("day")).distinct().where(F.col("day") < today)
    active = records.where("end_ms is null").select(day(F.col("start_ms")).alias("day")).distinct()
    return days.join(active, "day", "left_anti").orderBy("day")


def active(records: DataFrame, most: int = 1024) -> DataFrame:
    """The latest update of each operation that hasn't ended, at most `most`; the rest count as gaps."""
    w = Window.partitionBy("id").orderBy(F.desc("updated_ms"), F.col("end_ms").isNull())
    last = records.withColumn("n", F.row_number().over(w)).where("n = 1 and end_ms is null").drop("n")
    return last.orderBy("start_ms", "id").limit(most)


def unfinished(open_: DataFrame, now: int) -> DataFrame:
    """Operations that a crash left open, closed once."""
    return open_.withColumn("status", F.lit("unfinished")).withColumn("end_ms", F.lit(now).cast("long"))


def stages(records: DataFrame) -> DataFrame:
    """records(id, stages: array of name, start_ms, end_ms, waiting) as time by stage and waiting."""
    return records.select("id", F.inline("stages")).groupBy("name", "waiting").agg(F.count("*").alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))


def export(records: DataFrame, after: int | None) -> tuple[DataFrame, Column]:
    """Records updated after a cursor, and the next cursor as an aggregate of them."""
    return (records if after is None else records.where(F.col("updated_ms") > after)), F.max("updated_ms")


def heat(weight: Column, at: Column, now: Column) -> Column:
    """Use decayed by half a day... by half each HALF_LIFE_MS since."""
    return weight * F.pow(F.lit(2.0), -F.greatest(now - at, F.lit(0)) / float(HALF_LIFE_MS))


def fold(times: list[int]) -> tuple[float, int, int]:
    """(heat, its time, last use) after uses in order: one counts if it comes RECORD_MS after the last that did."""
    value, at, last = 1.0, times[0], times[0]
    for t in times[1:]:
        if t - at >= RECORD_MS:
            value, at = value * 2.0 ** (-(t - at) / HALF_LIFE_MS) + 1.0, t
        last = max(last, t)
    return value, at, last


def usage(uses: DataFrame) -> DataFrame:
    """uses(owner, ms) as (owner, heat, at, last_use). Order counts, so each owner is folded by itself."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        h, at, last = fold(sorted(pdf["ms"].tolist()))
        return pd.DataFrame({"owner": [pdf["owner"].iloc[0]], "heat": [h], "at": [at], "last_use": [last]})

    return uses.select("owner", "ms").groupBy("owner").applyInPandas(go, f"owner {uses.schema['owner'].dataType.simpleString()}, heat double, at long, last_use long")


def eviction(owners: DataFrame, now: int) -> DataFrame:
    """owners(owner, heat, at, last_use, bytes) with the order of eviction and the bytes freed so far."""
    recent = (F.lit(now) - F.col("last_use") < RECENT_MS).cast("int")
    keys = [recent, heat(F.col("heat"), F.col("at"), F.lit(now)), F.desc("bytes"), F.col("last_use"), F.col("owner")]
    w = Window.orderBy(*keys)
    return owners.withColumn("position", F.row_number().over(w)).withColumn("freed", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def attributed(contents: DataFrame) -> DataFrame:
    """contents(owner, inode, bytes): each inode's cost shared equally by those that hold it."""
    once = contents.select("owner", "inode", "bytes").distinct()
    return once.withColumn("share", F.col("bytes") / F.count("*").over(Window.partitionBy("inode"))).groupBy("owner").agg(F.sum("share").alias("bytes"))


def refresh_delay(idle_hours: Column) -> Column:
    """Seconds until the next look: 15 at first, 1800 in the end."""
    return 15 - F.lit(1785.0) * F.expm1(-idle_hours / 28.74)
