"""Index lookups, visibility, interval joins and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

#: Width of the bins that an interval join meets in, in characters or bytes.
BIN = 4096


def postings(files: DataFrame, terms: Column, space: str) -> DataFrame:
    """(space, term, file_key) of each distinct term of each file."""
    return files.select(F.lit(space).alias("space"), F.explode(F.array_distinct(terms)).alias("term"), "file_key")


def candidates(index: DataFrame, name: str, loose: bool = False) -> DataFrame:
    """File keys whose terms match a name: one term, or all that rank for loose names and wildcards."""
    hit = N.name_rank(name, "term", loose).isNotNull() if loose or "*" in name else F.col("term") == name
    return index.where(hit).select("file_key").distinct()


def maintain(index: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The postings without those of the removed files, with the added ones."""
    return index.join(removed.select("file_key"), "file_key", "left_anti").unionByName(added).distinct()


def visibility(projects: DataFrame, references: DataFrame) -> DataFrame:
    """(project, sees): a project sees itself and those it refers to without alias or by `global`."""
    plain = (F.size("aliases") == 0) | F.array_contains("aliases", "global")
    own = projects.select("project", F.col("project").alias("sees"))
    return own.unionByName(references.where(plain).select("project", F.col("target").alias("sees"))).distinct()


def visible(rows: DataFrame, sees: DataFrame, project: str) -> DataFrame:
    """Rows (project) that a project may see."""
    return rows.join(sees.where(F.col("project") == project).select(F.col("sees").alias("project")), "project", "left_semi")


def visible_memberships(rows: DataFrame, sees: DataFrame, assemblies: DataFrame) -> DataFrame:
    """(viewer, ...): rows(project, path, metadata, ...) that each project may see.

    Source is seen by those that see its project. Metadata is seen by its own project, if that refers to the
    file without alias or by `global`: assemblies(project, path, aliases).
    """
    source = rows.where("not metadata").join(sees.select(F.col("project").alias("viewer"), F.col("sees").alias("project")), "project")
    plain = assemblies.where((F.size("aliases") == 0) | F.array_contains("aliases", "global")).select("project", "path").distinct()
    own = rows.where("metadata").join(plain, ["project", "path"], "left_semi").withColumn("viewer", F.col("project"))
    return source.select("viewer", *rows.columns).unionByName(own.select("viewer", *rows.columns))


def same_domain(a: str, b: str) -> Column:
    """Whether two declarations (structs of metadata, file_key, project) may be one symbol: of one library, or of one project."""
    x, y = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    return F.when(x("metadata") & y("metadata"), x("file_key") == y("file_key")).when(~x("metadata") & ~y("metadata"), x("project") == y("project")).otherwise(F.lit(False))


def within_bins(spans: DataFrame, points: DataFrame, keys: list[str], width: int = BIN) -> DataFrame:
    """Points (at) joined with the spans (start <= at < end) of their keys.

    A span belongs to a level by its length, at which bins are as wide as it or wider, so it lies in two at
    most, however long; a point looks up one bin of each level that there is.
    """
    size = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    level = F.lit(0)
    for k in range(1, 24):
        level += (size > width * 4 ** (k - 1)).cast("int")
    s = spans.withColumn("level", level)
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / (width * F.pow(F.lit(4.0), F.col("level")))), F.floor((F.greatest("end", F.col("start") + 1) - 1) / (width * F.pow(F.lit(4.0), F.col("level")))))))
    levels = sorted(r[0] for r in spans.select(level.alias("level")).distinct().collect())  # two dozen at most
    p = points.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("bin", F.floor(F.col("at") / (width * F.pow(F.lit(4.0), F.col("level")))))
    return p.join(s, [*keys, "level", "bin"]).where("start <= at and at < end").drop("bin", "level")


def innermost(spans: DataFrame, points: DataFrame, keys: list[str], point: list[str], width: int = BIN) -> DataFrame:
    """Each point with the smallest span around it (ties: the later start, then the smaller label), or nulls."""
    found = within_bins(spans, points, keys, width)
    best = found.groupBy(*keys, *point).agg(F.min(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("late"), "label")).alias("b"))
    best = best.select(*keys, *point, F.col("b.label").alias("label"), (-F.col("b.late")).alias("start"), (F.col("b.size") - F.col("b.late")).alias("end"))
    return points.join(best, [*keys, *point], "left")


def last_before(spans: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """As-of: each point with the last span that starts at or before it, for spans that don't overlap."""
    both = spans.select(*keys, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "end", "label").alias("span"))
    both = both.unionByName(points.select(*keys, "at", F.lit(1).alias("kind"), F.lit(None).alias("span")), allowMissingColumns=True)
    seen = F.last("span", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("at", "kind"))
    out = both.withColumn("seen", seen).where("kind = 1")
    return out.select(*keys, "at", F.when(F.col("seen.end") > F.col("at"), F.col("seen.label")).alias("label"))


def prefer_source(found: DataFrame, symbol: list[str]) -> DataFrame:
    """Without rows of metadata for which a source row has the same symbol."""
    own = found.where("not metadata").select(*symbol).distinct()
    return found.where("not metadata").unionByName(found.where("metadata").join(own, symbol, "left_anti"))


def unique(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) where the keys lead to one value only."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def display_paths(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files(file_key, path) with the longest root(prefix, logical) above them put in place of its prefix."""
    up = files.withColumn("prefix", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/")))))
    hit = up.join(roots, "prefix").groupBy("file_key", "path").agg(F.max_by(F.struct("prefix", "logical"), F.length("prefix")).alias("r"))
    shown = F.concat(F.col("r.logical"), F.substring(F.col("path"), F.length("r.prefix") + 1, F.length("path")))
    return files.join(hit.select("file_key", shown.alias("shown")), "file_key", "left").withColumn("display", F.coalesce("shown", "path")).drop("shown")


def include_targets(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes(file_key, directory, written) to files(file_key, path): the path beside the file, else the one path that ends in it."""
    beside = includes.withColumn("path", F.when(F.col("directory") == "", F.col("written")).otherwise(F.concat_ws("/", "directory", "written"))).join(files.withColumnRenamed("file_key", "target"), "path").select("file_key", "written", "target", F.lit(False).alias("uncertain"))
    tails = files.withColumn("written", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), k, 1000), "/"))))
    rest = includes.join(beside, ["file_key", "written"], "left_anti").join(tails.select("written", F.col("file_key").alias("target")), "written")
    return beside.unionByName(unique(rest, ["file_key", "written"], "target").withColumn("uncertain", F.lit(True)))
