"""Directories, path lookup and file views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import text as X

BUDGET = 24_000


def roll_up(files: DataFrame) -> DataFrame:
    """(directory, files, bytes) of every directory above a path, the root as ''."""
    size = F.octet_length("content") if "content" in files.columns else F.lit(0)
    up = files.select(F.explode(F.concat(F.array(F.lit("")), X.prefixes("path"))).alias("directory"), size.cast("long").alias("b"))
    return up.groupBy("directory").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))


def children(files: DataFrame, directory: str) -> DataFrame:
    """(name, is_directory, files) just below a directory."""
    base = directory.rstrip("/") + "/" if directory.strip("/") else ""
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 20)
    return files.where(F.col("path").startswith(base)).groupBy(F.substring_index(rest, "/", 1).alias("name"), rest.contains("/").alias("is_directory")).agg(F.count("*").alias("files"))


def browse(files: DataFrame, directory: str = "", budget: int = BUDGET) -> str:
    """A tree as text. Chains of single directories are one entry; what doesn't fit is a count. The budget goes to small children first."""
    base = directory.rstrip("/")
    depth = 1 + base.count("/") + bool(base)
    counts: dict[str, int] = {}
    every = roll_up(files).where((F.col("directory") == base) | F.col("directory").startswith(base + "/" * bool(base))).select("directory", "files").withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/"))))
    while True:  # level by level, as far as the text can show them: a line takes some 12 characters
        level = every.where(F.col("depth") == depth).orderBy("directory").limit(max(1, budget // 12)).collect()
        counts |= {r[0]: r[1] for r in level}
        depth += 1
        if not level or len(counts) > budget // 12:
            break

    def write(path: str, depth: int, left: int) -> str:
        below = sorted(d for d in counts if d.startswith(path + "/" * bool(path)) and d != path and "/" not in d[len(path) + bool(path) :])
        out = ""
        for k, d in enumerate(sorted(below, key=lambda d: (counts[d], d))):
            name = d[len(path) + bool(path) :]
            while len(kids := [x for x in counts if x.startswith(d + "/") and "/" not in x[len(d) + 1 :]]) == 1 and counts[kids[0]] == counts[d]:
                name, d = f"{name}/{kids[0][len(d) + 1 :]}", kids[0]
            share = (left - len(out)) // (len(below) - k)
            line = f"{'  ' * depth}{name}/ …{counts[d]} files\n"
            out += line + (write(d, depth + 1, share - len(line)) if share > 2 * len(line) else "")
        return out

    return write(directory.rstrip("/"), 0, budget)


def tiers(paths: DataFrame, query: str, fuzzy: bool = True) -> DataFrame:
    """(path, tier, distance) of the best tier only: 0 exact, 1 end, 2 end but for case, 3 within, 4 a few edits."""
    low, p = query.lower(), F.col("path")
    lp = F.lower(p)
    inside = lp.contains(low)
    if not fuzzy:
        stem = F.regexp_replace(lp, r"(?<=[^/])\.[^./]*$", "")
        inside &= F.lit("." not in query.rsplit("/", 1)[-1].lstrip(".")) & ((stem == low) | stem.endswith("/" + low))
    tier = F.when(p == query, 0).when(p.endswith("/" + query), 1).when((lp == low) | lp.endswith("/" + low), 2).when(inside, 3)
    found = paths.select("path").distinct().withColumn("tier", tier)
    if fuzzy:
        tail = F.substring_index(lp, "/", -(query.count("/") + 1))
        most = min(max(len(low) // 5, 1), 3)
        near = F.length(tail).between(len(low) - most, len(low) + most)
        found = found.withColumn("edits", F.when(F.col("tier").isNull() & near, S.edit_distance(tail, F.lit(low), F.lit(most))))
        found = found.withColumn("tier", F.coalesce("tier", F.when(F.col("edits").isNotNull(), 4)))
    else:
        found = found.withColumn("edits", F.lit(None).cast("int"))
    far = F.when(F.col("tier") == 3, F.octet_length(lp) - len(low.encode())).when(F.col("tier") == 4, F.col("edits")).otherwise(0)
    found = found.where("tier is not null").select("path", "tier", far.cast("int").alias("distance"))
    best = found.agg(F.min("tier").alias("best"))
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def view(files: DataFrame, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(line, text) of a file's lines, 1-based and inclusive."""
    lines = files.where(F.col("path") == path).select(F.posexplode(X.split_lines("content")).alias("n", "text"))
    return lines.where((F.col("n") + 1 >= first) & (F.lit(last is None) | (F.col("n") + 1 <= (last or 0)))).select((F.col("n") + 1).cast("long").alias("line"), "text")


def shortened(paths: DataFrame, order: str) -> DataFrame:
    """Paths shown in order: `…/name` once the directory has been shown, where the name is that of one path only."""
    parts = paths.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")).withColumn("name", F.substring_index("path", "/", -1))
    seen = F.row_number().over(Window.partitionBy("dir").orderBy(order)) > 1
    only = F.count("*").over(Window.partitionBy("name")) == 1
    return parts.withColumn("shown", F.when(seen & only & (F.col("dir") != ""), F.concat(F.lit("…/"), "name")).otherwise(F.col("path"))).drop("dir", "name")


def summary(files: DataFrame) -> DataFrame:
    """(projects, files, languages): names and counts of a corpus."""
    return files.agg(F.count_distinct("project").alias("n_projects"), F.count("*").alias("n_files"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
