"""History requests over commits(id, tree, date, subject), parents(id, pos, parent), entries(tree, path, blob, mode) and blobs(blob, text).

The order of a log is found on the driver over branches and merges only; commits, trees and texts stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import sequences as S
from ..operators.graph import Commits
from ..operators.history import change_set
from .language import HistoryRequest, QueryError, parse_history


@dataclass
class Repository:
    commits: DataFrame
    parents: DataFrame
    entries: DataFrame
    blobs: DataFrame
    refs: DataFrame | None = None

    def resolve(self, name: str | None) -> str:
        from ..sources.files import resolved_revision

        refs = self.refs if self.refs is not None else self.commits.sparkSession.createDataFrame([], "name string, kind string, id string")
        return resolved_revision(self.commits, refs, name)

    def tree(self, commit: str) -> DataFrame:
        return self.commits.where(F.col("id") == commit).select("tree").join(self.entries, "tree").select("path", "blob", "mode")


def selected(entries: DataFrame, r: HistoryRequest) -> DataFrame:
    """Entries below the request's paths: any positive one, and no negated one."""
    yes, no = [f for f in r.paths if not f.negate], [f for f in r.paths if f.negate]
    out = entries
    if r.selector == "file":
        out = out.where(N.file_matches(r.value, "path") | N.history_path(r.value, "path"))
    if yes:
        hit = F.lit(False)
        for f in yes:
            hit |= N.history_path(f.value, "path")
        out = out.where(hit)
    for f in no:
        out = out.where(~N.history_path(f.value, "path"))
    return out


def edges(repo: Repository, r: HistoryRequest) -> DataFrame:
    """(id, pos, path, status): what each commit changed against each parent, a root against nothing."""
    tree = selected(repo.entries, r)
    c = repo.commits.select("id", "tree")
    e = c.join(repo.parents.select("id", "pos", "parent"), "id", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    e = e.join(c.select(F.col("id").alias("parent"), F.col("tree").alias("was")), "parent", "left").where("not (tree <=> was)").withColumn("was", F.coalesce("was", F.lit("")))
    # each pair of different trees is compared once, however many commits have it
    pairs = e.select("tree", "was").distinct()
    new = pairs.join(tree, "tree").select("tree", "was", "path", F.col("blob").alias("nb"), F.col("mode").alias("nm"))
    up = pairs.join(tree.withColumnRenamed("tree", "was"), "was").select("tree", "was", "path", F.col("blob").alias("ob"), F.col("mode").alias("om"))
    both = new.join(up, ["tree", "was", "path"], "full").where("not (nb <=> ob and nm <=> om)")
    status = F.when(F.col("ob").isNull(), "added").when(F.col("nb").isNull(), "removed").otherwise("modified")
    return e.join(both.select("tree", "was", "path", status.alias("status")), ["tree", "was"]).select("id", "pos", "path", "status")


def log(repo: Repository, r: HistoryRequest, tip: str) -> DataFrame:
    """(position, id, date, subject, paths): commits that changed the selection, children first. A merge counts for what it changed against all parents."""
    ranks = Commits(repo.parents.select("id", "pos", "parent"), [tip]).order()
    n = repo.parents.where("parent is not null").groupBy("id").agg(F.count_distinct("pos").alias("n"))
    changed = edges(repo, r).groupBy("id", "path").agg(F.count_distinct("pos").alias("m")).join(n, "id", "left").where("m >= coalesce(n, 1)")
    found = changed.groupBy("id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    out = ranks.join(found, "id").join(repo.commits.select("id", "date", "subject"), "id").orderBy("position")
    return out.offset(r.skip).limit(r.limit).select("position", "id", "date", "subject", "paths")


def diff(repo: Repository, r: HistoryRequest, old: str | None, new: str) -> DataFrame:
    """(path, status, added, removed, patch) between two commits, or a root and nothing."""
    after = selected(repo.tree(new), r)
    before = selected(repo.tree(old), r) if old else after.limit(0)
    ch = change_set(before, after)
    text = repo.blobs.select("blob", "text")
    full = ch.join(text.toDF("old_blob", "old_text"), "old_blob", "left").join(text.toDF("new_blob", "new_text"), "new_blob", "left")
    full = full.withColumn("d", S.diff_counts("old_text", "new_text")).withColumn("patch", S.unified_diff("old_text", "new_text", "path"))
    return full.select("path", "status", "d.added", "d.removed", "mode_changed", "patch").orderBy("path")


def run(repo: Repository, text: str) -> DataFrame:
    r = parse_history(text)
    if r.verb == "log":
        return log(repo, r, repo.resolve(None))
    if r.verb == "diff":
        return diff(repo, r, repo.resolve(r.commits[0]), repo.resolve(r.commits[1]))
    commit = repo.resolve(r.commits[0])
    ups = [x[0] for x in repo.parents.where(F.col("id") == commit).where("parent is not null").orderBy("pos").select("parent").collect()]
    if r.parent and r.parent > len(ups):
        raise QueryError(f"`{r.commits[0]}` has {len(ups)} parents.")
    return diff(repo, r, ups[(r.parent or 1) - 1] if ups else None, commit)
