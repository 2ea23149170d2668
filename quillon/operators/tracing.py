"""Regions through history: evidence from neighbours, traces along the commit graph, and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from .graph import Commits
from .history import GROUP
from .tables import discard, stored


def sibling_evidence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs(old_owner, new_owner, old, new, similarity) whose owners share another member pair of GROUP or more.

    members has the same columns, for all member pairs compared.
    """
    others = members.where(F.col("similarity") >= GROUP).select("old_owner", "new_owner", F.col("old").alias("o"), F.col("new").alias("n"))
    return pairs.join(others, ["old_owner", "new_owner"], "left").groupBy(*pairs.columns).agg(F.coalesce(F.bool_or((F.col("o") != F.col("old")) & (F.col("n") != F.col("new"))), F.lit(False)).alias("group"))


def caller_evidence(callers_old: DataFrame, callers_new: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(old, new) with a caller(caller, callee, body) that differs only by the name it calls."""
    a = callers_old.select("caller", F.col("callee").alias("old"), F.col("body").alias("x"))
    b = callers_new.select("caller", F.col("callee").alias("new"), F.col("body").alias("y"))
    hit = pairs.join(a, "old").join(b, ["caller", "new"]).where(F.regexp_replace("x", F.concat(F.lit(r"\b\Q"), "old", F.lit(r"\E\b")), F.col("new")) == F.col("y"))
    return pairs.join(hit.select("old", "new").distinct().withColumn("callers", F.lit(True)), ["old", "new"], "left").withColumn("callers", F.coalesce("callers", F.lit(False)))


def wrappers(pairs: DataFrame, after: DataFrame, most_tokens: int = 40) -> DataFrame:
    """pairs(old, new) where `old` lives on after(name, body) as a thin caller of `new`."""
    thin = after.where(F.size(F.split("body", r"\W+")) <= most_tokens).select(F.col("name").alias("old"), "body")
    return pairs.join(thin, "old").where(F.col("body").rlike(r"\w\s*\(") & F.contains("body", F.concat("new", F.lit("(")))).select("old", "new").distinct()


def _node(commit: str, region: str) -> Column:
    return F.to_json(F.array(F.col(commit).cast("string"), F.col(region).cast("string")))


def _place(df: DataFrame, *columns: str) -> DataFrame:
    """Nodes as (commit, region) again."""
    at = F.from_json("id", "array<string>")
    return df.select(*columns, at[0].alias("commit"), at[1].alias("region"))


def backwards(links: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, commit, region, far): where the regions of targets(target, commit, region) come from, by links(at, to, here, there) from child to parent.

    What a region became doesn't depend on how it was reached. So states that are passed from commit to
    commit and united where they meet are what the target reaches among pairs of commit and region. Runs of
    commits that a region goes through alone are contracted, and rounds grow with the logarithm of what is left.
    Where a region has no link, it begins, and nothing is said of the parents.
    """
    seeds = targets.select(F.col("target").cast("string").alias("target"), _node("commit", "region").alias("root")).distinct()
    steps = links.select(_node("at", "here").alias("id"), F.lit(0).alias("pos"), _node("to", "there").alias("parent"))
    found = Commits(steps, seeds).ancestors().join(seeds, "root")
    return _place(found.groupBy("target", "id").agg(F.max("far").alias("far")), "target", "far").select("target", "commit", "region", "far")


def forwards(links: DataFrame, known: DataFrame, inside: DataFrame) -> DataFrame:
    """(target, commit, region) in commits that a trace hasn't reached: from known(target, commit, region) by links(at, to, here, there) from parent to child.

    inside(target, commit): commits that count, those below the tip. A commit that is known keeps what it has, and
    where nothing arrives, nothing is passed on: so only links into unreached commits are followed.
    """
    text = lambda df, *keys: df.select(*(F.col(k).cast("string").alias(k) for k in keys))
    known, inside = text(known, "target", "commit", "region").distinct(), text(inside, "target", "commit").distinct()
    open_ = stored(inside.join(known.select("target", "commit").distinct(), ["target", "commit"], "left_anti"))
    steps = stored(text(links, "at", "to", "here", "there").join(open_.select("target", F.col("commit").alias("to")), "to"))
    first = steps.join(known.select("target", F.col("commit").alias("at"), F.col("region").alias("here")), ["target", "at", "here"], "left_semi")
    node = lambda c, r: F.to_json(F.array("target", F.col(c), F.col(r)))
    seeds = first.select(node("to", "there").alias("root")).distinct()
    rest = steps.join(open_.select("target", F.col("commit").alias("at")), ["target", "at"], "left_semi")
    edges = rest.select(node("at", "here").alias("src"), node("to", "there").alias("dst"))
    got = closure_of(edges, seeds)  # over tables of its own
    discard(open_, steps)
    at = F.from_json("id", "array<string>")
    return got.select(at[0].alias("target"), at[1].alias("commit"), at[2].alias("region"))


def closure_of(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): seeds(root) and all that they reach together by edges(src, dst), in rounds that grow with the logarithm of its depth."""
    one = seeds.select("root").distinct()
    hub = one.sparkSession.createDataFrame([("",)], "root string")  # one root above all seeds
    steps = edges.select(F.col("src").alias("id"), F.lit(0).alias("pos"), F.col("dst").alias("parent")).unionByName(one.select(F.lit("").alias("id"), F.lit(0).alias("pos"), F.col("root").alias("parent")))
    return Commits(steps, hub).ancestors().where("id <> ''").select("id")


def rejected(base: str, side: str, merged: str) -> bool:
    """Whether a merge dropped all that a side had changed: its new lines are gone and its old ones back."""
    a, b, m = base.splitlines(), side.splitlines(), merged.splitlines()
    changes = S.edits(a, b)
    if not changes:
        return False
    kept = {j for j, _ in S.matches(b, m)}
    return all(not any(j in kept for j in range(j0, j1)) for _, _, j0, j1 in changes) and all(x in m for i0, i1, _, _ in changes for x in a[i0:i1])


def rejected_edits(merges: DataFrame) -> DataFrame:
    """merges(commit, parent, base, side, merged) with `hidden`: the edit doesn't show in the merge's result."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BooleanType())
    def go(base: pd.Series, side: pd.Series, merged: pd.Series) -> pd.Series:
        return pd.Series([rejected(a or "", b or "", m or "") for a, b, m in zip(base, side, merged, strict=True)])

    return merges.withColumn("hidden", go("base", "side", "merged"))


def visible_changes(changes: DataFrame, excluded: DataFrame) -> DataFrame:
    """changes(path, commit, ...) with the content of attribute-excluded(path, commit) sides hidden."""
    e = excluded.select("path", "commit").distinct().withColumn("hidden", F.lit(True))
    return changes.join(e, ["path", "commit"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))


def context_lines(lines: DataFrame) -> DataFrame:
    """lines(key, n, line) with the nearest lines before and after that aren't blank, where these are unique in their text."""
    w = Window.partitionBy("key").orderBy("n")
    solid = F.when(F.trim("line") != "", F.col("line"))
    before = F.last(solid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(solid, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    once = lines.groupBy("key", "line").agg(F.count("*").alias("c")).where("c = 1").select(F.col("key").alias("k"), F.col("line").alias("u"))
    out = lines.withColumn("before", before).withColumn("after", after)
    for side in ("before", "after"):
        out = out.join(once, (F.col("key") == F.col("k")) & (F.col(side) == F.col("u")), "left").withColumn(side, F.col("u")).drop("k", "u")
    return out
