"""Regions of two revisions: candidates, rival claims, and what became of each region.

A row is a pair on an edge of the commit graph: `here` is the region whose other side is looked
for, `there` a candidate in the neighbouring commit. All decisions come from the two best scores a
region has on either side, so they are windows over the scored pairs, on all edges at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import ACCEPT, KEEP, MARGIN, score
from .tables import dealt, discard, stored, together

#: An edge: the commit at hand and its neighbour.
EDGE = ["at", "to"]
# Similarity that a rival, and a copied body, must have.
RIVAL = 70
DIRECT, ORIGIN = ("continue", "rename", "move"), ("copy", "extract", "wrapper")


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def candidates(edges: DataFrame, regions: DataFrame, similarity: Column | None = None) -> DataFrame:
    """(at, to, here, there, score, similarity, same_path, same_name) of pairs on edges(at, to) that share blob, path or name.

    regions(commit, region, path, name, owner, blob). Regions with the same path, name and blob on both
    sides are unchanged and stay out, on either side. similarity: of the columns `h` and `t`, structs
    of the two regions; by default 100 for equal blobs, else 60.
    """
    return _candidates(*_sides(edges, regions), similarity)


def _candidates(a: DataFrame, b: DataFrame, similarity: Column | None = None) -> DataFrame:
    same = _unchanged(a, b).toDF("_at", "_to", "_here", "_there")
    on = (F.col("at") == F.col("_at")) & (F.col("to") == F.col("_to"))
    a = a.join(same, on & (F.col("h.region") == F.col("_here")), "left_anti")
    b = b.join(same, on & (F.col("t.region") == F.col("_there")), "left_anti")
    pairs = None
    for key in ("blob", "path", "name"):
        x, y = a.withColumn("_k", F.col(f"h.{key}")), b.withColumn("_k", F.col(f"t.{key}"))
        hit = x.join(y, [*EDGE, "_k"]).drop("_k")
        for other in ("blob", "path", "name"):  # a pair comes by the first key that it shares
            if other == key:
                break
            hit = hit.where(~F.col(f"h.{other}").eqNullSafe(F.col(f"t.{other}")))
        pairs = hit if pairs is None else pairs.unionByName(hit)
    eq = lambda k: F.coalesce((F.col(f"h.{k}") == F.col(f"t.{k}")).cast("int"), F.lit(0))
    alike = similarity if similarity is not None else F.when(eq("blob") == 1, 100).otherwise(60)
    zero = F.lit(0)
    out = pairs.withColumn("similarity", alike.cast("int"))
    points = score(F.col("similarity"), eq("blob"), eq("path"), eq("owner"), eq("name"), zero, zero, zero, zero)
    return out.select(*EDGE, F.col("h.region").alias("here"), F.col("t.region").alias("there"), points.cast("int").alias("score"), "similarity", (eq("path") == 1).alias("same_path"), (eq("name") == 1).alias("same_name")).where(F.col("score") >= KEEP)


def unchanged(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(at, to, here, there): regions of the same path, name and blob on both sides of edges(at, to). They need no search, and no text is read."""
    return _unchanged(*_sides(edges, regions))


def _sides(edges: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, to, h) and (at, to, t): the regions of either end of each edge, both written in buckets of `to`.

    All that follows joins and groups by `at`, `to` and more, so each side is shuffled once.
    """
    whole = F.struct(*(F.col(c) for c in regions.columns))
    e = edges.select(*EDGE).distinct()
    a = e.join(regions.select(F.col("commit").alias("at"), whole.alias("h")), "at")
    b = e.join(regions.select(F.col("commit").alias("to"), whole.alias("t")), "to")
    return dealt(a.select(*EDGE, "h"), "to"), dealt(b.select(*EDGE, "t"), "to")


def _unchanged(a: DataFrame, b: DataFrame) -> DataFrame:
    of = lambda df, side, as_: df.select(*EDGE, F.col(side)["region"].alias(as_), *(F.col(side)[k].alias(k) for k in ("path", "name", "blob")))
    return of(a, "h", "here").join(of(b, "t", "there"), [*EDGE, "path", "name", "blob"]).select(*EDGE, "here", "there")


def competition(scored: DataFrame) -> DataFrame:
    """scored with `competition`: whether another region of `at` claims the candidate: none, uncertain or stronger.

    A rival has ACCEPT or more and is not behind by more than MARGIN. It is stronger if its text is
    alike by RIVAL, it leads the region and all other claimants by more than MARGIN, and itself prefers
    the candidate to all others by more than MARGIN; it is no rival if it prefers another by so much.
    """
    whole = lambda *keys: Window.partitionBy(*EDGE, keys[0]).orderBy(F.desc("score"), keys[1]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, best = whole("here", "there"), whole("there", "here")
    # what a region wants goes along with it, so that the best of a candidate brings its own
    rows = scored.withColumns({"_a": F.first(F.struct("there", "score")).over(own), "_b": F.nth_value(F.struct("there", "score"), 2).over(own)})
    rows = rows.withColumns({"_1": F.first(F.struct("here", "score", "similarity", "_a", "_b")).over(best), "_2": F.nth_value(F.struct("here", "score"), 2).over(best)})
    s, first, second = F.col("score"), F.col("_1"), F.col("_2")
    leads = first["here"] == F.col("here")
    behind = F.coalesce((second["score"] >= ACCEPT) & (second["score"] + MARGIN >= s), F.lit(False))
    elsewhere = F.coalesce(F.when(first["_a"]["there"] == F.col("there"), first["_b"]["score"]).otherwise(first["_a"]["score"]), F.lit(-(1 << 30)))
    weak = (first["similarity"] < RIVAL) | (first["score"] <= s + MARGIN) | F.coalesce(second["score"] + MARGIN >= first["score"], F.lit(False))
    other = (
        F.when(first["score"] < ACCEPT, "none").when(weak, "uncertain").when(elsewhere > first["score"] + MARGIN, "none")
        .when(elsewhere + MARGIN >= first["score"], "uncertain").otherwise("stronger")
    )
    return rows.withColumn("competition", F.when(leads, F.when(behind, "uncertain").otherwise("none")).otherwise(other)).select(*scored.columns, "competition")


def classified(scored: DataFrame, forward: bool = False) -> DataFrame:
    """(at, to, here, there, relation, score, similarity, uncertain, reason): what each region became, alternatives included.

    scored as candidates() gives it; it may have the flags anonymous, kept (the candidate still stands
    unchanged in `at`), wrapped (it lives on as a thin caller), fragment_here, fragment_there and origin (a
    distinctive body is shared). A candidate with a stronger rival is a copy if it is an origin, backwards, and
    else none. Pairs of ACCEPT or more within MARGIN of the best of their kind, direct or origin, and of
    the best direct one, are selected; fragments only where nothing whole is.
    """
    flags = {k: _flag(scored, k) for k in ("anonymous", "kept", "wrapped", "fragment_here", "fragment_there", "origin")}
    rows = competition(scored.withColumns({f"_{k}": v for k, v in flags.items()})).where(F.col("score") >= ACCEPT)
    f = lambda k: F.col(f"_{k}")
    relation = F.when(f("fragment_there") & ~f("fragment_here"), "extract").when(~F.col("same_path"), "move").when(~f("anonymous") & ~F.col("same_name"), "rename").otherwise("continue")
    if not forward:
        relation = F.when(~f("anonymous") & f("kept"), "copy").when(~f("anonymous") & f("wrapped"), "wrapper").otherwise(relation)
    rows = rows.withColumn("relation", relation)
    rivals = F.col("relation").isin(*DIRECT) & ~f("fragment_here") & ~f("fragment_there")
    rows = rows.withColumn("competition", F.when(rivals, F.col("competition")).otherwise("none"))
    beaten = F.col("competition") == "stronger"
    rows = rows.where(~beaten) if forward else rows.where(~beaten | f("origin")).withColumn("relation", F.when(beaten, "copy").otherwise(F.col("relation")))
    part = f("fragment_there") | f("fragment_here")
    rows = rows.withColumn("_band", F.when(part, "fragment").when(F.col("relation").isin(*ORIGIN), "origin").otherwise("direct"))
    all_ = Window.partitionBy(*EDGE, "here")
    direct = F.max(F.when(F.col("_band") == "direct", F.col("score"))).over(all_)
    rows = rows.withColumn("_best", F.max("score").over(Window.partitionBy(*EDGE, "here", "_band"))).withColumn("_direct", direct)
    rows = rows.where((F.col("score") + MARGIN >= F.col("_best")) & (F.col("_direct").isNull() | (F.col("score") + MARGIN >= F.col("_direct"))))
    rows = rows.withColumn("_whole", F.bool_or(~f("fragment_there")).over(all_)).where(~f("fragment_there") | ~F.col("_whole"))
    several = F.count("*").over(all_) > 1
    reason = F.when(several, "competing predecessors").when(F.col("competition") == "uncertain", "competing direct continuations").when(F.col("competition") == "stronger", "stronger direct continuation").otherwise("best")
    unsure = several | (F.col("competition") == "uncertain") | ((F.col("relation") == "copy") & (F.col("similarity") < RIVAL))
    return rows.select(*EDGE, "here", "there", "relation", "score", "similarity", unsure.alias("uncertain"), reason.alias("reason"))


def mapping(edges: DataFrame, regions: DataFrame, scored: DataFrame | None = None, forward: bool = False) -> DataFrame:
    """classified() links of all edges(at, to), with those of unchanged regions, which are never searched for."""
    a, b = _sides(edges, regions)
    with together(edges.sparkSession):
        near = dealt(scored if scored is not None else _candidates(a, b), "to")
    same = _unchanged(a, b).select(*EDGE, "here", "there", F.lit("continue").alias("relation"), F.lit(None).cast("int").alias("score"), F.lit(100).alias("similarity"), F.lit(False).alias("uncertain"), F.lit("unchanged").alias("reason"))
    with together(edges.sparkSession):
        out = stored(same.unionByName(classified(near, forward)))
    discard(a, b, near)
    return out


def paired(old: DataFrame, new: DataFrame) -> DataFrame:
    """(commit, old, new): regions(commit, key, path, name, blob[, kind]) of two sides, one to one, best pairs first; what finds none stands alone.

    A pair counts 4 for its path, 2 for its name and 1 for its blob, and has to share one of them; ties go
    to the smaller old key, then the smaller new one. Regions of kind `file` have to share their path. The only
    region of either side go together.

    Once all pairs that share a set of columns are used up, any two left in a group of the next set share
    no more than that. So each of the seven sets is one join of the n-th with the n-th: no rounds, no pairs
    of a group, and it gives what taking one best pair after another would.
    """
    kind = lambda df: df if "kind" in df.columns else df.withColumn("kind", F.lit("region"))
    left, right, out = kind(old), kind(new), []
    for keys in (("path", "name", "blob"), ("path", "name"), ("path", "blob"), ("path",), ("name", "blob"), ("name",), ("blob",)):
        nth = F.row_number().over(Window.partitionBy("commit", *keys).orderBy("key"))
        usable = F.lit(True) if "path" in keys else F.col("kind") != "file"
        for k in keys:
            usable &= F.col(k).isNotNull()
        a = left.where(usable).select("commit", *keys, nth.alias("_n"), F.col("key").alias("old"))
        b = right.where(usable).select("commit", *keys, nth.alias("_n"), F.col("key").alias("new"))
        hit = stored(a.join(b, ["commit", *keys, "_n"]).select("commit", "old", "new"))
        out.append(hit)
        left = left.join(hit.select("commit", F.col("old").alias("key")), ["commit", "key"], "left_anti")
        right = right.join(hit.select("commit", F.col("new").alias("key")), ["commit", "key"], "left_anti")
    one = lambda df: df.groupBy("commit").agg(F.count("*").alias("n"), F.bool_or(F.col("kind") != "file").alias("region"), F.min("key").alias("key")).where("n = 1 and region")
    alone = stored(one(kind(old)).select("commit", F.col("key").alias("old")).join(one(kind(new)).select("commit", F.col("key").alias("new")), "commit"))
    alone = alone.join(left.select("commit", F.col("key").alias("old")), ["commit", "old"], "left_semi")
    out.append(alone)
    left = left.join(alone.select("commit", F.col("old").alias("key")), ["commit", "key"], "left_anti")
    right = right.join(alone.select("commit", F.col("new").alias("key")), ["commit", "key"], "left_anti")
    none = F.lit(None).cast(dict(old.dtypes)["key"])
    out += [left.select("commit", F.col("key").alias("old"), none.alias("new")), right.select("commit", none.alias("old"), F.col("key").alias("new"))]
    total = out[0].select("commit", "old", "new")
    for df in out[1:]:
        total = total.unionByName(df.select("commit", "old", "new"))
    return total
