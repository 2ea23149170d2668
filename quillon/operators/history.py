"""Snapshots and revisions: what changed, what was renamed, and a selection's log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import let
from .tables import stored

# What a pair must score, and by how much it must win.
ACCEPT, MARGIN, KEEP, GROUP = 60, 6, 45, 80


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status, old_blob, new_blob, mode_changed) of paths whose (blob, mode) differ."""
    a = old.select("path", F.col("blob").alias("old_blob"), F.col("mode").alias("old_mode"))
    b = new.select("path", F.col("blob").alias("new_blob"), F.col("mode").alias("new_mode"))
    both = a.join(b, "path", "full").where("not (old_blob <=> new_blob and old_mode <=> new_mode)")
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "removed").otherwise("modified")
    return both.select("path", status.alias("status"), "old_blob", "new_blob", F.coalesce(F.col("old_mode") != F.col("new_mode"), F.lit(False)).alias("mode_changed"))


def score(similarity: Column, exact: Column, path: Column, owner: Column, name: Column, signature: Column, overlap: Column, group: Column, callers: Column) -> Column:
    """How well two regions match; the flags are 0 or 1."""
    # What each piece of evidence counts.
    return F.floor(similarity / 2) + exact * 24 + path * 8 + owner * 18 + name * 12 + signature * 10 + overlap * 18 + group * 12 + callers * 24


def assigned(scored: DataFrame) -> DataFrame:
    """scored(old, new, score): pairs of ACCEPT or more within MARGIN of their old side's best; uncertain if several remain."""
    best = F.max("score").over(Window.partitionBy("old"))
    near = scored.where(F.col("score") >= KEEP).withColumn("best", best).where((F.col("score") >= ACCEPT) & (F.col("score") + MARGIN >= F.col("best")))
    return near.withColumn("uncertain", F.count("*").over(Window.partitionBy("old")) > 1).drop("best")


def mutual_best(scored: DataFrame) -> DataFrame:
    """scored(old, new, score): pairs of ACCEPT or more that are either side's best by more than MARGIN over its runner-up."""
    out = scored
    for side in ("old", "new"):
        w = Window.partitionBy(side).orderBy(F.desc("score"), "old", "new")
        out = out.withColumn(f"{side}_rank", F.row_number().over(w)).withColumn(f"{side}_next", F.lead("score").over(w))
    win = lambda s: (F.col(f"{s}_rank") == 1) & (F.coalesce(F.col("score") - F.col(f"{s}_next"), F.lit(1 << 30)) > MARGIN)
    return out.where((F.col("score") >= ACCEPT) & win("old") & win("new")).select("old", "new", "score")


def similar(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, similarity) of all pairs of whole texts(key, text) that share a trigram, or whose tokens are equal; keys are unique."""
    # a text's trigrams are worked out once, with their number
    once = lambda size: F.inline(let(X.trigrams(X.tokens("text")), lambda t: F.transform(t, lambda g: F.struct(F.size(t).alias(size), g.alias("g")))))
    grams = lambda df, side, size: df.select(F.col("key").alias(side), once(size))
    shared = grams(old, "old", "x").join(grams(new, "new", "y"), "g").groupBy("old", "new", "x", "y").agg(F.count("*").alias("n"))
    few = F.explode(F.filter(F.array(X.tokens("text")), lambda w: F.size(w) < 3)).alias("w")  # texts of no trigram
    bare = old.select(F.col("key").alias("old"), few).join(new.select(F.col("key").alias("new"), few), "w").select("old", "new", F.lit(100).cast("int").alias("similarity"))
    # equal sets of trigrams give 100 as equal token lists do
    return shared.select("old", "new", F.floor(F.col("n") * 200 / (F.col("x") + F.col("y"))).cast("int").alias("similarity")).unionByName(bare)


def _shingled(texts: DataFrame) -> DataFrame:
    """texts(side, id, n, text) as (side, id, n, w, t, h): tokens, distinct trigrams, and what those of one side that are alike in all similarities share."""
    t = texts.select("side", "id", "n", X.tokens("text").alias("w")).where("w is not null").withColumn("t", X.trigrams(F.col("w")))
    return stored(t.withColumn("h", F.sha2(F.to_json(F.struct(F.array_sort("t").alias("t"), F.when(F.size("t") == 0, F.col("w")).alias("w"))), 256)))


def shared_shingles(both: DataFrame, least: int = ACCEPT - MARGIN, chunk: int = 1024) -> DataFrame:
    """(old, new, score): the similarity of every pair of both(side, id, w, t), a text of either side, that can reach `least`.

    Such a pair shares a trigram among the rarest of each, all but (least / (200 - least)) of them. A
    trigram's texts are joined in chunks. Texts of no trigram pair up with those of equal tokens. Trigrams go by
    number, and only those of both sides are compared, so a pair costs no second look at its texts.
    """
    grams = both.select("id", "side", F.size("t").alias("size"), F.explode("t").alias("g"))
    held = grams.groupBy("g").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"n_{s}") for s in ("old", "new")])
    held = stored(held.where("n_old > 0 and n_new > 0").withColumn("k", F.monotonically_increasing_id()))
    grams = stored(grams.join(held, "g").select("id", "side", "size", "k", "n_old", "n_new"))
    # grams of one side only come first among the rarest in any order, as they pair nothing
    alone = F.col("size") - F.count("*").over(Window.partitionBy("side", "id"))
    rare = Window.partitionBy("side", "id").orderBy(F.col("n_old") + F.col("n_new"), "k")
    first = grams.withColumn("r", F.row_number().over(rare) + alone).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * least / (200 - least)) + 1)
    own = lambda side: F.pmod(F.xxhash64("id"), F.ceil(F.col(f"n_{side}") / chunk)).cast("long")
    all_ = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n_{side}") / chunk).cast("long") - 1))
    a = first.where("side = 'old'").select("k", F.col("id").alias("old"), F.col("size").alias("x"), own("old").alias("i"), all_("new").alias("j"))
    b = first.where("side = 'new'").select("k", F.col("id").alias("new"), F.col("size").alias("y"), own("new").alias("j"), all_("old").alias("i"))
    pairs = a.join(b, ["k", "i", "j"]).where(F.least("x", "y") * 200 >= (F.col("x") + F.col("y")) * least).select("old", "new", "x", "y").distinct()
    sets = stored(grams.groupBy("side", "id").agg(F.collect_list("k").alias("ks")))
    of = lambda side, as_: sets.where(F.col("side") == side).select(F.col("id").alias(side), F.col("ks").alias(as_))
    pairs = pairs.join(of("old", "p"), "old").join(of("new", "q"), "new")
    scored = pairs.select("old", "new", F.floor(F.size(F.array_intersect("p", "q")) * 200 / (F.col("x") + F.col("y"))).cast("int").alias("score"))
    bare = lambda side: both.where((F.col("side") == side) & (F.size("t") == 0)).select(F.col("id").alias(side), "w")
    return scored.unionByName(bare("old").join(bare("new"), "w").select("old", "new", F.lit(100).cast("int").alias("score")))


def renames(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed to added texts(key, text): first those of equal blobs on one side each, then mutual bests by similarity.

    Texts of a side with equal trigrams stand as one in the search; they tie, so none of them is matched, but they remain rivals.
    """
    blob = lambda df, side: stored(df.where("text is not null").groupBy("text").agg(F.count("*").alias(f"n_{side}"), F.min("key").alias(side)))
    a, b = blob(old, "old"), blob(new, "new")
    same = stored(a.join(b, "text").where("n_old = 1 and n_new = 1").select("old", "new", F.lit(100).cast("int").alias("score")))
    rest = lambda df, side: df.join(same.select(side), side, "left_anti").select(F.lit(side).alias("side"), F.col(side).alias("id"), F.col(f"n_{side}").alias("n"), "text")
    both = _shingled(rest(a, "old").unionByName(rest(b, "new")))
    one = stored(both.groupBy("side", "h").agg(F.min("id").alias("id"), F.sum("n").alias("n")).drop("h"))
    found = mutual_best(shared_shingles(both.drop("n").join(one, ["side", "id"])))
    for side in ("old", "new"):
        found = found.join(one.where((F.col("side") == side) & (F.col("n") == 1)).select(F.col("id").alias(side)), side, "left_semi")
    return same.unionByName(found.select("old", "new", "score"))


def passage(words_a: Column, words_b: Column) -> Column:
    """Evidence that a passage lives on in a text: exact, edited (four fifths and two telling words), weak (half), none."""
    shared = F.size(F.array_intersect(words_a, words_b)) * 100
    all_ = F.greatest(F.size(F.array_distinct(words_a)), F.lit(1))
    return F.when(words_a == words_b, "exact").when((shared >= all_ * 80) & X.distinctive(F.array_intersect(words_a, words_b), 2), "edited").when(shared >= all_ * 50, "weak").otherwise("none")


def paragraphs(files: DataFrame, key: str = "file_key", text: str = "content") -> DataFrame:
    """(key, number, first_line, last_line, start, end): maximal runs of lines that aren't blank, by 0-based characters."""
    lines = files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))
    by = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("start", F.sum(F.length("line") + 1).over(by) - F.length("line") - 1).withColumn("blank", F.trim("line") == "")
    lines = lines.withColumn("island", F.sum(F.col("blank").cast("int")).over(by)).where("not blank")
    out = lines.groupBy(key, "island").agg((F.min("n") + 1).cast("long").alias("first_line"), (F.max("n") + 1).cast("long").alias("last_line"), F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("end"))
    return out.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("island")).cast("long")).drop("island")


def log(revisions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Revisions of each key, newest first, whose value differs from the one before; the first counts as added."""
    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag(value).over(w)
    status = F.when(F.row_number().over(w) == 1, "added").when(~prev.eqNullSafe(F.col(value)), "modified")
    return revisions.withColumn("status", status).where("status is not null").withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))).cast("long"))


def combined(records: DataFrame) -> DataFrame:
    """records(commit, uncertain, changed, note): one a commit, flags OR-ed, notes united."""
    return records.groupBy("commit").agg(F.bool_or("uncertain").alias("uncertain"), F.bool_or("changed").alias("changed"), F.sort_array(F.collect_set("note")).alias("notes"))


def moved_directories(pairs: DataFrame) -> DataFrame:
    """pairs(old_path, new_path, blob): directories all of whose files went to one other, with two different blobs at least."""
    dir_ = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    p = pairs.select(dir_(F.col("old_path")).alias("old"), dir_(F.col("new_path")).alias("new"), "blob")
    one = p.groupBy("old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new"), F.count_distinct("blob").alias("blobs")).where("n = 1 and blobs >= 2 and old <> new")
    back = p.groupBy("new").agg(F.count_distinct("old").alias("m")).where("m = 1")
    return one.join(back, "new").select("old", "new")
