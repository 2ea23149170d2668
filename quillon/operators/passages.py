"""Where passages stand in texts, token by token and with places; and what became of them in a later revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.names import let
from .history import passage
from .tables import SMALL, stored

#: Tokens at a passage's beginning that it is looked up by; a shorter one goes by all it has.
SEED = 4


def _seeds(words: Column, n: int) -> Column:
    """A hash of every run of n tokens, in order."""
    return F.transform(X.runs(words, n, "\u0001"), lambda x: F.xxhash64(x))


def _start(text: Column, words: Column, k: Column) -> Column:
    """0-based character at which the k-th token (from 1) begins: what stands between tokens, and the tokens before it."""
    size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return size(F.split(text, X.TOKEN, -1), k) + size(words, k - 1)


def occurrences(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, key, number, start, end) of each place at which the tokens of passages(passage, text) stand in a row in texts(key, text).

    Places may overlap; number counts from 1 in a text, start and end are 0-based characters from the
    first token to behind the last. White space between tokens plays no part. A passage without tokens
    stands nowhere. Keys and passages are unique.

    Hashes of runs of SEED tokens are joined with those that passages begin with; texts are not carried
    through that join, but fetched for the places it finds, where all tokens are compared.
    """
    p = stored(passages.select("passage", X.tokens("text").alias("want")).where("want is not null and size(want) > 0").withColumn("n", F.least(F.size("want"), F.lit(SEED))))
    places = None
    for n in [r[0] for r in p.select("n").distinct().orderBy("n").collect()]:  # at most SEED lengths
        known = p.where(F.col("n") == n).select(_seeds(F.slice("want", F.lit(1), F.lit(n)), n)[0].alias("seed"), "passage")
        rows = texts.select("key", F.posexplode(_seeds(X.tokens("text"), n)).alias("at", "seed"))
        hit = rows.join(F.broadcast(known) if known.count() <= SMALL else known, "seed").select("key", "passage", (F.col("at") + 1).alias("at"))
        places = hit if places is None else places.unionByName(hit)
    if places is None:
        return texts.select("key").limit(0).join(passages.select("passage").limit(0)).select("passage", "key", *(F.lit(0).cast("long").alias(x) for x in ("number", "start", "end")))
    places = stored(places)
    wanted = places.join(p.select("passage", "want"), "passage")
    found = texts.select("key", "text").join(F.broadcast(wanted) if places.count() <= SMALL else wanted, "key").withColumn("words", X.tokens("text"))
    found = found.where(F.slice("words", F.col("at"), F.size("want")) == F.col("want"))
    last = F.col("at") + F.size("want") - 1
    out = found.select("passage", "key", _start(F.col("text"), F.col("words"), F.col("at")).cast("long").alias("start"), (_start(F.col("text"), F.col("words"), last) + F.length(F.element_at("words", last))).cast("long").alias("end"))
    return out.select("passage", "key", F.row_number().over(Window.partitionBy("passage", "key").orderBy("start")).cast("long").alias("number"), "start", "end")


def projected(pairs: DataFrame) -> DataFrame:
    """pairs(id, before, after, start, end) with `fate` and, where it is present, `to_start` and `to_end`: a passage of one revision in the next.

    present: its tokens stand in `after`, as often as in `before`, and it is the one of its own number; or
    the text is unchanged. absent: they stand nowhere, and nothing of it is left to tell. unresolved: else, as
    where copies came or went, or where it was edited. start and end are 0-based characters.
    """
    cut = pairs.withColumn("said", F.substring("before", F.col("start") + 1, F.col("end") - F.col("start")))
    cut = stored(cut)
    found = {}
    for side in ("before", "after"):
        # a passage is looked for in its own two texts only
        words = cut.select("id", "start", X.tokens(side).alias("words"), X.tokens("said").alias("want"), F.col(side).alias("text"))
        runs = let(F.struct("words", "want"), lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s["words"]), F.lit(1))), lambda k: F.when(F.slice(s["words"], k, F.size(s["want"])) == s["want"], k)), lambda k: k.isNotNull()))
        found[side] = words.select("id", F.when(F.size("want") > 0, runs).otherwise(F.array().cast("array<int>")).alias(f"at_{side}"))
    both = cut.join(found["before"], "id").join(found["after"], "id")
    before, after = X.tokens("before"), X.tokens("after")
    own = F.array_position(F.transform("at_before", lambda k: _start(F.col("before"), before, k)), _start(F.col("before"), before, _first(F.col("before"), before, F.col("start"))))
    both = both.withColumn("own", own.cast("int"))
    same = F.col("before") == F.col("after")
    one = (F.size("at_after") > 0) & (F.size("at_before") == F.size("at_after")) & (F.col("own") > 0)
    left = passage(X.tokens("said"), X.tokens("after"))
    fate = F.when(same, "present").when(one, "present").when((F.size("at_after") == 0) & (left == "none") & (F.size(X.tokens("said")) > 0), "absent").otherwise("unresolved")
    k = F.element_at("at_after", F.greatest("own", F.lit(1)))
    last = k + F.size(X.tokens("said")) - 1
    out = both.withColumn("fate", fate)
    to_start = F.when(same, F.col("start")).when(F.col("fate") == "present", _start(F.col("after"), after, k))
    to_end = F.when(same, F.col("end")).when(F.col("fate") == "present", _start(F.col("after"), after, last) + F.length(F.element_at(after, last)))
    return out.select("id", "fate", to_start.cast("long").alias("to_start"), to_end.cast("long").alias("to_end"))


def _first(text: Column, words: Column, start: Column) -> Column:
    """Number of the first token at or behind a place."""
    gaps = F.split(text, X.TOKEN, -1)
    ends = F.aggregate(F.arrays_zip(gaps.alias("g"), words.alias("w")), F.struct(F.lit(0).alias("at"), F.lit(1).alias("k")), lambda a, x: F.struct((a["at"] + F.length(x["g"]) + F.coalesce(F.length(x["w"]), F.lit(0))).alias("at"), F.when(a["at"] + F.length(x["g"]) < start, a["k"] + 1).otherwise(a["k"]).alias("k")))
    return ends["k"]
