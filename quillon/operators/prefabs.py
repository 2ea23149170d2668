"""References of composed assets: aliases, override targets, and pointers lifted level by level.

Tables as in assets, with stripped(asset, id, placement, guid, target): an asset's stand-ins for
objects that a placement brings in. composed is the result of assets.compose(). A pointer into the
asset that is placed moves with it: its target is re-rooted below the placement at each level, also where
it came from another asset. Overrides reach one instance, or none if their target isn't unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

# Classes of transforms.
TRANSFORMS = (4, 224)


def _guids(objects: DataFrame) -> DataFrame:
    """(guid, to) of guids that stand for one asset."""
    return objects.groupBy("guid").agg(F.count_distinct("asset").alias("n"), F.min("asset").alias("to")).where("n = 1 and guid <> ''").drop("n")


def _placed(objects: DataFrame, placements: DataFrame) -> DataFrame:
    """(asset, placement, below, own): each placement with the asset it places and that one's guid."""
    g = _guids(objects)
    return placements.join(g, F.col("source_guid") == F.col("guid")).select("asset", F.col("id").alias("placement"), F.col("to").alias("below"), F.col("guid").alias("own")).where("asset <> below")


def _below(pointers: DataFrame, objects: DataFrame, placements: DataFrame, composed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pointers(asset, placement, guid, target, ...) into placed assets: those with `inner`, the path of the one object that they mean there, and those that go by the placed asset's aliases."""
    rows = pointers.join(_placed(objects, placements), ["asset", "placement"])
    own = (F.col("guid") == "") | (F.col("guid") == F.col("own"))
    one = composed.groupBy(F.col("asset").alias("_in"), F.col("source").alias("_of"), F.col("id").alias("_id")).agg(F.count("*").alias("_n"), F.min("path").alias("inner")).where("_n = 1")
    far = rows.where(~own).join(_guids(objects).withColumnRenamed("guid", "_g"), F.col("guid") == F.col("_g"))
    far = far.join(one, (F.col("below") == F.col("_in")) & (F.col("to") == F.col("_of")) & (F.col("target") == F.col("_id")))
    return far.select(*rows.columns, "inner"), rows.where(own)


def aliases(objects: DataFrame, stripped: DataFrame, placements: DataFrame, composed: DataFrame) -> DataFrame:
    """(asset, id, path): what an id within an asset means, its own objects and its stand-ins. Stand-ins for stand-ins take a round each."""
    known = objects.where("not stripped").select("asset", "id", F.col("id").cast("string").alias("path"))
    found, open_ = _below(stripped, objects, placements, composed)
    path = F.concat_ws("/", F.col("placement").cast("string"), "inner").alias("path")
    known = stored(known.unionByName(found.select("asset", "id", path)).distinct())
    open_ = stored(open_)
    while True:
        got = open_.join(known.select(F.col("asset").alias("below"), F.col("id").alias("target"), F.col("path").alias("inner")), ["below", "target"]).select("asset", "id", path)
        got = stored(got.join(known, ["asset", "id"], "left_anti").distinct())
        if got.isEmpty():
            return known
        known = stored(known.unionByName(got))


def override_targets(overrides: DataFrame, objects: DataFrame, placements: DataFrame, composed: DataFrame, known: DataFrame) -> DataFrame:
    """overrides(asset, placement, pos, guid, id, ...) with `path`, the object in the composed asset that each reaches; null if there is none, or several."""
    rows = overrides.withColumnRenamed("id", "target")
    found, own = _below(rows, objects, placements, composed)
    own = own.join(known.select(F.col("asset").alias("below"), F.col("id").alias("target"), F.col("path").alias("inner")), ["below", "target"])
    hit = found.select("asset", "placement", "pos", "inner").unionByName(own.select("asset", "placement", "pos", "inner"))
    return overrides.join(hit, ["asset", "placement", "pos"], "left").withColumn("path", F.when(F.col("inner").isNotNull(), F.concat_ws("/", F.col("placement").cast("string"), "inner"))).drop("inner")


def _meant(rows: DataFrame, guids: DataFrame, known: DataFrame, guid: str, target: str) -> DataFrame:
    """rows(asset, ...) with (to, object) of a pointer that stands in the asset; of a null one both are null."""
    g = guids.select(F.col("guid").alias("_g"), F.col("to").alias("_to"))
    k = known.select(F.col("asset").alias("_a"), F.col("id").alias("_i"), F.col("path").alias("_p"))
    out = rows.join(g, F.col(guid) == F.col("_g"), "left")
    null = F.coalesce(F.col(target), F.lit(0)) == 0
    out = out.withColumn("to", F.when(~null, F.when(F.coalesce(F.col(guid), F.lit("")) == "", F.col("asset")).otherwise(F.col("_to"))))
    out = out.join(k, (F.col("to") == F.col("asset")) & (F.col("asset") == F.col("_a")) & (F.col(target) == F.col("_i")), "left")
    return out.withColumn("object", F.when(F.col("to") == F.col("asset"), F.col("_p")).when(F.col("to").isNotNull(), F.col(target).cast("string"))).drop("_g", "_to", "_a", "_i", "_p")


def _item(field: Column) -> tuple[Column, Column]:
    return F.regexp_extract(field, r"^(.*)\.Array\.data\[(\d+)\]", 1), F.regexp_extract(field, r"^(.*)\.Array\.data\[(\d+)\]", 2).try_cast("long")


ROW = ["asset", "path", "class", "field", "to", "object", "through"]


def references(objects: DataFrame, refs: DataFrame, placements: DataFrame, overrides: DataFrame, composed: DataFrame, known: DataFrame) -> DataFrame:
    """(asset, path, field, to, object) of all pointers of composed assets; null pointers and those that mean nothing have a null object.

    refs(asset, id, field, guid, target), overrides(asset, placement, pos, guid, id, property, value, ref_guid, ref_id).
    In the order of a placement's list, `field.Array.size` drops the items from that size on, and other
    properties set a pointer that is there, or one that isn't null. A transform without a father gets the placement's
    parent. An asset isn't placed within itself. m_Script is a field as others, so an override changes the script.
    """
    guids = stored(_guids(objects))
    placed = _placed(objects, placements).join(placements.select("asset", F.col("id").alias("placement"), "parent_guid", "parent_id"), ["asset", "placement"])
    placed = _meant(placed, guids, known, "parent_guid", "parent_id").select("asset", "placement", "below", F.col("to").alias("parent_to"), F.col("object").alias("parent"))
    placed = stored(placed)
    changes = override_targets(overrides, objects, placements, composed, known).where("path is not null and property <> 'm_Name'")
    size = F.regexp_extract("property", r"^(.*)\.Array\.size$", 1)
    cuts = stored(changes.where(size != "").select(F.col("asset").alias("_a"), F.col("path").alias("_p"), size.alias("_base"), F.col("value").try_cast("long").alias("_size"), F.col("pos").alias("_at")).where("_size is not null"))
    sets = _meant(changes.where(size == ""), guids, known, "ref_guid", "ref_id").select("asset", "path", F.col("property").alias("field"), "pos", "to", "object", (F.coalesce("ref_id", F.lit(0)) == 0).alias("null"))
    last = F.row_number().over(Window.partitionBy("asset", "path", "field").orderBy(F.desc("pos")))
    sets = stored(sets.withColumn("given", F.max(~F.col("null")).over(Window.partitionBy("asset", "path", "field"))).withColumn("n", last).where("n = 1").drop("n"))
    own = _meant(refs.join(objects.where("not stripped").select("asset", "id", "class"), ["asset", "id"]), guids, known, "guid", "target")
    level = stored(own.select("asset", F.col("id").cast("string").alias("path"), "class", "field", "to", "object", F.array("asset").alias("through")))
    alive = stored(composed.where("alive").select("asset", "path"))
    kinds = stored(composed.join(objects.select(F.col("asset").alias("source"), "id", "class"), ["source", "id"]).select("asset", "path", "class"))
    out = level
    depth = F.size(F.split("path", "/"))
    deepest = composed.agg(F.max(depth)).first()[0] or 0
    for n in range(2, deepest + 1):  # a level adds a placement to each path
        p = placed.alias("p")
        up = level.alias("r").join(p, F.col("r.asset") == F.col("p.below")).where("not array_contains(r.through, p.asset)")
        inside = F.col("r.to") == F.col("p.below")
        under = lambda c: F.concat_ws("/", F.col("p.placement").cast("string"), c)
        orphan = (F.col("r.field") == "m_Father") & F.col("r.to").isNull() & F.col("r.class").isin(*TRANSFORMS) & F.col("p.parent_to").isNotNull()
        to = F.when(orphan, F.col("p.parent_to")).when(inside, F.col("p.asset")).otherwise(F.col("r.to"))
        obj = F.when(orphan, F.col("p.parent")).when(inside & F.col("r.object").isNotNull(), under(F.col("r.object"))).otherwise(F.col("r.object"))
        up = up.select("p.asset", under(F.col("r.path")).alias("path"), "r.class", "r.field", to.alias("to"), obj.alias("object"), F.concat(F.array("p.asset"), "r.through").alias("through"))
        # the overrides of this placement: set pointers that are there, add those that aren't
        now = sets.where(depth == n).join(kinds, ["asset", "path"])
        now = now.select("asset", "path", "field", F.col("class").alias("_class"), "pos", F.col("to").alias("_to"), F.col("object").alias("_object"), "given")
        both = up.join(now, ["asset", "path", "field"], "full").where("class is not null or given")
        base, item = _item(F.col("field"))
        both = both.withColumn("_b", base).withColumn("_k", item).withColumn("_since", F.coalesce("pos", F.lit(-1)))
        dropped = (F.col("asset") == F.col("_a")) & (F.col("path") == F.col("_p")) & (F.col("_b") == F.col("_base")) & (F.col("_k") >= F.col("_size")) & (F.col("_at") > F.col("_since"))
        both = both.join(cuts, dropped, "left_anti")
        set_ = F.col("pos").isNotNull()
        level = stored(both.select("asset", "path", F.coalesce("class", "_class").alias("class"), "field", F.when(set_, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(set_, F.col("_object")).otherwise(F.col("object")).alias("object"), F.coalesce("through", F.array("asset")).alias("through")))
        out = out.unionByName(level)
    return out.join(alive, ["asset", "path"], "left_semi").select("asset", "path", "field", "to", "object")
