"""Serialized assets: documents, references, and prefabs composed level by level.

Tables, all keyed by asset: objects(asset, guid, id, class, stripped, name), refs(asset, id, field,
guid, target), placements(asset, id, source_guid, parent_guid, parent_id), overrides(asset,
placement, pos, guid, id, property, value, ref_guid, ref_id) and removals(asset, placement, guid, id).
A pointer is null where its id is 0.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure
from .tables import stored

_HEADER = re.compile(r"^--- !u!(\d+) &(-?\d+)(?: (stripped))?[^\n]*$", re.M)
_POINTER = re.compile(r"\{\s*fileID:\s*(-?\d+)\s*(?:,\s*guid:\s*([0-9a-fA-F]+)\s*)?(?:,\s*type:\s*\d+\s*)?\}")


def documents(files: DataFrame, key: str = "asset", text: str = "content") -> DataFrame:
    """(asset, class, id, stripped, start, body) of each `--- !u!CLASS &ID` document of a file."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n--- !u!", -1)
    out = files.select(key, F.posexplode(parts).alias("n", "part")).where("n > 0")
    head = F.substring_index("part", "\n", 1)
    return out.select(key, F.col("n").alias("number"), F.regexp_extract(head, r"^(\d+)", 1).cast("int").alias("class"), F.regexp_extract(head, r"&(-?\d+)", 1).cast("long").alias("id"), head.rlike(r"\sstripped\b").alias("stripped"), F.expr("substring(part, locate('\n', part) + 1)").alias("body"))


def references_of(body: str) -> list[tuple[str, str, int]]:
    """(field, guid, id) of each pointer in a YAML body; items of lists are `field.Array.data[i]`."""
    stack: list[list] = []  # indent, path, next item
    out = []
    for line in body.split("\n"):
        m = re.match(r"^( *)((?:- )*)(?:([^\s:{}\[\]][^:{}]*):)?(.*)$", line)
        if not m or not line.strip():
            continue
        indent, dashes, name, rest = len(m[1]), len(m[2]) // 2, m[3], m[4]
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not (dashes and stack[-1][3])):
            stack.pop()
        path = stack[-1][1] if stack else ""
        for _ in range(dashes):
            owner = stack[-1] if stack else None
            n = owner[2] if owner else 0
            if owner:
                owner[2] += 1
            path = f"{path}.Array.data[{n}]"
            stack.append([indent + 1, path, 0, False])
            indent += 2
        if name is not None:
            path = f"{path}.{name.strip()}" if path and "." in path or path and stack and path else name.strip()
            stack.append([indent, path, 0, not rest.strip()])
        if p := _POINTER.search(rest):
            out.append((path.partition(".")[2] if path.count(".") and re.match(r"^[A-Z]\w*\.", path) else path, (p[2] or "").lower(), int(p[1])))
    return out


def extract(files: DataFrame, key: str = "asset", text: str = "content") -> DataFrame:
    """(asset, id, field, guid, target): the pointers of each object."""

    @F.pandas_udf("array<struct<field:string,guid:string,target:bigint>>")
    def refs(bodies: pd.Series) -> pd.Series:
        names = ("field", "guid", "target")
        return bodies.map(lambda b: [dict(zip(names, r, strict=True)) for r in references_of(b or "")])

    return documents(files, key, text).select(key, "id", F.inline(refs("body")))


def resolved(refs: DataFrame, guids: DataFrame) -> DataFrame:
    """refs with the asset that a guid stands for, where it stands for one; no guid means the asset itself."""
    one = guids.groupBy("guid").agg(F.count_distinct("asset").alias("n"), F.min("asset").alias("to")).where("n = 1").drop("n")
    return refs.where("target <> 0").join(one, "guid", "left").withColumn("to", F.when(F.col("guid") == "", F.col("asset")).otherwise(F.col("to"))).withColumn("uncertain", F.col("to").isNull())


def compose(objects: DataFrame, placements: DataFrame, overrides: DataFrame, removals: DataFrame) -> DataFrame:
    """(asset, path, source, id, name, alive) of each asset's objects and of those that its placements bring in.

    `path` is the placements' ids from the asset down, then the object's id. Names follow the
    overrides of the outermost placement that sets them, the last of its list. Removed objects
    aren't alive; what stands below them is left to `cascade`. An asset isn't placed within itself,
    so the expansion ends.
    """
    guid = objects.select("guid", F.col("asset").alias("source")).distinct()
    own = objects.where("not stripped").select("asset", F.col("id").cast("string").alias("path"), F.col("asset").alias("source"), "id", "name", F.lit(True).alias("alive"), F.array("asset").alias("through"))
    placed = placements.join(guid, F.col("source_guid") == F.col("guid")).select("asset", F.col("id").alias("placement"), F.col("source").alias("below")).where("asset <> below")
    last = overrides.where("property = 'm_Name'").withColumn("n", F.row_number().over(Window.partitionBy("asset", "placement", "guid", "id").orderBy(F.desc("pos")))).where("n = 1")
    named = last.join(guid.withColumnRenamed("source", "of"), "guid").select(F.col("asset").alias("a"), F.col("placement").alias("p"), F.col("of").alias("s"), F.col("id").alias("i"), F.col("value").alias("set"))
    gone = removals.join(guid.withColumnRenamed("source", "of"), "guid").select(F.col("asset").alias("ra"), F.col("placement").alias("rp"), F.col("of").alias("rs"), F.col("id").alias("ri"), F.lit(True).alias("removed")).distinct()
    out, level = own, own
    while True:
        level = level.where("alive").alias("c").join(placed.alias("p"), F.col("c.asset") == F.col("p.below")).where("not array_contains(c.through, p.asset)")
        level = level.select("p.asset", "p.placement", F.concat_ws("/", F.col("p.placement").cast("string"), "c.path").alias("path"), "c.source", "c.id", "c.name", "c.alive", F.concat(F.array("p.asset"), "c.through").alias("through"))
        level = level.join(named, (F.col("asset") == F.col("a")) & (F.col("placement") == F.col("p")) & (F.col("source") == F.col("s")) & (F.col("id") == F.col("i")), "left")
        level = level.join(gone, (F.col("asset") == F.col("ra")) & (F.col("placement") == F.col("rp")) & (F.col("source") == F.col("rs")) & (F.col("id") == F.col("ri")), "left")
        level = stored(level.select("asset", "path", "source", "id", F.coalesce("set", "name").alias("name"), F.col("removed").isNull().alias("alive"), "through"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("through")


def cascade(composed: DataFrame, parents: DataFrame) -> DataFrame:
    """composed with everything below a removed object removed; parents(asset, path, parent)."""
    edges = parents.select(F.concat_ws("\u0001", "asset", "parent").alias("src"), F.concat_ws("\u0001", "asset", "path").alias("dst"))
    key = F.concat_ws("\u0001", "asset", "path")
    dead = closure(edges, composed.where("not alive").select(F.lit(0).alias("root"), key.alias("node"))).select("node").distinct().withColumn("dead", F.lit(True))
    return composed.withColumn("k", key).join(dead, F.col("k") == F.col("node"), "left").withColumn("alive", F.col("alive") & F.col("dead").isNull()).drop("k", "node", "dead")


def last_override(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """base(keys, property, value) with the last override(keys, property, pos, value) of each property."""
    w = Window.partitionBy(*keys, "property").orderBy(F.desc("pos"))
    last = overrides.withColumn("n", F.row_number().over(w)).where("n = 1").select(*keys, "property", F.col("value").alias("new"), F.lit(True).alias("set"))
    return base.join(last, [*keys, "property"], "full").select(*keys, "property", F.when(F.col("set"), F.col("new")).otherwise(F.col("value")).alias("value"))


def truncated(refs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Array overrides `field.Array.size`: items at and beyond the size are dropped. sizes(asset, id, field, size)."""
    at = F.regexp_extract("field", r"^(.*)\.Array\.data\[(\d+)\]", 2).try_cast("long")
    r = refs.withColumn("base", F.regexp_extract("field", r"^(.*)\.Array\.data\[(\d+)\]", 1)).withColumn("at", at)
    s = sizes.select("asset", "id", F.col("field").alias("base"), "size")
    return r.join(s, ["asset", "id", "base"], "left").where("size is null or at is null or at < size").drop("base", "at", "size")


def handle(asset, object_id):
    """`unity@BASE64URL(asset)#id` as a Column."""
    return F.concat(F.lit("unity@"), F.rtrim(F.translate(F.base64(F.encode(asset, "utf-8")), "+/", "-_"), F.lit("=")), F.lit("#"), object_id.cast("string"))


def decoded(text):
    """(asset, object) of a handle as a Column struct; null if it is none."""
    t = F.regexp_extract(text, r"^unity@([A-Za-z0-9_-]*)#(.*)$", 1)
    padded = F.rpad(F.translate(t, "-_", "+/"), (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("="))
    asset = F.call_function("try_to_binary", padded, F.lit("base64"))
    asset = F.call_function("try_validate_utf8", asset.cast("string"))
    return F.when(text.rlike(r"^unity@[A-Za-z0-9_-]*#") & asset.isNotNull(), F.struct(asset.alias("asset"), F.regexp_extract(text, r"^unity@[^#]*#(.*)$", 1).alias("object")))


def targets(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """wanted(text) with (asset, object, problem): what a search's target means among assets(asset, path, guid).

    A handle means an object of its asset, if that is here; else the one asset of that path or guid is meant,
    without an object. problem: `not found`, `ambiguous`, `other workspace`, or null.
    """
    w = wanted.select("text").distinct().withColumn("h", decoded(F.col("text")))
    here = assets.select(F.col("asset").alias("known")).distinct()
    by_handle = w.where("h is not null").join(here, F.col("h.asset") == F.col("known"), "left")
    by_handle = by_handle.select("text", F.col("known").alias("asset"), F.when(F.col("known").isNotNull(), F.col("h.object")).alias("object"), F.when(F.col("known").isNull(), "other workspace").alias("problem"))
    plain = w.where("h is null").select("text")
    names = assets.select(F.col("asset").alias("a"), F.col("path").alias("text")).unionByName(assets.select(F.col("asset").alias("a"), F.col("guid").alias("text")))
    several = plain.join(names, "text", "left").groupBy("text").agg(F.count_distinct("a").alias("n"), F.min("a").alias("a"))
    problem = F.when(F.col("n") == 0, "not found").when(F.col("n") > 1, "ambiguous")
    return by_handle.unionByName(several.select("text", F.when(F.col("n") == 1, F.col("a")).alias("asset"), F.lit(None).cast("string").alias("object"), problem.alias("problem")))


def script_types(refs: DataFrame, guids: DataFrame, types: DataFrame) -> DataFrame:
    """(asset, id, type): what the m_Script pointers of refs(asset, id, field, guid, target) mean: the type(asset, type) of the one asset(guid, asset, path) of that guid.

    An asset that is no `.cs` file gives no type: what lies inside a library isn't guessed.
    """
    one = guids.groupBy("guid").agg(F.count_distinct("asset").alias("n"), F.min("asset").alias("script"), F.min("path").alias("path")).where("n = 1 and path like '%.cs'")
    said = refs.where("field = 'm_Script' and target <> 0").join(one.select("guid", "script"), "guid")
    return said.join(types.select(F.col("asset").alias("script"), "type"), "script").select("asset", "id", "type")


def incoming(edges: DataFrame, asset: str, object_id: int | None = None) -> DataFrame:
    out = edges.where(F.col("to") == asset)
    return out if object_id is None else out.where(F.col("target") == object_id)


def outgoing(edges: DataFrame, asset: str) -> DataFrame:
    return edges.where(F.col("asset") == asset)


def instances(composed: DataFrame, types: DataFrame, wanted: str, exact: bool = False) -> DataFrame:
    """Living objects whose script type is `wanted`, or has it among its ancestry; types(id, type, ancestry)."""
    hit = F.col("type") == wanted
    return composed.where("alive").join(types, "id").where(hit if exact else hit | F.array_contains("ancestry", wanted))
