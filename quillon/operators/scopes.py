"""Names in their scopes: what a module makes of a declaration, what imports make of a written name, and what it then means.

A written name is turned into the full names that it may have, each with its distance, and these
are joined with declarations by equality. No pairs of bare names arise: a name that many
declarations share costs no more than the full names asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .tables import SMALL, discard, stored

#: What a name is asked for by: sites that agree in these have the same meanings.
ASKED = ["project", "file_key", "scope", "module", "written"]
#: Distances beyond any enclosing scope: outermost, imported by its own name, within an imported namespace.
OUTERMOST, IMPORTED, WITHIN = 1 << 20, (1 << 20) + 1, (1 << 20) + 2


def contextual(decls: DataFrame, memberships: DataFrame) -> DataFrame:
    """A declaration for each membership(file_key, project, module) of its file, with qualified name, owner and namespace as seen from the module.

    A file of several projects gives a row for each. A null module is none. Columns project and module of decls are replaced.
    """
    own = decls.drop("project", "module").join(memberships.select("file_key", "project", F.coalesce("module", F.lit("")).alias("module")), "file_key")
    return own.withColumns({k: N.context_name(F.coalesce(F.col(k), F.lit("")), "module") for k in ("qualified", "owner", "namespace")})


def head(name: Column) -> Column:
    """First part of a written name."""
    return F.regexp_extract(name, r"^([^.:<]*)", 1)


def _known_heads(known: DataFrame) -> DataFrame | None:
    """(_head): each alias of any file, to be sent to all rows; None if there are too many for that."""
    heads = known.select(F.col("alias").alias("_head")).distinct()
    return F.broadcast(heads) if heads.count() <= SMALL else None


def aliases(imports: DataFrame) -> DataFrame:
    """(file_key, alias, path): what each alias of imports(file_key, pos, path, alias) stands for, through other aliases of its file.

    Of several imports with one alias the first counts. Paths are extended by pointers of pointers, so a
    chain of n takes about log n rounds. An alias that leads into a cycle keeps the path that was written.
    Only paths that begin like some alias go through rounds.
    """
    first = imports.where("alias is not null and alias <> '' and path is not null").groupBy("file_key", "alias").agg(F.min_by("path", "pos").alias("path"))
    first = stored(first)
    heads = _known_heads(first)
    start = lambda df, open_: df.select("file_key", "alias", "path", F.col("path").alias("said"), F.array("alias").alias("seen"), F.lit(False).alias("cyclic"), F.lit(open_).alias("open"))
    now = start(first, True)
    if heads is not None:
        on = head(F.col("path")) == F.col("_head")
        if first.join(heads, on, "left_semi").isEmpty():
            return first
        now = start(first.join(heads, on, "left_semi"), True).unionByName(start(first.join(heads, on, "left_anti"), False))
    now = stored(now)
    discard(first)
    while not now.where("open").isEmpty():
        on = now.select(F.col("file_key").alias("of"), F.col("alias").alias("next"), F.col("path").alias("further"), F.col("seen").alias("more"), F.col("cyclic").alias("bad"))
        step = now.where("open").join(on, (F.col("file_key") == F.col("of")) & (head(F.col("path")) == F.col("next")), "left")
        again = F.col("next").isNotNull() & ~F.col("cyclic")
        loop = again & (F.arrays_overlap("seen", "more") | F.col("bad"))
        rest = F.substring("path", F.length("next") + 1, F.length("path"))
        step = step.select("file_key", "alias", F.when(again & ~loop, F.concat("further", rest)).otherwise(F.col("path")).alias("path"), "said", F.when(again & ~loop, F.concat("seen", "more")).otherwise(F.col("seen")).alias("seen"), (F.col("cyclic") | loop).alias("cyclic"), (again & ~loop).alias("open"))
        before, now = now, stored(step.unionByName(now.where("not open")))
        discard(before)
    return now.select("file_key", "alias", F.when(F.col("cyclic"), F.col("said")).otherwise(F.col("path")).alias("path"))


def expanded(sites: DataFrame, known: DataFrame, column: str = "written") -> DataFrame:
    """sites(file_key, column) with an alias at the beginning of a name replaced; the result of aliases() is `known`.

    Names that begin like no alias of any file stay where they are.
    """
    a = known.select(F.col("file_key").alias("_of"), F.col("alias").alias("_alias"), F.col("path").alias("_path"))
    heads = _known_heads(known)
    like = head(F.col(column)) == F.col("_head")
    some = sites.join(heads, like, "left_semi") if heads is not None else sites
    out = some.join(a, (F.col("file_key") == F.col("_of")) & (head(F.col(column)) == F.col("_alias")), "left")
    rest = F.substring(F.col(column), F.length("_alias") + 1, F.length(column))
    out = out.withColumn(column, F.when(F.col("_alias").isNotNull(), F.concat("_path", rest)).otherwise(F.col(column))).drop("_of", "_alias", "_path")
    return out.unionByName(sites.join(heads, like, "left_anti")) if heads is not None else out


def _tuple(distance: Column, full: Column) -> Column:
    return F.struct(distance.cast("int").alias("distance"), full.alias("full"))


def full_names(asked: DataFrame, imports: DataFrame) -> DataFrame:
    """asked(project, file_key, scope, module, written) with each full name that the written one may have, and its distance.

    Names joined by `::` are looked for in their scope and module, as `crate::`, `self::` and `super::` say;
    others in each enclosing scope, the innermost first, then outermost. Then come imports(file_key, path, alias) without alias; one with an alias brings in nothing else.
    """
    w = N.type_path("written")
    double = F.col("written").contains("::") | F.col("scope").contains("::") | (F.col("module") != "")
    under = lambda scope, name: F.when(scope == "", name).otherwise(F.concat(scope, F.when(double, F.lit("::")).otherwise(F.lit(".")), name))
    rooted = F.col("written").startswith("global::") | F.col("written").startswith("::")
    around = F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(N.component_prefixes("scope"))
    enclosing = F.transform(around, lambda s: _tuple(F.length("scope") - F.length(s), under(s, w)))
    path = F.when(F.col("written").contains("::"), F.array(_tuple(F.lit(0), N.context_name(w, "module")), _tuple(F.lit(1), w)))
    near = F.array(_tuple(F.lit(0), under(F.col("scope"), w)), _tuple(F.lit(1), under(F.col("module"), w)))
    names = F.when(rooted, F.array(_tuple(F.lit(0), F.regexp_replace(w, "^::", "")))).otherwise(
        F.coalesce(path, F.when(double, near).otherwise(F.concat(enclosing, F.array(_tuple(F.lit(OUTERMOST), w)))))
    )
    own = asked.select(*ASKED, F.explode(names).alias("n")).select(*ASKED, "n.distance", "n.full")
    via = imports.where("path is not null and path <> '' and coalesce(alias, '') = ''").select(F.col("file_key").alias("_of"), F.col("path").alias("_path")).distinct()
    i = asked.where(~rooted & ~F.col("written").contains("::")).join(via, F.col("file_key") == F.col("_of"))
    seen = lambda p: F.when(double, N.context_name(p, "module")).otherwise(p)
    direct = N.simple_name("_path") == head(w)
    rest = F.substring(w, F.length(head(w)) + 1, F.length(w))
    p = F.col("_path")
    tuples = F.when(direct, F.array(_tuple(F.lit(IMPORTED), F.concat(p, rest)), _tuple(F.lit(IMPORTED), F.concat(seen(p), rest)))).otherwise(F.array(_tuple(F.lit(WITHIN), under(p, w)), _tuple(F.lit(WITHIN), under(seen(p), w))))
    return own.unionByName(i.select(*ASKED, F.explode(tuples).alias("n")).select(*ASKED, "n.distance", "n.full")).distinct()


def resolved(asked: DataFrame, decls: DataFrame, imports: DataFrame, sees: DataFrame | None = None) -> DataFrame:
    """(asked..., of, target, uncertain): the nearest declarations(project, qualified) that each written name means.

    A project sees what sees(project, sees) says, or else itself. Several symbols at the nearest
    distance are all given, and uncertain. Names without any have no row. Partial declarations are one symbol.
    """
    cand = full_names(asked.select(*ASKED).distinct(), imports)
    known = decls.select(F.col("project").alias("of"), F.col("qualified").alias("target"), N.type_path("qualified").alias("full")).distinct()
    cand = cand.join(sees.select("project", F.col("sees").alias("of")), "project") if sees is not None else cand.withColumn("of", F.col("project"))
    hit = cand.join(known, ["of", "full"]).groupBy(*ASKED, "of", "target").agg(F.min("distance").alias("distance"))
    nearest = hit.withColumn("place", F.rank().over(Window.partitionBy(*ASKED).orderBy("distance"))).where("place = 1")
    return nearest.select(*ASKED, "of", "target", (F.count("*").over(Window.partitionBy(*ASKED)) > 1).alias("uncertain"))


def bound_in_scope(occurrences: DataFrame, decls: DataFrame, imports: DataFrame, sees: DataFrame | None = None) -> DataFrame:
    """occurrences(project, file_key, scope, module, written, ...) with of, target and uncertain; both null, and uncertain, where nothing is meant.

    Aliases are replaced first. `written` stays as it stands in the text. Null scopes and modules are empty.
    """
    full = lambda k: F.coalesce(F.col(k), F.lit("")) if k in occurrences.columns else F.lit("")
    rows = occurrences.withColumns({"scope": full("scope"), "module": full("module"), "_text": F.col("written")})
    rows = _asking(expanded(rows, aliases(imports)), imports)
    found = stored(resolved(rows.drop("file_key").withColumnRenamed("_asker", "file_key"), decls, imports, sees).withColumnRenamed("file_key", "_asker"))
    found = F.broadcast(found) if found.count() <= SMALL else found
    keys = ["project", "_asker", "scope", "module", "written"]
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on &= x
    out = rows.alias("o").join(found.alias("f"), on, "left")
    return out.select("o.*", "f.of", "f.target", F.coalesce("f.uncertain", F.lit(True)).alias("uncertain")).withColumn("written", F.col("_text")).drop("_text", "_asker")


def _asking(rows: DataFrame, imports: DataFrame) -> DataFrame:
    """rows(file_key, ...) with _asker: the file where it has imports without alias, which alone make names mean what they don't elsewhere; else null."""
    files = stored(imports.where("path is not null and path <> '' and coalesce(alias, '') = ''").select(F.col("file_key").alias("_asker")).distinct())
    n = files.count()
    if not n:
        return rows.withColumn("_asker", F.lit(None).cast(dict(files.dtypes)["_asker"]))
    return rows.join(F.broadcast(files) if n <= SMALL else files, F.col("file_key") == F.col("_asker"), "left")
