"""Subtypes by bases as they are written, and what overrides a member in them.

A type's bases are names, and what they mean depends on where they stand. All bases are resolved in
one pass, by equality of full names, the nearest declaration winning; the search then follows only
edges that mean a type found. A base that means another type of the same name leads nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from . import scopes as S
from .graph import closure
from .tables import stored


def written_bases(decls: DataFrame, imports: DataFrame) -> DataFrame:
    """(project, qualified, kind, file_key, scope, module, written, simple) of each base that decls(project, file_key, kind, qualified, owner, bases) write, aliases replaced.

    A base is looked up where its type stands, in the owner. Generic arguments play no part.
    """
    joined = F.when(F.col("qualified").contains("::"), F.col("owner"))  # the module of a name joined by `::`, if none is given
    module = F.coalesce(*(["module"] if "module" in decls.columns else []), joined, F.lit(""))
    types = decls.where(F.col("kind").isin(*N.NAMED_TYPES)).select(F.col("project").cast("string").alias("project"), "file_key", "kind", "qualified", F.coalesce("owner", F.lit("")).alias("scope"), module.alias("module"), F.explode("bases").alias("written"))
    types = S.expanded(types.where("written is not null"), S.aliases(imports))
    return types.withColumn("simple", N.simple_name(N.type_path("written")))


def resolved_bases(decls: DataFrame, imports: DataFrame, sees: DataFrame | None = None) -> DataFrame:
    """(project, qualified, kind, of, target): each type declaration with the types that its bases mean. Bases that mean none have no row."""
    bases = written_bases(decls, imports)
    types = decls.where(F.col("kind").isin(*N.NAMED_TYPES)).select(F.col("project").cast("string").alias("project"), "qualified")
    sees = sees.select(F.col("project").cast("string").alias("project"), F.col("sees").cast("string").alias("sees")) if sees is not None else None
    means = S.resolved(bases, types, imports, sees)
    return bases.join(means, S.ASKED).select("project", "qualified", "kind", "of", "target").distinct()


def subtypes(decls: DataFrame, imports: DataFrame, targets: DataFrame, sees: DataFrame | None = None, classes_only: bool = False) -> DataFrame:
    """(project, qualified, kind, depth): all types below targets(project, qualified), each once with its least depth; targets have depth 0.

    decls(project, file_key, kind, qualified, owner, bases[, module]), imports(file_key, pos, path,
    alias), sees(project, sees). classes_only: a class may only come from a class. Types that inherit
    in a cycle are found once. An ambiguous base counts for each type that it may mean; of several
    kinds that a symbol is declared with, the least by name counts.
    """
    text = F.col("project").cast("string").alias("project")
    kinds = stored(decls.where(F.col("kind").isin(*N.NAMED_TYPES)).groupBy(text, "qualified").agg(F.min("kind").alias("kind")))
    edges = resolved_bases(decls, imports, sees)
    if classes_only:
        above = kinds.where("kind = 'class'").select(F.col("project").alias("of"), F.col("qualified").alias("target"))
        edges = edges.where("kind = 'class'").join(above, ["of", "target"], "left_semi")
    node = lambda p, q: F.struct(F.col(p).alias("project"), F.col(q).alias("qualified"))
    seeds = targets.select(text, "qualified").distinct().join(kinds, ["project", "qualified"], "left_semi").select(F.lit(0).alias("root"), node("project", "qualified").alias("node"))
    found = closure(edges.select(node("of", "target").alias("src"), node("project", "qualified").alias("dst")), seeds)
    return found.select("node.project", "node.qualified", "depth").join(kinds, ["project", "qualified"]).select("project", "qualified", "kind", "depth")


def implementations(decls: DataFrame, imports: DataFrame, targets: DataFrame, sees: DataFrame | None = None, classes_only: bool = False) -> DataFrame:
    """What `derived:` and `impl:` give for types: subtypes() below the targets that are no interfaces or traits."""
    return subtypes(decls, imports, targets, sees, classes_only).where("depth > 0 and kind not in ('interface', 'trait')")


def overriding(decls: DataFrame, imports: DataFrame, owners: DataFrame, name: str, sees: DataFrame | None = None) -> DataFrame:
    """Declarations that implement or override a member: callables of the name in types below its owners(project, qualified).

    Below an interface or trait each one counts, below others those with the modifier `override`. decls also
    need name and modifiers.
    """
    text = F.col("project").cast("string")
    roots = owners.select(text.alias("project"), "qualified").distinct()
    kinds = decls.select(text.alias("project"), "qualified", "kind").join(roots, ["project", "qualified"], "left_semi").groupBy("project", "qualified").agg(F.bool_or(F.col("kind").isin("interface", "trait")).alias("open"))
    calls = decls.where(F.col("kind").isin(*N.CALLABLE) & (F.col("name") == name)).withColumn("_p", text)

    def below(roots: DataFrame) -> DataFrame:
        found = subtypes(decls, imports, roots, sees).where("depth > 0").select(F.col("project").alias("_p"), F.col("qualified").alias("owner"))
        return calls.join(found, ["_p", "owner"], "left_semi")

    out = below(kinds.where("open")).unionByName(below(kinds.where("not open")).where(F.array_contains("modifiers", "override")))
    return out.drop("_p").select(*decls.columns).distinct()
