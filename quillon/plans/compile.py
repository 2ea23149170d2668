"""From a query's text to a DataFrame over a corpus' tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import assets, hierarchy, search
from ..operators import graph as G
from .language import Query, QueryError, parse


@dataclass
class Corpus:
    """Tables by role; those that a query doesn't need may be missing."""

    files: DataFrame
    declarations: DataFrame | None = None
    occurrences: DataFrame | None = None
    bases: DataFrame | None = None
    imports: DataFrame | None = None
    visibility: DataFrame | None = None
    edges: DataFrame | None = None
    assets: DataFrame | None = None
    composed: DataFrame | None = None
    types: DataFrame | None = None

    def need(self, name: str) -> DataFrame:
        df = getattr(self, name)
        if df is None:
            raise QueryError(f"This corpus has no {name}.")
        return df


def plan(corpus: Corpus, query: Query) -> DataFrame:
    """All rows that the query selects, not limited."""
    s = query.selector
    if s == "text":
        return search.text_search(corpus.files, corpus.declarations, query)
    if s == "file":
        return search.file_search(corpus.files, query)
    if s in ("uses", "calls", "writes"):
        return search.relationship(corpus.need("occurrences"), corpus.need("declarations"), query, corpus.visibility)
    if s in ("derived", "impl") and corpus.imports is not None:  # bases as they are written, to be found in their scopes
        return _implementations(corpus, query)
    if s in ("derived", "impl"):
        seeds = corpus.need("declarations").where(F.col("name") == query.target.name).select("name").distinct()
        return G.subtypes(corpus.need("bases"), seeds, corpus.declarations.select("name", "kind"), classes_only=s == "derived")
    if s == "instance":
        exact = any(f.value == "exact" for f in query.of("type-match"))
        return assets.instances(corpus.need("composed"), corpus.need("types"), query.target.name, exact)
    if s in ("references", "dependencies") and corpus.assets is not None:
        return _asset_edges(corpus, query)
    if s in ("references", "dependencies"):
        return (assets.incoming if s == "references" else assets.outgoing)(corpus.need("edges"), query.target.name)
    return search.declarations(corpus.need("declarations"), query)


def _asset_edges(corpus: Corpus, query: Query) -> DataFrame:
    """Edges into or out of the asset or object that a path, guid or handle means."""
    edges = corpus.need("edges")
    wanted = edges.sparkSession.createDataFrame([(query.target.name,)], "text string")
    asset, object_id, problem = assets.targets(wanted, corpus.need("assets")).select("asset", "object", "problem").first()
    if problem:
        raise QueryError({"not found": f"No asset is named `{query.target.name}`.", "ambiguous": f"`{query.target.name}` names several assets; take a handle from a result.", "other workspace": "This object isn't of this corpus."}[problem])
    if query.selector == "references":
        return assets.incoming(edges, asset) if object_id is None else assets.incoming(edges, asset).where(F.col("target").cast("string") == object_id)
    out = assets.outgoing(edges, asset)
    return out if object_id is None else out.where(F.col("id").cast("string") == object_id)


def _implementations(corpus: Corpus, query: Query) -> DataFrame:
    """Types below the target, or what overrides it if it is a member; filters hold for the results, not for what lies between."""
    decls = corpus.need("declarations")
    found = decls.where(N.qualified_name_rank(query.target.name, "qualified").isNotNull() | (F.col("name") == query.target.name))
    types = found.where(F.col("kind").isin(*N.NAMED_TYPES)).select("project", "qualified").distinct()
    member = N.simple_name(F.lit(query.target.name))
    if types.isEmpty():
        name = query.target.name.replace("::", ".").rsplit(".", 1)[-1]
        owners = found.where(F.col("kind").isin(*N.CALLABLE) & (F.col("name") == member)).select("project", F.col("owner").alias("qualified"))
        out = hierarchy.overriding(decls, corpus.imports, owners, name, corpus.visibility)
    else:
        below = hierarchy.implementations(decls, corpus.imports, types, corpus.visibility, query.selector == "derived").select(F.col("project").alias("_p"), F.col("qualified").alias("_q"))
        out = decls.join(below, (F.col("project").cast("string") == F.col("_p")) & (F.col("qualified") == F.col("_q")), "left_semi")
        out = out.where(F.col("kind").isin(*N.NAMED_TYPES))
    out = out.where(search.row_filters(query, out.columns))
    for f in query.of("in"):
        out = search.contained(out, decls, f)
    return out


def run(corpus: Corpus, text: str) -> DataFrame:
    """The first `limit:` rows, in the order of their kind of search."""
    q = parse(text)
    out = plan(corpus, q)
    if q.selector == "text":
        return search.text_top(out, q.limit)
    if q.selector == "file":
        return out.orderBy("path").limit(q.limit)
    if "rank" in out.columns:
        return search.ordered(out, q.limit)
    return out.orderBy(*out.columns).limit(q.limit)
