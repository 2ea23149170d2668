"""Searches: declarations, text, files and relationships. Each gives a DataFrame; a limit is a top-k of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..plans.language import Filter, Query
from . import joins as J
from . import paths


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out &= p
    return out


def row_filters(q: Query, columns: list[str]) -> Column:
    """All filters but `in:` over (project, namespace, access, path, attributes, language)."""

    def one(f: Filter) -> Column:
        if f.key == "project":
            yes = N.wildcard(f.value, "project")
        elif f.key == "namespace":
            yes = N.component_prefix("namespace", f.value) if "namespace" in columns else F.lit(False)
        elif f.key == "access":
            yes = (F.col("access") == f.value) | ((F.col("access") == "pub") & F.lit(f.value == "public")) if "access" in columns else F.lit(False)
        elif f.key == "path":
            yes = N.path_matches(f.value, "path", prefix_always=q.selector == "file")
        elif f.key == "attr":
            yes = N.has_attribute("attributes", f.value) if "attributes" in columns else F.lit(False)
        elif f.key == "lang":
            yes = N.file_language(f.value, "language")
        else:
            return F.lit(True)
        yes = F.coalesce(yes, F.lit(False))
        return ~yes if f.negate else yes

    return _all([one(f) for f in q.filters])


def declarations(decls: DataFrame, q: Query) -> DataFrame:
    """Declarations that the query selects, with their rank; not yet limited.

    decls: file_key, path, project, language, kind, name, qualified, namespace, owner, start, end,
    and as far as the filters need them access, attributes and parameters.
    """
    rank = N.qualified_name_rank(q.target.name, "qualified", q.loose)
    short = F.least(rank, N.name_rank(q.target.name, "name", q.loose)) if "." not in q.target.name and "::" not in q.target.name else rank
    kind = N.selector_matches(q.selector, "kind")
    if q.selector == "function":
        kind |= (F.col("kind") == "method") & F.col("language").isin(*N.NATIVE)
    if q.selector == "method":
        kind |= (F.col("kind") == "function") & F.col("language").isin(*N.NATIVE) & (F.col("owner") != "")
    out = decls.where(kind & row_filters(q, decls.columns)).withColumn("rank", short).where("rank is not null")
    if q.target.parameters is not None:
        out = out.where(N.signature_matches("parameters", q.target.parameters))
    for f in q.of("in"):
        out = contained(out, decls, f)
    return out


def contained(rows: DataFrame, decls: DataFrame, f: Filter) -> DataFrame:
    """`in:`: rows whose start lies in, or whose owner is, a declaration of that name.

    Two equi-joins: by file with the declaration's span, and by owner, of which each distinct one is
    looked up with all that it lies in.
    """
    outer = decls.where(N.qualified_name_rank(f.value, "qualified").isNotNull() | (F.col("name") == f.value))
    spans = outer.select(F.col("project").alias("of_project"), F.col("file_key").alias("of"), F.col("start").alias("from"), F.col("end").alias("to"))
    within = (F.col("file_key") == F.col("of")) & (F.col("project") == F.col("of_project")) & (F.col("start") >= F.col("from")) & (F.col("start") < F.col("to"))
    rest = rows.join(spans, within, "left_anti")
    if "owner" in rows.columns:
        names = outer.select(F.col("project").alias("of_project"), F.col("qualified").alias("up")).distinct()
        owners = rows.select(F.col("project").alias("of_project"), F.col("owner").alias("of_owner")).where("owner is not null").distinct().withColumn("up", F.explode(N.component_prefixes("of_owner")))
        owned = owners.join(names, ["of_project", "up"], "left_semi").select("of_project", "of_owner")
        by_owner = (F.col("project") == F.col("of_project")) & (F.col("owner") == F.col("of_owner"))
        if f.negate:
            return rest.join(owned, by_owner, "left_anti")
        return rows.join(spans, within, "left_semi").unionByName(rest.join(owned, by_owner, "left_semi"))
    return rest if f.negate else rows.join(spans, within, "left_semi")


def ordered(found: DataFrame, limit: int) -> DataFrame:
    """The first rows by rank, source before metadata, non-locals, path, place and name, each symbol once."""
    meta = F.col("metadata") if "metadata" in found.columns else F.lit(False)
    once = found.dropDuplicates(["path", "start", "qualified", "kind"])
    return once.orderBy("rank", meta, N.is_local("kind"), "path", "start", "qualified", "kind").limit(limit)


def other_kinds(decls: DataFrame, q: Query, most: int = 4) -> DataFrame:
    """What has the name where nothing of the kind has: the first few `kind:qualified`."""
    from dataclasses import replace

    return declarations(decls, replace(q, selector="symbol")).select(F.concat_ws(":", "kind", "qualified").alias("other")).distinct().orderBy("other").limit(most)


def text_matches(files: DataFrame, needle: str, loose: bool = False) -> DataFrame:
    """(file_key, path, line, column, at, source) of each line that a literal's match begins in, by its first match.

    files: file_key, path, content. `at` is the byte offset. Matches don't overlap and may span lines.
    """
    t, n = F.col("content"), needle.lower() if loose else needle
    low = F.lower if loose else (lambda x: x)
    keep = ["file_key", "path", *[c for c in ("project", "language") if c in files.columns]]
    hit = files.where(low(t).contains(n))
    if "\n" not in needle:  # a match stays within its line: lines that hold one, by their first
        lines = hit.select(*keep, F.posexplode(X.lines_at(t)).alias("n", "l")).where(low(F.col("l.text")).contains(n))
        place = F.locate(n, low(F.col("l.text")))
        return lines.select(*keep, (F.col("n") + 1).cast("long").alias("line"), place.cast("long").alias("column"), (F.col("l.at") + F.octet_length(F.substring(F.col("l.text"), F.lit(1), place - 1))).alias("at"), F.trim("l.text").alias("source"))
    hit = hit.withColumn("place", F.explode(X.occurrences(t, needle, loose))).withColumn("line", X.line_of(t, F.col("place")).cast("long"))
    hit = hit.withColumn("nth", F.row_number().over(Window.partitionBy("file_key", "line").orderBy("place"))).where("nth = 1")
    return hit.select(*keep, "line", X.column_of(t, F.col("place")).cast("long").alias("column"), X.byte_offset(t, F.col("place")).cast("long").alias("at"), X.line_text(t, F.col("place")).alias("source"))


def text_search(files: DataFrame, decls: DataFrame | None, q: Query) -> DataFrame:
    """Text matches with the innermost declaration that isn't local around each as label."""
    out = text_matches(paths.candidate_files(files, q).where(row_filters(q, files.columns)), q.target.name, q.loose)
    if decls is not None:
        spans = decls.where(~N.is_local("kind")).select("file_key", "start", "end", F.concat_ws(":", "kind", "qualified").alias("label"))
        for f in q.of("in"):
            out = contained(out.withColumn("start", F.col("at")), decls, f).drop("start")
        out = J.innermost(spans, out, ["file_key"], ["at"]).drop("start", "end")
    return out


def text_top(found: DataFrame, limit: int) -> DataFrame:
    """In order of path and place; of files of one path, the one of smallest key for a line."""
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("path", "line").orderBy("at", "file_key"))).where("n = 1").drop("n")
    return once.orderBy("path", "at").limit(limit)


def file_search(files: DataFrame, q: Query) -> DataFrame:
    return paths.candidate_files(files, q).where(N.file_matches(q.target.name, "path", q.loose) & row_filters(q, files.columns)).select("path").distinct()


def grouped(sites: DataFrame) -> DataFrame:
    """Certain sites of one place, symbol, target and write flag are one unit with all their places; uncertain ones stay apart.

    sites: path, line, symbol, target, possible_write, uncertain, at.
    """
    keys = ["path", "line", "symbol", "target", "possible_write"]
    certain = sites.where("not uncertain").groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("places"))
    rest = sites.where("uncertain").select(*keys, F.array("at").alias("places"))
    return certain.withColumn("uncertain", F.lit(False)).unionByName(rest.withColumn("uncertain", F.lit(True)))


def bound(occurrences: DataFrame, decls: DataFrame, sees: DataFrame | None = None) -> DataFrame:
    """Occurrences (project, file_key, name, at, scope) with what they may mean: target, rank, uncertain.

    A local of a surrounding scope is meant for certain, the innermost first. Else a declaration of
    the name that the project sees: certain if it is the only one. Without any, the target is null
    and uncertain.
    """
    site, name = ["file_key", "at", "name"], ["project", "name"]
    local = decls.where(N.is_local("kind")).select("file_key", "name", F.col("start").alias("ls"), F.col("end").alias("le"), F.col("qualified").alias("local"))
    near = occurrences.select(*site).distinct().join(local, ["file_key", "name"]).where("at >= ls and at < le").groupBy(*site).agg(F.max_by("local", "ls").alias("target"))
    settled = occurrences.join(near, site).withColumn("uncertain", F.lit(False))
    rest = occurrences.join(near, site, "left_anti")
    # what a name may mean is found once for a project, not for each site
    wide = decls.where(~N.is_local("kind")).select("name", F.col("project").alias("sees"), F.col("qualified").alias("target"), "metadata" if "metadata" in decls.columns else F.lit(False).alias("metadata"))
    asked = rest.select(*name).distinct()
    asked = asked.join(sees, "project") if sees is not None else asked.withColumn("sees", F.col("project"))
    cand = asked.join(wide, ["sees", "name"]).select(*name, "target", "metadata").distinct()
    cand = J.prefer_source(cand, [*name, "target"]).select(*name, "target").distinct()
    several = cand.groupBy(*name).agg((F.count("*") > 1).alias("uncertain"))
    open_ = rest.join(cand.join(several, name), name, "left").withColumn("uncertain", F.coalesce("uncertain", F.lit(True)))
    return settled.unionByName(open_)


def relationship(occurrences: DataFrame, decls: DataFrame, q: Query, sees: DataFrame | None = None) -> DataFrame:
    """`uses:`, `calls:` and `writes:`: sites whose meaning is the target; `calls:*` gives all, unresolved ones by name."""
    o = occurrences
    if q.selector == "calls":
        o = o.where("call")
    elif q.selector == "writes":
        o = o.where("write <> 'none'")
    out = bound(o, decls, sees)
    if q.selector == "calls" and q.target.name == "*":
        return out.withColumn("target", F.coalesce("target", F.concat(F.lit("unresolved:"), "name")))
    rank = N.qualified_name_rank(q.target.name, "target", q.loose)
    out = out.where("target is not null").where(rank.isNotNull() | N.name_rank(q.target.name, N.simple_name("target"), q.loose).isNotNull())
    return out.withColumn("possible_write", F.col("write") == "ref") if "write" in out.columns else out


def locate(decls: DataFrame, files: DataFrame, path: str, line: int, column: int) -> DataFrame:
    """Declarations around `@path:line:column`, the innermost first."""
    at = files.where(F.col("path") == path).select("file_key", X.byte_offset("content", X.offset_of("content", F.lit(line), F.lit(column))).alias("p"))
    return decls.join(at, "file_key").where("start <= p and p < end").orderBy((F.col("end") - F.col("start")), F.desc("start"))


def filter_hint(projects: DataFrame, q: Query) -> str | None:
    """Why a query has no rows: an unknown project, a namespace with a wildcard, languages that exclude each other."""
    for f in q.of("project"):
        if not f.negate and projects.where(N.wildcard(f.value, "project")).isEmpty():
            return f"No project is named `{f.value}`."
    if any("*" in f.value for f in q.of("namespace")):
        return "`namespace:` takes a prefix of whole components; leave the `*` out."
    wanted = {f.value for f in q.of("lang") if not f.negate}
    return "A file has one language; `lang:` filters combine with AND." if len(wanted) > 1 else None


def native_bound(occurrences: DataFrame, decls: DataFrame, includes: DataFrame) -> DataFrame:
    """Native names by spelling: every compatible declaration may be meant, so all are uncertain but lexical locals.

    occurrences(file_key, language, name, at), decls(file_key, language, name, qualified, kind,
    start, end), includes(file_key, target). The nearest come first: 0 same file, 1 included, 2 other.
    Locals are found within their file. What another name may mean is found once for a file and name, however
    often the file says it, and joined back to its places.
    """
    site = ["file_key", "at", "name"]
    local = decls.where(N.is_local("kind")).select("file_key", "name", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("qualified").alias("target"))
    inner = occurrences.select(*site).distinct().join(local, ["file_key", "name"]).where("at >= _s and at < _e").select(*site, "target", F.lit(0).alias("near"), F.lit(False).alias("uncertain"))
    rest = occurrences.join(inner.select(*site).distinct(), site, "left_anti")
    group = lambda c: F.when(F.col(c).isin("c", "cpp", "header"), "native").when(F.col(c).isin("hlsl", "glsl", "shaderlab"), "shader").otherwise(F.col(c))
    d = decls.where(~N.is_local("kind")).select(F.col("file_key").alias("of"), F.col("language").alias("dl"), "name", F.col("qualified").alias("target"), group("language").alias("group")).distinct()
    asked = rest.select("file_key", "language", "name", group("language").alias("group")).distinct()
    may = asked.join(d, ["group", "name"]).where(N.compatible(F.col("language"), F.col("dl")))
    inc = includes.select("file_key", F.col("target").alias("of"), F.lit(True).alias("included")).distinct()
    near = F.when(F.col("of") == F.col("file_key"), 0).when(F.col("included"), 1).otherwise(2)
    may = may.join(inc, ["file_key", "of"], "left").select("file_key", "language", "name", "target", near.alias("near"))
    return inner.unionByName(rest.join(may, ["file_key", "language", "name"]).select(*site, "target", "near", F.lit(True).alias("uncertain")))


def native_derived(decls: DataFrame, base: str) -> DataFrame:
    """Types that write a base of that name, directly: templates and access words don't count. No closure; uncertain, as the name may be another's."""
    written = lambda b: N.native_simple_name(F.regexp_replace(b, r"^\s*(?:virtual\s+|public\s+|protected\s+|private\s+)+", ""))
    return decls.where(F.exists("bases", lambda b: written(b) == base)).withColumn("uncertain", F.lit(True))


def asset_text(fragments: DataFrame, objects: DataFrame, needle: str, loose: bool = False, most: int = 512) -> DataFrame:
    """Matches in retained fragments(asset, path, start, text) with the object(asset, start, end, label) they lie in."""
    f = fragments.select(F.struct("asset", "start").alias("file_key"), "path", F.col("text").alias("content"))
    hit = text_matches(f, needle, loose).select(F.col("file_key.asset").alias("asset"), "path", (F.col("file_key.start") + F.col("at")).alias("at"), F.substring("source", 1, most).alias("excerpt"))
    return hit.join(J.last_before(objects, hit.select("asset", "at").distinct(), ["asset"]), ["asset", "at"], "left")
