"""File scans: selection by path, decoding, validation and languages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col, glob_regex

MOST_BYTES = 32 << 20
# File extensions and names by language.
EXTENSIONS = {
    "cs": "csharp", "rs": "rust", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "h": "header", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "hlsl": "hlsl", "hlsli": "hlsl", "cginc": "hlsl", "compute": "hlsl",
    "glsl": "glsl", "vert": "glsl", "frag": "glsl", "geom": "glsl", "comp": "glsl", "shader": "shaderlab", "md": "markdown", "markdown": "markdown", "mdx": "markdown",
    "txt": "text", "json": "text", "toml": "text", "yaml": "text", "yml": "text", "xml": "text", "ini": "text", "cfg": "text", "csv": "text", "html": "text", "css": "text", "sh": "text", "java": "text", "js": "text", "ts": "text", "py": "text", "sql": "text", "go": "text",
}
NAMES = dict.fromkeys(("readme", "license", "makefile", "dockerfile", "changelog", ".gitignore", ".editorconfig"), "text")
ASSETS = "unity prefab asset mat anim controller shadergraph shadersubgraph playable preset mask".split()


def language(path: Column | str) -> Column:
    """Language of a path by its name or extension; null for others."""
    base = F.element_at(F.split(col(path), "/"), -1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    names = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(base)), F.try_element_at(table, F.regexp_extract(base, r"\.([^.]+)$", 1)))


def is_asset(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1)).isin(*ASSETS)


def is_document(content: Column | str) -> Column:
    """No control bytes but white space and escape, and no binary property list."""
    c = col(content)
    return ~c.rlike("[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F\\x7F]") & ~c.startswith("bplist00")


def selected(path: Column | str, baseline: list[str], included: list[str], excluded: list[str], generated: list[str] | None = None) -> Column:
    """(in the baseline and not generated, or included) and not excluded; `*` stops at `/`."""
    p = col(path)
    some = lambda globs: F.lit(False) if not globs else p.rlike("|".join(f"(?:{glob_regex(g, True)})" for g in globs))
    return (some(baseline) & ~some(generated or []) | some(included)) & ~some(excluded)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text of bytes: by byte order mark, as UTF-8, or as the most likely of a few single-byte encodings."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
            if b.startswith(mark):
                return b[len(mark) :].decode(name, "replace")
        try:
            return b.decode()
        except UnicodeDecodeError:
            return b.decode("cp1252", "replace")

    return content.map(one)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(file_key, path, language, content, bytes, modified) of the recognised files below a folder, up to MOST_BYTES each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rel = F.regexp_replace("path", "^.*?" + glob_regex(folder.rstrip("/") + "/", True).removeprefix("(?s)^").removesuffix("\\z"), "")
    out = files.where(F.col("length") <= MOST_BYTES).select(F.col("path").alias("file_key"), rel.alias("path"), "content", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return out.withColumn("language", language("path")).where("language is not null").withColumn("content", decoded("content")).where(is_document("content"))


def normalized_projects(projects: DataFrame) -> DataFrame:
    """projects(identity, seq, ...): the first of each identity, the others as `duplicate_of`."""
    first = projects.groupBy("identity").agg(F.min("seq").alias("first"))
    return projects.join(first, "identity").withColumn("duplicate_of", F.when(F.col("seq") != F.col("first"), F.col("first"))).drop("first")


def resolved_revision(commits: DataFrame, refs: DataFrame, selector: str | None) -> str:
    """HEAD, then a tag, a branch, a whole id, or the one id with a prefix of 7 hex digits or more. refs(name, kind, id)."""
    name = selector or "HEAD"
    order = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "tag", 1).otherwise(2)
    hit = refs.where(F.col("name") == name).orderBy(order).select("id").first()
    if hit:
        return hit[0]
    ids = [r[0] for r in commits.where(F.col("id").startswith(name.lower())).select("id").limit(2).collect()] if len(name) >= 7 else []
    if len(ids) != 1:
        raise ValueError(f"`{name}` is {'ambiguous' if ids else 'unknown'}.")
    return ids[0]
