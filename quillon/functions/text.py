"""Text positions, excerpts, tokens and similarity. Spans are byte offsets, columns are characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import col, let, literal

# The token pattern of code and prose, and words too common to tell texts apart.
TOKEN = r'''("(?:\\.|[^"\\])*"|'(?:\\(?:u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|.)|[^'\\\r\n])'|[\p{L}\p{N}_]+|[^\s])'''
COMMON = ["return", "self", "Self", "this", "true", "false", "null", "let", "mut", "pub"]


def split_lines(text: Column | str) -> Column:
    """Lines; a final line feed ends the last line and begins none."""
    t = col(text)
    return F.split(F.when(t.endswith("\n"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t), "\n", -1)


def lines_at(text: Column | str) -> Column:
    """Lines as (text, at), `at` being the byte offset that each begins at."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,at:bigint>>").alias("all"))
    step = lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).cast("long").alias("at"), F.concat(a["all"], F.array(F.struct(x.alias("text"), a["at"].alias("at")))).alias("all"))
    return F.aggregate(F.split(col(text), "\n", -1), state, step)["all"]


def line_of(text: Column | str, at: Column) -> Column:
    """1-based line of the character at a 1-based place."""
    before = F.substring(col(text), F.lit(1), at - 1)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column | str, at: Column) -> Column:
    """1-based character column of the character at a 1-based place."""
    before = F.substring(col(text), F.lit(1), at - 1)
    return F.length(F.substring_index(before, "\n", -1)) + 1


def byte_offset(text: Column | str, at: Column) -> Column:
    """0-based byte offset of the character at a 1-based place."""
    return F.octet_length(F.substring(col(text), F.lit(1), at - 1))


def offset_of(text: Column | str, line: Column, column: Column) -> Column:
    """1-based place of a line and column; null outside the text."""
    lines = F.split(col(text), "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), line - 1), F.lit(0), lambda n, x: n + F.length(x) + 1)
    here = F.try_element_at(lines, line)
    return F.when((line > 0) & (column > 0) & (column <= F.length(here) + 1), before + column)


def line_text(text: Column | str, at: Column) -> Column:
    """The line around a place, trimmed."""
    t = col(text)
    head = F.substring_index(F.substring(t, F.lit(1), at - 1), "\n", -1)
    return F.trim(F.concat(head, F.substring_index(F.substring(t, at, F.length(t)), "\n", 1)))


def occurrences(text: Column | str, needle: str, loose: bool = False) -> Column:
    """1-based places of a literal's matches that don't overlap, in order."""
    t, n = col(text), F.lit(needle)
    if loose:
        t, n = F.lower(t), F.lower(n)
    parts = F.split(t, literal(needle.lower() if loose else needle), -1)
    size = F.length(n)
    places = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, p: F.struct((a["at"] + F.length(p) + size).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all")),
    )
    return places["all"]


def slice_lines(text: Column | str, first: int, last: int) -> Column:
    lines = split_lines(text)
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def excerpt(text: Column | str, lines: int = 12, characters: int = 1500) -> Column:
    return F.substring(F.array_join(F.slice(split_lines(text), 1, lines), "\n"), 1, characters)


def declaration_excerpt(source: Column, header: Column, characters: int = 1500) -> Column:
    return F.when(F.length(source) <= characters, source).otherwise(F.concat(header, F.lit("\n// ...")))


def dedent(text: Column | str) -> Column:
    """Without the margin common to the lines that aren't blank; the first line may begin at the margin."""
    margin = lambda x: F.length(F.regexp_extract(x, r"^([ \t]*)", 1))

    def of(lines: Column) -> Column:
        rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
        indent = F.coalesce(F.array_min(F.transform(rest, margin)), margin(lines[0]))
        return let(F.struct(lines.alias("l"), indent.alias("i")), lambda s: F.array_join(F.transform(s["l"], lambda x: F.substring(x, F.least(s["i"], margin(x)) + 1, F.length(x))), "\n"))

    return let(F.split(col(text), "\n", -1), of)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN), 1)


def distinctive(words: Column, least: int) -> Column:
    """Whether `least` different words of three bytes or more, with a letter or digit, aren't common ones."""
    return F.size(F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & w.rlike(r"[\p{L}\p{N}]") & ~w.isin(*COMMON)))) >= least


def runs(words: Column, n: int, separator: str) -> Column:
    """Every run of n words, joined."""

    def of(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.array_join(F.slice(w, k, n), separator))).otherwise(F.array().cast("array<string>"))

    return let(words, of)


def trigrams(words: Column) -> Column:
    """Distinct runs of three tokens; the separator occurs in no token."""
    return F.array_distinct(runs(words, 3, "\u0001"))


def similarity(a: Column, b: Column) -> Column:
    """100 for equal token lists, else twice the shared trigrams over all, in percent, rounded down; 0 if either has none."""

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        shared = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(F.floor(shared * 200 / (F.size(x) + F.size(y)))).cast("int")

    return F.when(a == b, 100).otherwise(let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), of)).cast("int")


def location_suffix(path: Column | str) -> Column:
    """(path, first, last) of `path:10-20`, `path#L10-L20` or `path(10)`."""
    p = col(path)
    patterns = [r"^([^:#(]*):\s*L?(\d+)\s*(?::\s*\d+\s*)?(?:(?:-|\.\.)\s*L?(\d+)\s*(?::\s*\d+\s*)?)?$", r"^([^:#]*)#L?(\d+)(?:-L?(\d+))?$", r"^([^:#(]*)\((\d+)(?:,\s*\d+)?()\)$"]
    out = F.struct(p.alias("path"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    for x in patterns:
        first = F.regexp_extract(p, x, 2).try_cast("int")
        found = F.struct(F.regexp_extract(p, x, 1).alias("path"), first.alias("first"), F.coalesce(F.regexp_extract(p, x, 3).try_cast("int"), first).alias("last"))
        out = F.when(p.rlike(x), found).otherwise(out)
    return out


def prefixes(path: Column | str) -> Column:
    """The directories above a path, nearest last."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
