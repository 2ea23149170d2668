"""Name, path, type and language predicates as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# C# keywords and the types they stand for; language names and their short forms.
BUILTIN = dict(
    bool="System.Boolean", byte="System.Byte", sbyte="System.SByte", short="System.Int16", ushort="System.UInt16", int="System.Int32", uint="System.UInt32", long="System.Int64", ulong="System.UInt64",
    nint="System.IntPtr", nuint="System.UIntPtr", char="System.Char", float="System.Single", double="System.Double", decimal="System.Decimal", string="System.String", object="System.Object", void="System.Void",
)
LANGUAGES = {"c++": ["cpp"], "c#": ["csharp"], "rs": ["rust"], "native": ["c", "cpp", "header"], "shader": ["hlsl", "glsl", "shaderlab"], "shaders": ["hlsl", "glsl", "shaderlab"]}
NATIVE = ("c", "cpp", "header", "hlsl", "glsl", "shaderlab")
DIALECTS = {"header": ("c", "cpp"), "shaderlab": ("hlsl", "glsl", "shaderlab")}
NAMED_TYPES = ("class", "struct", "union", "interface", "enum", "type", "trait", "delegate")
CALLABLE = ("method", "function", "constructor", "operator", "lambda")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f's inner functions use it."""
    return F.transform(F.array(value), f)[0]


def literal(text: str) -> str:
    """Text as a Java regular expression that means just it."""
    return re.sub(r"([\\^$.|?*+()\[\]{}&~\-#\s])", r"\\\1", text)


def wildcard_regex(pattern: str) -> str:
    return "(?s)^" + ".*".join(literal(p) for p in pattern.split("*")) + r"\z"


def wildcard(pattern: str, value: Column | str) -> Column:
    """Whole value, case counts, only `*` is special."""
    v = col(value)
    return v.rlike(wildcard_regex(pattern)) if "*" in pattern else v == pattern


def glob_regex(pattern: str, separators: bool) -> str:
    """A glob as a regular expression. separators: `*` and `?` stop at `/`, and only `**` crosses it."""
    any_, one, out, at, depth = ("[^/]*", "[^/]") if separators else (".*", ".") , None, "", 0, 0
    any_, one = any_
    while at < len(pattern):
        ch = pattern[at]
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] == "/"):
            out += "(?:.*/)?"
            at += 2
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out += "/.*"
            at += 2
        elif ch == "*":
            while pattern[at : at + 1] == "*":
                at += 1
            out += any_
            continue
        elif ch == "?":
            out += one
        elif ch == "[" and (end := pattern.find("]", at + 2)) > 0:
            body = pattern[at + 1 : end]
            out += "[" + ("^" if body[0] in "!^" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body.lstrip("!^")) + "]"
            at = end
        elif ch == "{":
            out += "(?:"
            depth += 1
        elif ch == "}" and depth:
            out += ")"
            depth -= 1
        elif ch == "," and depth:
            out += "|"
        elif ch == "\\" and at + 1 < len(pattern):
            at += 1
            out += literal(pattern[at])
        else:
            out += literal(ch)
        at += 1
    return f"(?s)^{out}\\z"


def path_matches(pattern: str, path: Column | str, prefix_always: bool = False) -> Column:
    """`path:` of searches: a glob whose `*` crosses `/`, or (for values that are no globs, or always) a directory."""
    p = col(path)
    yes = p.rlike(glob_regex(pattern, False))
    if prefix_always or not re.search(r"[*?\[]", pattern):
        yes |= p.startswith(pattern.rstrip("/") + "/")
    return yes


def history_path(pattern: str, path: Column | str) -> Column:
    """`path:` of histories: the pattern as a directory or file, or as a glob whose `*` stops at `/`."""
    p, d = col(path), pattern.rstrip("/")
    return (p == d) | p.startswith(d + "/") | p.rlike(glob_regex(pattern, True))


def file_matches(pattern: str, path: Column | str, loose: bool = False) -> Column:
    """`file:`: against the last part of the path, or all of it if the pattern has a `/`."""
    p = col(path)
    subject = p if "/" in pattern else F.element_at(F.split(p, "/"), -1)
    return subject.rlike(("(?iu)" if loose else "") + glob_regex(pattern, True))


def initials(value: Column | str) -> Column:
    """First characters of words and humps, A-Z in lower case."""
    first = F.regexp_extract_all(col(value), F.lit(r"((?<![\p{L}\p{N}])[\p{L}\p{N}]|(?<=\p{Ll})\p{Lu}|(?<=[\p{L}\p{N}])\p{Lu}(?=\p{Ll}))"), 1)
    return F.translate(F.concat_ws("", first), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def name_rank(pattern: str, value: Column | str, loose: bool = False) -> Column:
    """0 the name or a wildcard of it; loose: 1 but for case, 2 its beginning, 3 its initials, 4 within it; else null."""
    v, p = col(value), pattern.lower()
    rank = F.when(wildcard(pattern, v), 0)
    if loose:
        low = F.lower(v)
        rank = rank.when(wildcard(p, low), 1).when(low.startswith(p), 2).when(initials(v).startswith(p), 3).when(low.contains(p), 4)
    return rank


def qualified_name_rank(pattern: str, value: Column | str, loose: bool = False) -> Column:
    """A name of several parts may leave out the first ones: such an exact match ranks 1, loose ones two more than else."""
    separator = "::" if "::" in pattern else "." if "." in pattern else None
    if separator is None:
        return name_rank(pattern, value, loose)
    v = col(value)
    whole = name_rank(pattern, v, loose)
    parts = F.split(v, literal(separator))

    def tails(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda k: F.array_join(F.slice(p, k, F.greatest(F.size(p) - k + 1, F.lit(0))), separator))

    def tail(x: Column) -> Column:
        r = name_rank(pattern, x, loose)
        return F.when(r == 0, 1).otherwise(r + 2)

    best = F.when(F.size(parts) > 1, F.array_min(F.transform(let(parts, tails), tail)))
    return F.least(F.when(whole == 0, 0).otherwise(whole + 2), best)


def simple_name(value: Column | str) -> Column:
    return F.regexp_extract(col(value), r"([^.:]*)$", 1)


def component_prefix(value: Column | str, prefix: str) -> Column:
    v = col(value)
    return (v == prefix) | v.startswith(prefix + ".") | v.startswith(prefix + "::")


def component_prefixes(value: Column | str) -> Column:
    """The name and every name that it lies in, by `.` and `::`."""
    v = col(value)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), lambda k: (k >= F.length(v)) | (F.substring(v, k + 1, F.lit(1)) == ".") | (F.substring(v, k + 1, F.lit(2)) == "::"))
    return F.transform(ends, lambda k: F.substring(v, F.lit(1), k))


def attribute_name(value: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_extract(F.regexp_replace(col(value), r"^(#\[)+", ""), r"^([^(\]]*)", 1)), "(Attribute)+$", "")


def has_attribute(attributes: Column | str, wanted: str) -> Column:
    return F.exists(col(attributes), lambda a: attribute_name(a) == attribute_name(F.lit(wanted)))


def selector_matches(selector: str, kind: Column | str) -> Column:
    k = col(kind)
    if selector == "symbol":
        return F.lit(True)
    return k.isin(*{"type": NAMED_TYPES, "namespace": ("namespace", "module")}.get(selector, (selector,)))


def is_local(kind: Column | str) -> Column:
    return col(kind).isin("local", "parameter")


def context_name(name: Column | str, module: Column | str) -> Column:
    """A written name seen from a module: `crate::`, `self::` and `super::` are resolved."""
    n, m = col(name), col(module)
    ups = F.regexp_extract(n, r"^((?:super::)*)", 1)
    steps = (F.length(ups) / 7).cast("int")
    parts = F.split(m, "::")
    parent = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - steps, F.lit(1))), "::")
    return (
        F.when(m == "", n).when(n == "", m)
        .when(n.startswith("::"), F.substring(n, 3, 1 << 30))
        .when(n.startswith("crate::"), F.concat(parts[0], F.lit("::"), F.substring(n, 8, 1 << 30)))
        .when(n.startswith("self::"), F.concat(m, F.lit("::"), F.substring(n, 7, 1 << 30)))
        .when(steps > 0, F.concat(parent, F.lit("::"), F.regexp_replace(n, r"^(?:super::)+", "")))
        .otherwise(F.concat(m, F.lit("::"), n))
    )


def type_path(written: Column | str) -> Column:
    """A type's path without `global::`, generic arguments, however deep, and arities."""
    pieces = F.regexp_extract_all(F.regexp_replace(F.trim(col(written)), r"^(global::)+", ""), F.lit(r"([<>]|[^<>]+)"), 1)

    def step(a: Column, x: Column) -> Column:
        depth = F.when(x == "<", a["depth"] + 1).when((x == ">") & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        outside = (a["depth"] == 0) & (x != "<")
        return F.struct(depth.alias("depth"), F.when(outside, F.concat(a["path"], x)).otherwise(a["path"]).alias("path"))

    return F.regexp_replace(F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("path")), step)["path"], r"`[0-9]*", "")


def normalized_type(written: Column | str) -> Column:
    """C# keywords as the types they stand for; white space and the modifiers `this` and `params` dropped."""
    x = F.concat(F.lit(" "), F.regexp_replace(col(written), r"\s+", "  "), F.lit(" "))
    x = F.regexp_replace(x, r" (?:this|params) ", " ")
    for keyword, full in BUILTIN.items():
        x = F.regexp_replace(x, rf"(?<![\p{{L}}\p{{N}}_]){keyword}(?![\p{{L}}\p{{N}}_])", full.replace("$", r"\$"))
    return F.regexp_replace(x, r"\s+", "")


def signature_matches(a: Column | str, b: list[str] | Column) -> Column:
    left = F.transform(col(a), normalized_type)
    right = F.transform(F.array(*map(F.lit, b)).cast("array<string>") if isinstance(b, list | tuple) else b, normalized_type)
    return (F.size(left) == F.size(right)) & F.forall(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: p["l"].eqNullSafe(p["r"]))


def language_matches(pattern: str, language: Column | str) -> Column:
    p = pattern.lower()
    return col(language).isin(*LANGUAGES[p]) if p in LANGUAGES else wildcard(pattern, language)


def file_language(pattern: str, language: Column | str) -> Column:
    """A file's language, or for containers that of any dialect in it."""
    yes = language_matches(pattern, language)
    for container, inside in DIALECTS.items():
        for dialect in inside:
            yes |= (col(language) == container) & language_matches(pattern, F.lit(dialect))
    return yes


def compatible(a: Column, b: Column) -> Column:
    """Languages whose names may mean each other."""
    c = ("c", "cpp", "header")
    return (a == b) | a.isin(*c) & b.isin(*c) | (a == "shaderlab") & b.isin("hlsl", "glsl") | (b == "shaderlab") & a.isin("hlsl", "glsl")


def written_components(value: Column | str) -> Column:
    """Parts of a native name between `::` outside template arguments, however deep."""
    pieces = F.regexp_extract_all(col(value), F.lit(r"(::|[<>]|[^<>:]+|:)"), 1)

    def step(a: Column, x: Column) -> Column:
        depth = F.when(x == "<", a["depth"] + 1).when((x == ">") & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.concat(a["out"], F.when((x == "::") & (a["depth"] > 0), "\u0001").otherwise(x)).alias("out"))

    inner = F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step)["out"]
    return F.transform(F.split(inner, "::"), lambda p: F.regexp_replace(p, "\u0001", "::"))


def native_simple_name(value: Column | str) -> Column:
    return F.regexp_replace(F.element_at(written_components(value), -1), r"(?<!operator)<.*$", "")


_SPACES = r"\s*(::|[<>,*&()\[\]])\s*"


def native_name_rank(pattern: str, value: Column | str, loose: bool = False) -> Column:
    """A native name against a pattern of fewer or as many parts, aligned at the end; null if one part doesn't match.

    0 the same, 1 with parts before it; loose ranks are those of the worst part. Template arguments count only
    where the pattern has them; an operator has to be spelt alike. White space around signs plays no part.
    """
    tight = lambda v: F.regexp_replace(F.trim(v), _SPACES, "$1")
    wanted, depth, part = [], 0, ""
    for piece in re.findall(r"::|[<>]|[^<>:]+|:", re.sub(_SPACES, r"\1", pattern.strip())):
        depth += (piece == "<") - (piece == ">" and depth > 0)
        if piece == "::" and depth == 0:
            wanted.append(part)
            part = ""
        else:
            part += piece
    wanted.append(part)
    if not pattern.strip():
        return F.lit(None).cast("int")
    parts = written_components(tight(col(value)))

    def one(k: int, p: str, have: Column) -> Column:
        w = F.try_element_at(have, F.lit(k - len(wanted)))
        if p.startswith("operator"):
            return F.when(F.regexp_replace(w, r"^operator\s+(?=\W)", "operator") == re.sub(r"^operator\s+(?=\W)", "operator", p), 0)
        return name_rank(p, w if "<" in p else F.regexp_replace(w, r"(?<!operator)<.*$", ""), loose)

    def ranked(have: Column) -> Column:
        ranks = [one(k, p, have) for k, p in enumerate(wanted)]
        all_ = F.size(have) >= len(wanted)
        for r in ranks:
            all_ &= r.isNotNull()
        return F.when(all_, F.greatest(F.when(F.size(have) > len(wanted), 1).otherwise(0), *ranks, *([F.lit(0)] if len(ranks) == 1 else [])))

    return let(parts, ranked)


def native_tokens(written: Column | str) -> Column:
    """The signs and words of a native type, with one space between."""
    return F.array_join(F.regexp_extract_all(col(written), F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*|[0-9][\p{L}\p{N}_.]*|::|->\*?|<<=?|>=|[=!<+*/%&|^-]=|&&|\|\||\+\+|--|\.\.\.|\S)"), 1), " ")


def native_signature_matches(a: Column | str, b: list[str] | Column) -> Column:
    """Parameter lists that are spelt alike, sign by sign."""
    left = F.transform(col(a), native_tokens)
    right = F.transform(F.array(*map(F.lit, b)).cast("array<string>") if isinstance(b, list | tuple) else b, native_tokens)
    return (F.size(left) == F.size(right)) & F.forall(F.arrays_zip(left.alias("l"), right.alias("r")), lambda p: p["l"].eqNullSafe(p["r"]))


def satisfies(constraints: Column | str, defines: list[str]) -> Column:
    """Define constraints: all entries, each an OR of symbols that `!` may negate."""
    known = F.array(*map(F.lit, defines)).cast("array<string>")

    def one(symbol: Column) -> Column:
        s = F.trim(symbol)
        return F.when(s.startswith("!"), ~F.array_contains(known, F.trim(F.substring(s, 2, 1 << 20)))).otherwise(F.array_contains(known, s))

    return F.forall(col(constraints), lambda e: F.exists(F.split(e, r"\|\|"), one))


def version_key(version: Column | str) -> Column:
    """Numbers of a version, padded, so that arrays compare."""
    n = F.transform(F.regexp_extract_all(F.regexp_extract(col(version), r"^([0-9.]*)", 1), F.lit(r"([0-9]+)"), 1), lambda x: x.cast("long"))
    return F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.coalesce(F.try_element_at(n, k), F.lit(0).cast("long")))


def version_matches(actual: Column | str, expression: str) -> Column:
    """`[a,b)`, `[a]` or a least version."""
    v = version_key(actual)
    m = re.fullmatch(r"\s*([\[(])\s*([^,\])]*)\s*(?:,\s*([^\])]*))?\s*([\])])\s*", expression)
    if not m:
        return v >= version_key(F.lit(expression.strip()))
    low, high = m[2].strip(), (m[3] if m[3] is not None else m[2]).strip()
    yes = F.lit(True)
    if low:
        k = version_key(F.lit(low))
        yes &= (v >= k) if m[1] == "[" else (v > k)
    if high:
        k = version_key(F.lit(high))
        yes &= (v <= k) if m[4] == "]" else (v < k)
    return yes


def component_prefix_of(value: Column, prefix: Column) -> Column:
    return (value == prefix) | value.startswith(F.concat(prefix, F.lit("."))) | value.startswith(F.concat(prefix, F.lit("::")))
