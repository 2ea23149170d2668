"""Compact source for viewing, and documentation comments as text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col

_PIECE = re.compile(r'''//[^\n]*|/\*.*?\*/|@?\$?"(?:\\.|""|[^"\\])*"|'(?:\\.|[^'\\\n])'|\w+|\s+|.''', re.S)


def compacted(source: str) -> str:
    """The same tokens with comments dropped and white space only where two words, or two signs that could join, meet."""
    out: list[str] = []
    for m in _PIECE.finditer(source):
        t = m[0]
        if t.startswith(("//", "/*")) or t.isspace():
            if out and out[-1] not in (" ", "\n"):
                out.append("\n" if "\n" in t and (out[-1] == "#" or _directive(out)) else " ")
            continue
        if out and out[-1] == " ":
            before = out[-2][-1] if len(out) > 1 else ""
            joins = (before.isalnum() or before == "_") and (t[0].isalnum() or t[0] == "_") or before + t[0] in ("++", "--", "&&", "||", "<<", ">>", "->", "=>", "==", "<=", ">=", "!=", "::", "//", "/*")
            if not joins:
                out.pop()
        out.append(t)
    return "".join(out).strip()


def _directive(out: list[str]) -> bool:
    """Whether the line being written is a preprocessor directive, which ends with its line."""
    line = "".join(out[-40:]).rpartition("\n")[2]
    return line.startswith("#")


@F.pandas_udf(T.StringType())
def minified(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else compacted(s))


def xml_doc(doc: Column | str) -> Column:
    """An XML documentation comment as text: names of `cref` and parameters stay, elements go."""
    x = F.regexp_replace(col(doc), r"(?m)^[ \t]*///?[ \t]?", "")
    x = F.regexp_replace(x, r'<(?:see|seealso|paramref|typeparamref)\s+(?:cref|name|langword|href)="(?:[A-Z]:)?([^"]*)"\s*/?>', "`$1`")
    x = F.regexp_replace(x, r'<param\s+name="([^"]*)"\s*>', "$1: ")
    x = F.regexp_replace(x, r"</?[A-Za-z][^>]*>", " ")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(x, r"\s+", " "))
