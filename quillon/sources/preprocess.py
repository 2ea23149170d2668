"""Conditional compilation: inactive lines and directives are blanked, so that offsets stay."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"\s*(&&|\|\||==|!=|!|\(|\)|\w+|\S)")


class PreprocessorError(ValueError):
    pass


def evaluate(expression: str, symbols: set[str]) -> bool:
    """`!`, then `==` and `!=`, then `&&`, then `||`, over symbols, `true` and `false`."""
    parts = _PARTS.findall(expression) + [""]
    at = 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if parts[at] in wanted:
            at += 1
            return parts[at - 1]
        return None

    def chain(below, operators: dict):
        def level() -> bool:
            value = below()
            while op := take(*operators):
                value = operators[op](value, below())
            return value

        return level

    def atom() -> bool:
        nonlocal at
        if take("!"):
            return not atom()
        if take("("):
            value = whole()
            if not take(")"):
                raise PreprocessorError("Unclosed preprocessor expression")
            return value
        if not re.fullmatch(r"\w+", parts[at]):
            raise PreprocessorError("Invalid preprocessor expression")
        at += 1
        return parts[at - 1] == "true" or parts[at - 1] != "false" and parts[at - 1] in symbols

    equal = chain(atom, {"==": lambda a, b: a == b, "!=": lambda a, b: a != b})
    both = chain(equal, {"&&": lambda a, b: a and b})
    whole = chain(both, {"||": lambda a, b: a or b})
    value = whole()
    if parts[at]:
        raise PreprocessorError(f"Unsupported preprocessor expression: {''.join(parts[at:])}")
    return value


def preprocess(source: str, defines: list[str]) -> str:
    symbols, out = set(defines), []
    frames: list[list[bool]] = []  # whether the outside is active, whether a branch was taken, whether this one is
    comment = False
    for line in source.splitlines(keepends=True):
        m = None if comment else re.match(r"\s*#\s*(\w*)(.*)", line)
        live = all(f[2] for f in frames)
        if m:
            rest = m[2].split("//")[0].strip()
            if m[1] == "if":
                yes = evaluate(rest, symbols)
                frames.append([live, yes, yes])
            elif m[1] in ("elif", "else", "endif"):
                if not frames:
                    raise PreprocessorError(f"Unmatched #{m[1]}")
                if m[1] == "endif":
                    frames.pop()
                else:
                    yes = m[1] == "else" or evaluate(rest, symbols)
                    frames[-1][2] = yes and not frames[-1][1]
                    frames[-1][1] |= yes
            elif live and m[1] == "define":
                symbols.add(rest)
            elif live and m[1] == "undef":
                symbols.discard(rest)
        if m or not live:
            out.append(re.sub(r"[^\r\n]", lambda x: " " * len(x[0].encode()), line))
        else:
            out.append(line)
            plain = re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*', "", line) if not comment else line
            for mark in re.findall(r"/\*|\*/", plain):
                comment = mark == "/*" if not comment else mark != "*/"
    if frames:
        raise PreprocessorError("Unclosed #if directive")
    return "".join(out)


def active_source(content: Column, defines: list[str]) -> Column:
    """The active text of each file; null where its directives are broken."""

    @F.pandas_udf("string")
    def go(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else preprocess(t, defines)
            except PreprocessorError:
                return None

        return texts.map(one)

    return go(content)
