"""Results as Markdown, and long outputs in pages. These are the only steps that collect rows, and never more than a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.language import quote

PAGE = 24 * 1024
SHOWN = 8


def inline(text: str) -> str:
    """Code in backticks, more of them than the text has in a row."""
    longest, run = 0, 0
    for ch in text:
        run = run + 1 if ch == "`" else 0
        longest = max(longest, run)
    ticks = "`" * (longest + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return f"{ticks}{pad}{text}{pad}{ticks}"


def omission(shown: int, total: int | None) -> str:
    if total is None:
        return "More results follow; narrow the query or raise `limit:`."
    return "" if total <= shown else f"Showing {shown} of {total}. Narrow the query or raise `limit:`."


def results(found: DataFrame, limit: int, count: bool = True) -> str:
    """Rows (path, line, source, and symbol, uncertain or target if there) as a list, grouped by path."""
    held = found.persist() if count else found  # the search runs once, and its order stays
    rows = held.limit(limit + 1).collect()
    total = None if not count else held.count() if len(rows) > limit else len(rows)
    if count:
        held.unpersist()
    out, last = [], None
    for r in rows[:limit]:
        x = r.asDict()
        if x.get("path") != last:
            last = x.get("path")
            out.append(f"### {quote(str(last))}")
        where = f":{x['line']}" if x.get("line") else ""
        notes = [f"→ {inline(str(x['target']))}"] if x.get("target") else []
        notes += ["possible"] if x.get("uncertain") else []
        notes += ["possible write"] if x.get("possible_write") else []
        label = inline(str(x.get("symbol") or x.get("qualified") or x.get("source") or ""))
        out.append(f"- {label}{where}{' (' + ', '.join(notes) + ')' if notes else ''}")
    if not rows:
        out.append("No results.")
    more = omission(min(limit, len(rows)), total if count else (None if len(rows) > limit else len(rows)))
    return "\n".join(out + [more] * bool(more))


def choices(paths: list[str], kind: str, requested: str, shown: int = 4) -> str:
    """What a path may have meant: the first few, and how many others."""
    if not paths:
        return f"No indexed {kind} matches {inline(quote(requested))}. Use `browse` to find paths."
    rest = len(paths) - shown
    return "\n".join(["Choose a path:", *map(quote, paths[:shown]), *([f"{rest} other {kind}s match; be more specific."] if rest > 0 else [])])


def page(text: str, offset: int = 0, size: int = PAGE) -> tuple[str, int | None]:
    """A page of a long text from a byte offset on, and the next offset: cut before a file's diff, a hunk, or a line."""
    data = text.encode()
    if not 0 <= offset <= len(data) or offset and data[offset - 1 : offset] != b"\n":
        raise ValueError("`offset:` must be one that an earlier page gave.")
    if len(data) - offset <= size:
        return data[offset:].decode(), None
    window = data[offset : offset + size]
    for mark in (b"\ndiff ", b"\n@@ ", b"\n"):
        at = window.rfind(mark)
        if at > size // 2 or mark == b"\n" and at >= 0:
            return window[: at + 1].decode(), offset + at + 1
    while window and (window[-1] & 0xC0) == 0x80:
        window = window[:-1]
    return window[:-1].decode(), offset + len(window) - 1


def candidates(found: DataFrame, keys: list[str], target: str = "target", shown: int = SHOWN) -> DataFrame:
    """What each uncertain row may mean: the first few targets by name, and their number."""
    return found.where("uncertain").groupBy(*keys).agg(F.slice(F.sort_array(F.collect_set(target)), 1, shown).alias("candidates"), F.count_distinct(target).alias("n"))
