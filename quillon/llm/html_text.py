"""Main text of web pages.

The standard library's parser streams events. Each block of text is a line with its characters,
those of links, and the tags inside and around it. A line's text-to-tag ratio counts no link text,
and is 0 where an element around it names itself a menu, notice or the like. Ratios are smoothed
with a Gaussian over the lines of the page, and the lines over a threshold form the content
clusters. They choose the content region: the nearest element that holds (nearly) all their text,
or the article element that does. Where that is the page itself, it is what lies between the first
and the last cluster. The region's lines, but for those in menus, notices and the like, are the
main text.

Names of elements and classes are hints. What names itself a comment, menu, notice or advert is never
text, however little is left. A name that wrappers have as well (sidebar, header, widget, a form)
takes nothing away where it stands around the page's only article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gaussian over lines.
SIGMA = 1.0
#: Share of the spread of smoothed ratios by which a content line must pass the least, and the spread, as
#: a share of their mean, from which on a page has lines that aren't content.
LEVEL, UNEVEN = 0.5, 0.5
#: Characters of a paragraph that makes its surroundings look like an article.
LONG = 80
#: Share of the content lines' characters that the region must hold.
SHARE = 0.9

# HTML element names by role, and words of class and id names that tell a block's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADED = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
SILENT = frozenset("head script style noscript template iframe object svg math canvas select textarea button audio video map datalist".split())
APART = frozenset("nav header footer aside menu dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"}), "option": frozenset({"option"})}
SCOPE = frozenset("article aside body blockquote div dl fieldset footer form header html main nav ol section table td th ul".split())
CONTAINER = frozenset("article body center div fieldset html main section table tbody td".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_NAMED = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
#: Never the article's; and those that a wrapper of the article may have.
ASIDE = re.compile(_NAMED.format("ad|ads|advert|adverts|advertisement|advertising|breadcrumb|breadcrumbs|comment|comments|commentlist|consent|cookie|cookies|disqus|gdpr|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo|promoted|recommended|related|respond|share|sharing|signup|social|sponsor|sponsored|subscribe"), re.I)
AROUND = re.compile(_NAMED.format("banner|footer|header|masthead|sidebar|toolbar|widget|widgets"), re.I)
#: What a footer's line begins with, whatever holds it.
RIGHTS = re.compile(r"(?:©|\(c\) ?\d{4}|copyright\b)", re.I)
#: Parts of a class name that say of another part that it is absent, in some state, or elsewhere on the page.
_ABOUT = frozenset("no non not has have with without free hide hides show shows layout open opened closed enabled disabled on off".split())
_SPACE = re.compile(r"\s+")
_LONG = re.compile(r"&#(\d{100,})")


def names_aside(value: str) -> int:
    """Whether a class or id names a part that isn't the article's: 2 never, 1 unless it stands around it, 0 no."""
    found = 0
    for name in value.split():
        parts = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)
        hint = 2 if ASIDE.search(parts) else int(bool(AROUND.search(parts)))
        if hint > found and not _ABOUT.intersection(re.split(r"[-_]+", parts.lower())):
            found = hint
    return found


class Page(HTMLParser):
    """Elements by number, as they begin: parent, name and hint (2: not the article's, 1: perhaps not, 0), and the lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # name, number, shut: nothing below is text
        self.where: dict[str, list[int]] = {}  # places in `open` by name, and of scopes and blocks: no tag walks the stack
        self.parent: list[int] = []
        self.name: list[str] = []
        self.hint: list[int] = []
        self.lines: list[tuple[str, int, int, int]] = []  # text, number of the element, tags, characters of links
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0
        self.past = False  # whether the head was closed by what can't stand in it

    def parse_marked_section(self, i, report=1):
        """A comment up to the next '>', as in browsers; the library's own raises, or goes on to a far ']>'."""
        return self.parse_bogus_comment(i, report)

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name; -1 if there is none."""
        held = self.where.get(name)
        return held[-1] if held else -1

    def push(self, tag: str, shut: bool) -> None:
        for group in (tag, *(["/scope"] if tag in SCOPE else []), *(["/block"] if tag in BLOCK else [])):
            self.where.setdefault(group, []).append(len(self.open))
        self.open.append((tag, len(self.name) - 1, shut))

    def cut(self, k: int) -> None:
        """Closes the open elements from a place on; each is closed once."""
        while len(self.open) > k:
            tag = self.open.pop()[0]
            for group in (tag, *(["/scope"] if tag in SCOPE else []), *(["/block"] if tag in BLOCK else [])):
                self.where[group].pop()

    def end_head(self, tag: str) -> None:
        """Close an open head before what can't stand in it: its end tag is optional."""
        head, title = self.last("head"), self.last("title")
        stop = max(self.last("template"), self.last("/scope"))
        if tag == "body" and self.past and title > max(head, stop):
            self.cut(title)
        elif head > stop and (tag == "body" or head == len(self.open) - 1 and tag not in HEADED):
            self.cut(head)
            self.past = True

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            block = self.open[k][1] if (k := self.last("/block")) >= 0 else -1
            self.lines.append((text, block, self.tags, min(self.linked, len(text))))
            self.tags = self.linked = 0

    def shut(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        self.end_head(tag)
        if tag in VOID:
            if tag in BLOCK:
                self.flush()
            elif not self.shut():
                self.text.append(" ") if tag == "br" else None
            return
        if tag in BLOCK:
            self.flush()
            near = max(map(self.last, CLOSES.get(tag, ("p",))))
            if near >= 0 and near >= self.last("/scope"):
                self.cut(near)
        shut, hint = self.shut() or tag in SILENT or tag == "title" and self.past, 0
        if not shut and tag not in ("html", "body"):
            article = tag == "header" and (self.last("article") >= 0 or self.last("main") >= 0)
            hint = 2 if tag in APART and not article else int(tag == "form")
            for key, value in attrs:
                if key == "hidden" or key == "style" and "display:none" in (value or "").replace(" ", "").lower():
                    shut = True
                elif value and key == "role" and value.lower() in ROLES:
                    hint = max(hint, 1 if value.lower() == "form" else 2)
                elif value and key in ("class", "id"):
                    hint = max(hint, names_aside(value))
                elif key == "aria-hidden" and value == "true":
                    hint = max(hint, 1)
        self.links += tag == "a"
        self.parent.append(self.open[-1][1] if self.open else -1)
        self.name.append(tag)
        self.hint.append(hint)
        self.push(tag, shut)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        self.links = max(0, self.links - (tag == "a"))
        if tag in BLOCK:
            self.flush()
        k = self.last(tag)
        if k >= 0 and (tag in SCOPE or tag in BLOCK or k > self.last("/scope")):
            self.cut(k)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head("")
        if not self.shut():
            self.text.append(data)
            if self.links and self.last("a") >= 0:
                self.linked += len(data.strip())


def hidden(page: Page, own: np.ndarray) -> np.ndarray:
    """For each line whether a hint takes it away, or it claims copyright outside any article. If nothing is left that looks like an article, hints of 1 around what does are withdrawn."""
    n, at = len(page.name), [e for _, e, _, _ in page.lines]
    never, within = [False] * n, [False] * n
    for e in range(n):
        up = page.parent[e]
        never[e] = page.hint[e] > 1 or up >= 0 and never[up]
        within[e] = not never[e] and (page.name[e] in ("article", "main", "h1") or up >= 0 and within[up])
    marks = [2 * (within[e] and page.name[e] in ("article", "main", "h1", "h2")) for e in range(n)]
    for e, size in zip(at, own.tolist(), strict=True):
        if e >= 0:
            marks[e] += size >= LONG and not never[e]
    for e in range(n - 1, -1, -1):
        if page.parent[e] >= 0:
            marks[page.parent[e]] += marks[e]

    def gone(hint: list[int]) -> np.ndarray:
        shut = [False] * n
        for e in range(n):
            up = page.parent[e]
            shut[e] = hint[e] > 0 or up >= 0 and shut[up]
        return np.array([e >= 0 and shut[e] or not (e >= 0 and within[e]) and bool(RIGHTS.match(text)) for text, e, _, _ in page.lines], bool)

    first = gone(page.hint)
    if any(not g and size and e >= 0 and (within[e] or size >= LONG) for e, g, size in zip(at, first.tolist(), own.tolist(), strict=True)):
        return first
    return gone([0 if h == 1 and m >= 2 else h for h, m in zip(page.hint, marks, strict=True)])


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Each line's mean of the ratios around it, weighed by a Gaussian of the distance in lines."""
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    padded = np.concatenate((np.zeros(3), ratio, np.zeros(3)))
    there = np.concatenate((np.zeros(3), np.ones(len(ratio)), np.zeros(3)))
    return np.convolve(padded, kernel, "valid") / np.convolve(there, kernel, "valid")


def content(page: Page, level: float = LEVEL) -> list[str]:
    lines = page.lines
    if not lines:
        return []
    size = np.array([len(t) - linked for t, _, _, linked in lines], float)
    gone = hidden(page, size)
    ratio = np.where(gone, 0, size / np.array([max(1, tags) for _, _, tags, _ in lines]))
    smooth = smoothed(ratio)
    least = smooth.min() + level * smooth.std() if smooth.std() > UNEVEN * smooth.mean() else -1.0
    core = ~gone & (smooth >= least)
    if not core.any() or not size[core].any():
        core = ~gone
    strong = core & (ratio >= least) if (core & (ratio >= least)).any() else core  # not raised by their neighbours alone
    total = float(size[strong].sum())
    held = np.zeros(len(page.name) + 1)  # the last is what stands in no element
    alone = np.zeros(len(page.name) + 1, int)
    for k, (_, at, _, _) in enumerate(lines):
        held[at] += size[k] * strong[k]
        alone[at] += 1
    for e in range(len(page.name) - 1, -1, -1):
        if page.parent[e] >= 0:
            held[page.parent[e]] += held[e]
            alone[page.parent[e]] += alone[e]
    named = [e for e, x in enumerate(page.name) if x in ("article", "main") and held[e] and held[e] >= 0.5 * total]
    if named:
        region = max(named, key=lambda e: (held[e], -e))
    else:
        region = max((e for e, x in enumerate(page.name) if x in CONTAINER and total and held[e] >= SHARE * total), default=-1)
        while region >= 0 and alone[region] == 1 and (up := page.parent[region]) >= 0 and page.name[up] in CONTAINER - {"body", "html"}:
            region = up  # a container of a single line is a paragraph by another name
    below = [region < 0] * (len(page.name) + 1)
    for e in range(max(region, 0), len(page.name)):
        below[e] = e == region or below[page.parent[e]]
    first, last = 0, len(lines) - 1
    if core.any() and (region < 0 or page.name[region] in ("body", "html")):  # nothing but the clusters tells where the content is
        first, last = (int(k) for k in np.flatnonzero(core & (size > 0) if size[core].any() else core)[[0, -1]])
        while first and re.fullmatch("h[1-6]", page.name[lines[first - 1][1]] if lines[first - 1][1] >= 0 else ""):
            first -= 1
    return [text for k, (text, at, _, _) in enumerate(lines) if first <= k <= last and not gone[k] and below[at]]


def main_text(html: str | None, level: float = LEVEL) -> str:
    """The page's main text, blocks joined by two line feeds; empty for null, and where there is none."""
    if not html:
        return ""
    page = Page()
    page.feed(_LONG.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))  # int() refuses thousands of digits
    page.close()
    page.flush()
    return "\n\n".join(content(page, level))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of each row; a null page gives an empty text. Other columns aren't read."""

    def go(batches):
        for batch in batches:
            got = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.record_batch([batch["id"], batch["url"], pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(go, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
