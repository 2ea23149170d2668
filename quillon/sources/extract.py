"""Approximate extraction of facts from source text by patterns.

No grammar is available here: this finds declarations, calls, writes and imports of brace languages
by their shape, and doesn't know types. Facts from a real parser can be given as tables instead; all
operators take tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = "class struct union interface enum trait namespace mod fn delegate record macro_rules!".split()
_DECL = re.compile(r"^(?P<head>[ \t]*(?P<mods>(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|abstract|sealed|partial|async|unsafe|const|virtual|override|extern|readonly)\s+)*)(?P<kw>class|struct|union|interface|enum|trait|namespace|mod|fn|delegate|record|macro_rules!)\s+(?P<name>[A-Za-z_][\w.]*)[^{;\n]*)", re.M)
_METHOD = re.compile(r"^(?P<head>[ \t]*(?P<mods>(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|inline|extern|sealed)\s+)*)(?P<type>[A-Za-z_][\w<>,.\[\]?:*& ]*?)\s+(?P<name>[A-Za-z_]\w*)\s*\((?P<params>[^()]*)\)\s*(?:const\s*)?)(?=\{|=>)", re.M)
_CALL = re.compile(r"(?<![\w#])([A-Za-z_]\w*)\s*(?:<[\w, ]+>)?\(")
_WRITE = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=|>)")
_REF = re.compile(r"\b(out|ref)\s+([A-Za-z_]\w*)")
_IMPORT = re.compile(r"^[ \t]*(?:global\s+)?(?:using|use)\s+(?:(\w+)\s*=\s*)?([\w.:]+)(?:\s+as\s+(\w+))?\s*;", re.M)
_NOT_CALLS = frozenset("if for while switch catch using lock return fixed sizeof typeof nameof match fn new".split())
_ATTRIBUTE = re.compile(r"#?\[([^\]\n]+)\]\s*$")
_PRAGMA = re.compile(r"^[ \t]*#pragma[ \t]+(vertex|fragment|geometry|hull|domain|surface|kernel)[ \t]+(\w+)", re.M)

FACTS = "file_key string, fact string, kind string, name string, qualified string, namespace string, owner string, start long, end long, header string, parameters array<string>, access string, attributes array<string>, bases array<string>, write string"


def blanked(source: str) -> str:
    """Comments and strings as spaces."""
    return re.sub(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"', lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def block_end(text: str, at: int) -> int:
    """Where the braces that open at or after a place are closed, or the statement ends."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m[0] == ";" and not depth:
            return m.end()
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == "}" and depth <= 0:
            return m.end()
    return len(text)


def facts(source: str) -> Iterator[dict]:
    code = blanked(source)
    found = []
    for rx in (_DECL, _METHOD):
        for m in rx.finditer(code):
            kind = {"fn": "function", "mod": "module", "record": "class", "macro_rules!": "macro"}.get(m.groupdict().get("kw"), m.groupdict().get("kw") or "method")
            if rx is _METHOD and (m["type"].strip() in ("return", "new", "else", "await", "throw") or m["name"] in _NOT_CALLS):
                continue
            before = source[: m.start()].rstrip()
            attribute = _ATTRIBUTE.search(before[before.rfind("\n") + 1 :])
            words = m["mods"].split()
            bases = re.search(r":\s*([^{]+)", m["head"]) if kind in ("class", "struct", "interface", "trait", "enum") else None
            params = m.groupdict().get("params") if rx is _METHOD else (re.search(r"\(([^()]*)\)", m["head"]) or [None, None])[1]
            found.append({"kind": kind, "name": m["name"], "start": m.start("head") + len(m["head"]) - len(m["head"].lstrip()), "end": block_end(code, m.end("head")), "header": m["head"].strip(), "access": next((w for w in words if w.startswith(("pub", "private", "protected", "internal"))), ""), "attributes": [attribute[1]] if attribute else [], "bases": [b.strip() for b in bases[1].split(",")] if bases else [], "parameters": [re.sub(r"\s+\w+$", "", p.strip()) for p in params.split(",")] if params and params.strip() else []})
    found.sort(key=lambda d: (d["start"], -d["end"]))
    open_: list[dict] = []
    for d in found:
        while open_ and open_[-1]["end"] <= d["start"]:
            open_.pop()
        sep = "::" if any(o["kind"] in ("module", "trait") for o in open_) else "."
        d["namespace"] = sep.join(o["name"] for o in open_ if o["kind"] in ("namespace", "module"))
        d["owner"] = open_[-1]["qualified"] if open_ else ""
        d["qualified"] = f"{d['owner']}{sep}{d['name']}" if open_ else d["name"]
        open_.append(d)
        yield d | {"fact": "declaration"}
    heads = {(d["start"], d["name"]) for d in found}
    for m in _CALL.finditer(code):
        if m[1] not in _NOT_CALLS and not any(s <= m.start() <= s + 400 and n == m[1] and code[s : m.start()].count("\n") == 0 and "(" not in code[s : m.start()] for s, n in heads if n == m[1]):
            yield {"fact": "occurrence", "kind": "call", "name": m[1], "start": m.start(1), "end": m.end(1), "write": "none"}
    for m in _WRITE.finditer(code):
        yield {"fact": "occurrence", "kind": "value", "name": m[1], "start": m.start(1), "end": m.end(1), "write": "direct"}
    for m in _REF.finditer(code):
        yield {"fact": "occurrence", "kind": "value", "name": m[2], "start": m.start(2), "end": m.end(2), "write": m[1]}
    for m in _IMPORT.finditer(code):
        yield {"fact": "import", "kind": "import", "name": m[1] or m[3] or re.split(r"::|\.", m[2])[-1], "qualified": m[2], "start": m.start(), "end": m.end()}
    for m in _PRAGMA.finditer(source):
        yield {"fact": "entry", "kind": m[1], "name": m[2], "start": m.start(2), "end": m.end(2)}


def extracted(files: DataFrame) -> DataFrame:
    """FACTS of files(file_key, content), offsets in characters."""
    names = [f.split()[0] for f in FACTS.split(", ")]

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [{"file_key": k} | f for k, text in zip(pdf["file_key"], pdf["content"], strict=True) for f in facts(text or "")]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return files.select("file_key", "content").mapInPandas(go, FACTS)
