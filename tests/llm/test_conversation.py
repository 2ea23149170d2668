"""Conversation repair against a search of all edits, on hard cases."""

import hashlib
import heapq
import itertools
import random
import zlib

from quillon.llm import conversation as V

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"  # the last two clash with names used inside


def cheapest(items):
    """items: (initial, must go, cut off). Dijkstra over (turns used, initials so far as a state, edits), least cost, then least edits."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, edits, k, state = heapq.heappop(heap)
        if (k, state) in seen:
            continue
        if k == len(items) and state in ("", "a"):
            return cost, edits
        seen.add((k, state))
        for to in "ua":
            if to in step[state]:
                heapq.heappush(heap, (cost + 2, edits + "I", k, to))
        if k < len(items):
            initial, gone, cut = items[k]
            heapq.heappush(heap, (cost + 3, edits + "D", k + 1, state))
            if not gone:
                if initial and initial in step[state]:
                    heapq.heappush(heap, (cost + cut, edits + "K", k + 1, initial))
                for to in "ua":
                    if to in step[state]:
                        heapq.heappush(heap, (cost + 2 + cut, edits + "R", k + 1, to))


def exhaustive(items):
    """All strings of edits, for short conversations: checks the search above."""
    best = None
    n = len(items)
    for edits in itertools.product("DKR", repeat=n):
        for gaps in itertools.product(range(3), repeat=n + 1):
            state, cost, ok, s = "", 0, True, ""
            for k in range(n + 1):
                for _ in range(gaps[k]):
                    state, cost, s = ("a" if state == "u" else "u"), cost + 2, s + "I"
                if k < n:
                    initial, gone, cut = items[k]
                    s += edits[k]
                    if edits[k] == "D":
                        cost += 3
                        continue
                    if gone or (edits[k] == "K" and initial not in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state]):
                        ok = False
                        break
                    cost += cut + 2 * (edits[k] == "R")
                    state = initial if edits[k] == "K" else "a" if state == "u" else "u"
            if ok and state in ("", "a") and (best is None or (cost, s) < best):
                best = cost, s
    return best


def brute(rows):
    """The report of each conversation of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            sp = lambda x: " " if x is None else str(x)
            role, text = sp(role), sp(text)
            fate = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, items, counts = set(), [], [0, 0, 0]
        for _, role, text in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            items.append((role[:1], fault in (0, 1), int(fault == 2)))
        cost, audit = cheapest(items)
        kept, left, last = [], list(mine), ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else left.pop(0)[1:]
            if edit == "D":
                continue
            role = role if edit == "K" else "assistant" if last == "u" else "user"
            kept.append(f"{role}:{text}")
            last = role[:1]
        numbers = [r[0] for r in mine if r[0] is not None]
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(items)]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed=3):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Why? ", "  \t\n", "", "a.b", "End. ", None, "Tail .\n\n"]
    roles = ["user", "assistant", "system", "tool", "User", "", "u", "assistant", "user", None]
    rows = [(k, t if r.random() > 0.05 else None, r.choice(roles), r.choice(texts)) for k in range(120) for t in range(r.randint(1, 9)) if r.random() > 0.1]
    rows += rows[::17] + [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    drop = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows += [(drop, 0, "user", "Gone.")] + [(5000, t, ("user", "assistant")[t % 2], "Long. " * 20_000) for t in range(3)]
    rows += [(6000, t, r.choice(roles[:3]), f"{t}." if r.random() > 0.2 else f"{t}") for t in range(700)]
    return rows


def test_search_of_edits_by_exhaustion():
    r = random.Random(1)
    for _ in range(60):
        items = [(r.choice("suao"), r.random() < 0.3, int(r.random() < 0.3)) for _ in range(r.randint(0, 3))]
        assert cheapest(items) == exhaustive(items)


def test_trie_shares_prefixes():
    r = random.Random(2)
    words = sorted({"".join(r.choice("suaoSUAOx") for _ in range(r.randint(0, 9))) for _ in range(3000)})
    trie = V.Trie()
    for w in words:
        items = [(x.lower(), x == "x", int(x.isupper())) for x in w]
        assert trie.insert(w) == cheapest(items), w
    assert trie.computed == len({w[:k] for w in words for k in range(1, len(w) + 1)})  # a layer for each prefix, once


def test_reports_against_brute_force(spark):
    rows = made()
    table = spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA).repartition(5)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in V.damage_report(table).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_repaired_turns(spark):
    rows = spark.createDataFrame([("b", 2, "user", "And?"), ("b", 1, "user", "Hello."), ("a", 1, "tool", "x."), ("a", 2, "assistant", "Yes.")], "conv_id string, turn int, role string, text string")
    report, fixed = V.repaired(rows)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report.collect()} == {"a": (2, "RK"), "b": (2, "KR")}
    assert sorted(tuple(r) for r in fixed.collect()) == [("a", 0, "user", "x."), ("a", 1, "assistant", "Yes."), ("b", 0, "user", "Hello."), ("b", 1, "assistant", "And?")]


def test_empty_table(spark):
    assert V.damage_report(spark.createDataFrame([], SCHEMA)).collect() == []
