"""Conversation structure repair: one dynamic program over a trie of role and fault signatures.

A conversation is a sequence of turns. Its signature has a letter a turn: what the turn's role
begins with and whether its text is cut off, or that it has to go. Cheapest repairs depend on the
signature alone, and conversations are alike: so the distinct signatures are sorted, and sorted
they walk a prefix trie in order. Each node holds the layer of the program after its prefix, which
is computed once however many signatures pass; an answer is read off where a signature ends.

A layer has, for each state of the pattern `(s?(ua)+)?`, the least cost, the least string of edits
of that cost, and the edit that led there. Two strings of equal cost that end in one state differ
at some place (one that continued the other would insert more, and cost more), so the lesser one
stays the lesser whatever follows. Strings are not stored: their order within a layer is enough.

Only digests of texts are needed for a signature. Texts are shuffled once, when edits are applied:
a task streams through sorted turns and holds a letter for each turn of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: States of the pattern: nothing yet, after system, after user, after assistant. A repaired conversation ends in ENDS.
STATES, ENDS = "esua", "ea"
#: What a turn of each initial leads to.
NEXT = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: Costs of the edits; an undeleted turn that is cut off costs CUT more.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Letters of a signature: initials of whole turns, the same in capitals where the text is cut off, and GONE.
OTHER, GONE = "o", "x"
ROLE = {"u": "user", "a": "assistant"}

#: For each state: cost, rank of its string up to the last turn, inserts since, state before the turn, edits of this turn.
Layer = tuple[tuple[int, int, int, str, str] | None, ...]


def _inserted(found: dict[str, tuple]) -> dict[str, tuple]:
    """Adds what inserts after the turn reach. More than two lead back to where they began."""
    for _ in range(2):
        for state, (cost, rank, n, *back) in list(found.items()):
            for to in "ua":
                if NEXT.get((state, to)):
                    new = (cost + INSERT, rank, n + 1, back[0], back[1] + "I")
                    if to not in found or new[:3] < found[to][:3]:
                        found[to] = new
    return found


def _layer(found: dict[str, tuple]) -> Layer:
    return tuple(found.get(q) for q in STATES)


ROOT = _layer(_inserted({"e": (0, 0, 0, "", "")}))


@lru_cache(maxsize=1 << 16)
def _step(layer: Layer, letter: str) -> Layer:
    """The layer after one more turn; costs count from the least of the layer before."""
    base = min(x[0] for x in layer if x)
    ways = []  # (string up to this turn: rank and rest, cost, state, state before, edit)
    low, cut = letter.lower(), CUT * letter.isupper()
    for q, x in zip(STATES, layer, strict=True):
        if not x:
            continue
        cost, rank, n = x[0] - base, x[1], x[2]
        ways.append(((rank, "I" * n + "D"), cost + DELETE, q, q, "D"))
        if letter != GONE:
            if to := NEXT.get((q, low)):
                ways.append(((rank, "I" * n + "K"), cost + cut, to, q, "K"))
            for to in "ua":
                if (q, to) in NEXT:
                    ways.append(((rank, "I" * n + "R"), cost + REROLE + cut, to, q, "R"))
    ranks = {s: k for k, s in enumerate(sorted({w[0] for w in ways}))}
    found: dict[str, tuple] = {}
    for s, cost, to, before, edit in ways:
        new = (cost, ranks[s], 0, before, edit)
        if to not in found or new[:2] < found[to][:2]:
            found[to] = new
    return _layer(_inserted(found))


class Trie:
    """The path to the signature at hand, in a prefix trie whose signatures come in order: a layer a letter, with the cost that layers count from."""

    def __init__(self) -> None:
        self.path, self.layers, self.base, self.computed = "", [ROOT], [0], 0

    def insert(self, signature: str) -> tuple[int, str]:
        """Cost and edits of the cheapest repair. What the last signature shares with this one is taken as it is."""
        k, most = 0, min(len(self.path), len(signature))
        if self.path[:most] == signature[:most]:
            k = most
        else:
            low, high = 0, most
            while low < high:  # length of the shared prefix
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self.path[:mid] == signature[:mid] else (low, mid - 1)
            k = low
        del self.layers[k + 1 :], self.base[k + 1 :]
        for letter in signature[k:]:
            last = self.layers[-1]
            self.base.append(self.base[-1] + min(x[0] for x in last if x))
            self.layers.append(_step(last, letter))
            self.computed += 1
        self.path = signature
        return self._answer()

    def _answer(self) -> tuple[int, str]:
        end = self.layers[-1]
        best, state = min((end[STATES.index(q)][:3], q) for q in ENDS if end[STATES.index(q)])
        edits = []
        for layer in reversed(self.layers):
            *_, state_before, edit = layer[STATES.index(state)]
            edits.append(edit)
            state = state_before
        return self.base[-1] + best[0], "".join(reversed(edits))


def _text(name: str) -> Column:
    """The column as text; null is one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by crc32 of `conv_id:turn` modulo 20.

    0 drops the turn, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats it, 4 makes its role
    user. Nulls are one space, in the key as well; turn and conv_id themselves stay null. Rows that
    repeat a turn are damaged alike. An empty table gives an empty one, extra columns are left out.
    """
    fate = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def turns(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with the digest that orders and tells turns, and the faults that show in the text."""
    solid = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return rows.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text")).select("*", F.unhex(F.sha2("text", 256)).alias("digest"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))


ORDER = ("turn", "role", "digest")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of each conversation in turns().

    Turns go by number, nulls first; those of one number by role, then digest of the text.
    """
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(OTHER)
    rows = rows.drop("text").repartition("conv_id").withColumn("again", first & ~F.col("blank")).sortWithinPartitions("conv_id", *ORDER)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), initial.alias("initial"), "blank", "again", (F.col("cut") & ~F.col("blank") & ~F.col("again")).alias("cut"))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_signed, f"conv_id {id_type}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def _runs(column: pa.Array) -> list[tuple[int, int]]:
    """Stretches of equal values, null being one of its own."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cut = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
    return list(zip(cut[:-1], cut[1:], strict=True)) if len(codes) else []


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind: pa.Schema | None = None
    out: list[dict] = []
    now: dict | None = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        initial = np.array(batch["initial"].to_pylist(), dtype="U1")
        blank, again, cut = (np.asarray(batch[k].to_numpy(zero_copy_only=False), bool) for k in ("blank", "again", "cut"))
        letters = np.where(blank | again, GONE, np.where(cut, np.char.upper(initial), initial)) if len(initial) else initial
        numbered = batch["turn"].is_valid().to_numpy(zero_copy_only=False)
        turn = batch["turn"].fill_null(0).to_numpy(zero_copy_only=False)
        for i, j in _runs(batch["conv_id"]):
            who = batch["conv_id"][i].as_py()
            if now is None or who != now["conv_id"]:
                if now:
                    out.append(now)
                now = {"conv_id": who, "parts": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "low": None, "high": None, "distinct": 0, "end": ""}
            now["parts"].append("".join(letters[i:j].tolist()))
            for name, flags in (("blank", blank), ("duplicate", again), ("truncated", cut)):
                now[name] += int(flags[i:j].sum())
            roles = now["end"] + "".join(initial[i:j].tolist())
            now["illegal"] += sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
            now["end"] = roles[-1]
            if len(t := turn[i:j][numbered[i:j]]):
                now["distinct"] += int((t[1:] != t[:-1]).sum()) + (now["high"] is None or int(t[0]) != now["high"])
                now["low"] = int(t[0]) if now["low"] is None else now["low"]
                now["high"] = int(t[-1])
        if len(out) >= 2000:
            yield _report(out, kind)
            out = []
    if now:
        out.append(now)
    if out:
        yield _report(out, kind)


def _report(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    gaps = [x["high"] - x["low"] + 1 - x["distinct"] if x["high"] is not None else 0 for x in rows]
    counts = [pa.array([x[k] for x in rows], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")]
    return pa.record_batch([pa.array([x["conv_id"] for x in rows], kind), pa.array(["".join(x["parts"]) for x in rows], pa.string()), pa.array(gaps, pa.int64()), *counts], names=["conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        got = [trie.insert(s) for s in batch["signature"].to_pylist()]
        yield pa.record_batch([batch["signature"], batch["n"], pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], names=["signature", "n", "cost", "audit"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies edits: a conversation's audit comes before its turns."""
    audit, at, place, last, who, kind = "", 0, 0, "", None, None
    held: list[tuple] = []
    size = 0

    def give(role: str, text: str) -> None:
        nonlocal place, last, size
        held.append((who, place, role, text))
        place, last, size = place + 1, role[:1], size + len(text) + 64

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            give(ROLE["a" if last == "u" else "u"], "")
            at += 1

    def full() -> pa.RecordBatch:
        nonlocal size
        rows, held[:] = list(held), []
        size = 0
        return pa.record_batch([pa.array([x[0] for x in rows], kind), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.string()), pa.array([x[3] for x in rows], pa.string())], names=["conv_id", "position", "role", "text"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for k in range(len(batch)):
            if batch["head"][k].as_py():
                inserts()
                audit, at, place, last, who = batch["text"][k].as_py(), 0, 0, "", batch["conv_id"][k].as_py()
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                give(batch["role"][k].as_py(), batch["text"][k].as_py())
            elif edit == "R":
                give(ROLE["a" if last == "u" else "u"], batch["text"][k].as_py())
            if size > 4 << 20:
                yield full()
    inserts()
    if held:
        yield full()


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of rows(conv_id, turn, role, text), and the repaired turns.

    The first is (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), the second
    (conv_id, position, role, text), where a conversation's turns stand together and in order.

    Null roles and texts are one space; a null conv_id is a conversation of its own, null turns come
    first. Roles whose first letter is none of s, u, a (an empty one too) have to change or go.
    Repeated rows are duplicates; turns of one number go by role, then digest of the text. An empty table
    gives two empty ones. Other columns are left out. A conversation, however long, is read by one task as
    a stream, as the order of its turns asks for; the task holds its signature, a letter a turn.
    """
    found = turns(rows)
    signed = c.stored(signatures(found))
    total = signed.count()
    distinct = signed.groupBy("signature").agg(F.count("*").alias("n")).repartitionByRange("signature").sortWithinPartitions("signature")
    answers = c.stored(distinct.mapInArrow(_answered, "signature string, n long, cost long, audit string"))
    report = c.stored(c.spread_join(signed, answers, "signature", "n", total, ["conv_id"]).drop("signature"))
    heads = report.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    body = found.select("conv_id", F.lit(False).alias("head"), "turn", "role", "digest", "text")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER).select("conv_id", "head", "role", "text")
    id_type = both.schema["conv_id"].dataType.simpleString()
    return report, both.mapInArrow(_edited, f"conv_id {id_type}, position long, role string, text string")


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired turns as `role:text` lines. Takes the second result of repaired() as it comes: turns together and in order."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, who, sha = None, None, None
        ids, out = [], []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*(batch[k].to_pylist() for k in ("conv_id", "position", "role", "text")), strict=True):
                if place == 0:
                    if sha:
                        ids.append(who)
                        out.append(sha.hexdigest())
                    who, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
        if sha:
            ids.append(who)
            out.append(sha.hexdigest())
        if ids:
            yield pa.record_batch([pa.array(ids, kind), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])

    id_type = repaired_rows.schema["conv_id"].dataType.simpleString()
    return repaired_rows.mapInArrow(go, f"conv_id {id_type}, repaired_sha256 string")


def damage_report(conversations: DataFrame) -> DataFrame:
    """Conversations damaged and repaired: a row for each original conv_id, null included, with a digest of the repaired turns.

    One that lost all its turns has zeros, an empty audit and the digest of an empty text. See
    damaged() and repaired() for nulls, ties and repeats.
    """
    report, rows = repaired(damaged(conversations))
    all_ids = conversations.select(F.col("conv_id").alias("of")).distinct()
    done = c.stored(digests(rows)).withColumnRenamed("conv_id", "done")
    out = all_ids.join(report, F.col("of").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(done, F.col("of").eqNullSafe(F.col("done")), "left")
    zero = [F.coalesce(F.col(k), F.lit(0).cast("long")).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
