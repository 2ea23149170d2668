"""Near-duplicate lines by a segment-partition edit join.

A line of n characters (code points) allows n // EVERY edits, `edits` at most: two lines are near
copies if their distance is within what the shorter one allows. Two lines within k edits share one
of the k + 1 segments of the shorter one, at a place in the longer one that the edits left and
right of it allow. A line sends the hashes of its own segments, and of the substrings that could be
segments of shorter lines: (length, segment, substring). Lines that meet form candidate clusters,
which are compared in tasks of bounded size, large ones with a leader first: a bit sketch of
character pairs rules pairs out (an edit toggles four bits at most), then edit distance,
bit-parallel in a band, on what is left between common ends. Pairs that are connected already are
skipped, so a forest leaves each task.

Identical lines are one from the start; lines too short for an edit only go with identical ones.
White space at a line's ends doesn't count, and blank lines are no lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

EDITS = 2
#: Characters of a line for each edit that it allows.
EVERY = 20
BITS = 256
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
SHARD_BYTES = 24 << 20
_U = np.uint64


def lines(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: bytes, where each character begins, prefix sums, and row, number, first and last + 1 character and node of each line that isn't blank."""
    for i0, _, buf, offs in c.slices(column):
        ends = np.flatnonzero(buf == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        row = np.searchsorted(offs, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, offs[:-1])[row]
        solid = np.flatnonzero(c.SPACED[buf])
        a = np.searchsorted(solid, starts)
        b = np.searchsorted(solid, ends)
        full = b > a
        s = c.prefix(buf)
        a, b = solid[a[full]], solid[b[full] - 1] + 1
        node = (c.spans(s, a, b) >> _U(1)).astype(np.int64)
        chars = np.append(np.flatnonzero(buf & 0xC0 != 0x80), len(buf))
        yield buf, chars, s, row[full] + i0, number[full], np.searchsorted(chars, a), np.searchsorted(chars, b), node


def allowed(n: np.ndarray, edits: int) -> np.ndarray:
    """Edits that lines of these lengths allow."""
    return np.minimum(n // EVERY, edits)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each segment of lines of these lengths: even, the longer ones last."""
    size, more = length // (edits + 1), length % (edits + 1)
    out, at = [], np.zeros_like(length)
    for i in range(edits + 1):
        n = size + (i >= edits + 1 - more)
        out.append((at, n))
        at = at + n
    return out


def probes(s: np.ndarray, chars: np.ndarray, a: np.ndarray, b: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys that lines send, with the lines' numbers. A line's own segments are among them."""
    length = b - a
    for shorter in range(edits + 1):
        may = allowed(length - shorter, edits)
        for k in range(max(1, shorter), edits + 1):
            which = np.flatnonzero(may == k)
            own, other = length[which], length[which] - shorter
            for i, (at, n) in enumerate(segments(other, k)):
                low = max(-i, shorter - (k - i))
                high = min(i, shorter + (k - i))
                for move in range(low, high + 1):
                    p = at + move
                    ok = np.flatnonzero((p >= 0) & (p + n <= own))
                    if len(ok):
                        first = a[which[ok]] + p[ok]
                        h = c.spans(s, chars[first], chars[first + n[ok]])
                        yield c.mix(h + other[ok].astype(np.uint64) * c.MULT[45] + _U(int(c.MULT[46]) * (i + 1) % (1 << 64))), which[ok]


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: bit-parallel over the 2 * most + 1 diagonals."""
    if abs(len(x) - len(y)) > most:
        return False
    n = min(len(x), len(y))
    k = 0
    while k < n and x[k] == y[k]:
        k += 1
    x, y, n = x[k:], y[k:], n - k
    k = 0
    while k < n and x[-1 - k] == y[-1 - k]:
        k += 1
    x, y = x[: len(x) - k], y[: len(y) - k]
    if len(x) > len(y):
        x, y = y, x
    if len(y) <= most:
        return True
    if not x:
        return False
    # reach[e]: bit d is set if, with e edits, the alignment can stand on diagonal d (y runs d - most ahead of x)
    width = 2 * most + 1
    full = (1 << width) - 1
    same = {}
    for j, ch in enumerate(y):
        same[ch] = same.get(ch, 0) | 1 << (j + most)
    reach = []
    state = 1 << most
    for _ in range(most + 1):
        reach.append(state)
        state |= state << 1 & full
    for i, ch in enumerate(x):  # one more character of x; bit d of `match`: it equals y[i + d - most]
        match = same.get(ch, 0) >> i & full
        before, new = 0, []
        for e in range(most + 1):
            now = reach[e] & match
            if e:
                now |= before | before >> 1 | new[e - 1] << 1  # exchange, x's character dropped, y's dropped
            new.append(now & full)
            before = reach[e]
        reach = new
        if not reach[-1]:
            return False
    end = 1 << (len(y) - len(x) + most)
    return bool(reach[-1] & end)


def near(x: bytes, y: bytes, edits: int) -> bool:
    """Whether two lines in UTF-8 are within the edits that the shorter one allows."""
    x, y = x.decode("utf-8", "surrogateescape"), y.decode("utf-8", "surrogateescape")
    return within(x, y, min(min(len(x), len(y)) // EVERY, edits))


def pair_sketch(x: str) -> np.ndarray:
    v = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    h = (v[:-1] * 40503 + v[1:] * 30011) % 65521 % BITS
    return np.packbits(np.bincount(h, minlength=BITS).astype(np.uint8) & 1).view(np.uint64)


def compare(t: pa.Table, edits: int) -> pa.Table:
    """A forest of the links between the two blocks of a task (or in its one block)."""
    ids = t["id"].to_numpy()
    own, bi, bj = t["own"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
    texts = [x.decode("utf-8", "surrogateescape") for x in t["s"].to_pylist()]
    n = np.array([len(x) for x in texts])
    bits = np.stack([pair_sketch(x) for x in texts])
    found = c.Joined(len(ids), t["same"].to_numpy())
    right = np.flatnonzero(own == bj)
    for i in np.flatnonzero(own == bi).tolist():
        others = right[right > i] if bi == bj else right
        others = others[found.label[others] != found.label[i]]
        most = allowed(np.minimum(n[others], n[i]), edits)
        fit = np.abs(n[others] - n[i]) <= most
        others, most = others[fit], most[fit]
        if len(others):
            fit = np.bitwise_count(bits[others] ^ bits[i]).sum(1) <= 4 * most
            others, most = others[fit], most[fit]
        for j, k in zip(others.tolist(), most.tolist(), strict=True):
            if found.label[i] != found.label[j] and within(texts[i], texts[j], k):
                found.join(i, j)
    e = np.array(found.edges, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ids[e[:, 0]], pa.int64()), "b": pa.array(ids[e[:, 1]], pa.int64())})


def repeats(base: DataFrame, row: str, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, number, near) of each line that repeats an earlier line, exactly or within the edits.

    base: rows numbered by the column `row`, alike at every reading. Of a class of lines the first by document id
    (null first), then hash of the text, then row, then number stays. near: unlike the one that stays.
    """
    kind = base.schema[id_col].dataType.simpleString()
    rows = base.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def found(batches):
        for batch in batches:
            for _, _, _, at, number, a, b, node in lines(batch["text"]):
                at = pa.array(at)
                yield pa.record_batch([batch["row"].take(at), batch["id"].take(at), batch["h"].take(at), pa.array(number.astype(np.int32)), pa.array(node), pa.array((b - a).astype(np.int32))], names=["row", "id", "h", "number", "node", "chars"])

    seen = c.stored(rows.mapInArrow(found, f"row long, id {kind}, h long, number int, node long, chars int"))
    total, count = seen.agg(F.count("*"), F.sum((F.col("chars") >= EVERY).cast("long"))).first()
    shards = max(12, (count or 0) * (edits + 1) * (edits + 2) * 14 // SHARD_BYTES)

    def send(batches):
        out = c.Sender(shards)
        for batch in batches:
            for _, chars, s, _, _, a, b, node in lines(batch["text"]):
                _, once = np.unique(node, return_index=True)
                once = once[(b - a)[once] >= EVERY]
                for keys, which in probes(s, chars, a[once], b[once], edits):
                    yield from out.add(keys, node[once][which])
        yield from out.flush()

    members = c.components(c.star_edges(rows.select("text").mapInArrow(send, c.BLOBS)))
    handed = base.sparkSession.sparkContext.broadcast(c.Bitmap(members, members.count()))

    def texts(batches):
        bitmap, sent = handed.value, set()
        for batch in batches:
            for buf, chars, _, _, _, a, b, node in lines(batch["text"]):
                at = node % (1 << bitmap.bits)
                got = np.flatnonzero((bitmap.words[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool))
                got = [k for k in got.tolist() if node[k] not in sent]
                if len(sent) < 1 << 20:
                    sent.update(node[got].tolist())
                yield pa.record_batch([pa.array(node[got]), pa.array([buf[chars[a[k]] : chars[b[k]]].tobytes() for k in got], pa.binary())], names=["node", "s"])

    content = rows.select("text").mapInArrow(texts, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))
    links = c.verified(members, content, lambda x, y: near(x, y, edits), lambda t: compare(t, edits), BLOCK_ROWS, BLOCK_BYTES)
    shared = c.first_of_class(seen.drop("chars"), c.components(links), F.struct("id", "h", "row", "number", "node"), total, ["row", "number"])
    return shared.where("row <> first.row or number <> first.number").selectExpr("row", "number", "node <> first.node near")


def without(text: str | None, gone: list[int]) -> str:
    drop = set(gone)
    return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in drop)


def full_lines(text: str | None) -> int:
    return sum(1 for x in (text or "").split("\n") if x.strip(" \t\r\n\x0b\x0c"))


def deduplicated(docs: DataFrame, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """docs without the lines that repeat an earlier line of the corpus, exactly or within the edits.

    Of each class of lines the first stays, by document id (null first), then hash of the text;
    of rows equal in both it is one row's. Rows are told apart by a number of their own, so ids may
    be null or repeat: a row only loses lines that it holds and that stand elsewhere. Rows that lose
    all their lines go; ones that had none (null, empty or blank texts) stay as they are. With
    `detail`, all rows stay and columns n_lines, n_removed and n_near are added: lines, those
    removed, and those of them unlike the line that stays. A column n_chars follows the text; other
    columns, whatever their names, are passed on. An empty table gives an empty one.
    """
    base, row = c.numbered(docs)
    gone_, near_, key = (c.fresh(base, x) for x in ("gone", "near", "gone_row"))
    with c.scratch(docs.sparkSession) as last:
        own = last(repeats(base, row, edits, id_col, text_col).groupBy("row").agg(F.collect_list("number").alias(gone_), F.sum(F.col("near").cast("long")).alias(near_)).withColumnRenamed("row", key))
    joined = base.join(own.hint("merge"), F.col(row) == F.col(key), "left").drop(row, key)
    names = docs.columns

    def go(batches):
        for batch in batches:
            t, gone = batch[text_col].to_pylist(), batch[gone_].to_pylist()
            new = [x if not g else without(x, g) for x, g in zip(t, gone, strict=True)]
            keep = [not g or full_lines(x) > 0 for x, g in zip(new, gone, strict=True)]
            cols = [pa.array(new, pa.string()) if k == text_col else batch[k] for k in names]
            if "n_chars" in names and text_col != "n_chars":
                k, was = names.index("n_chars"), batch["n_chars"].to_pylist()
                cols[k] = pa.array([len(x) if g else w for x, g, w in zip(new, gone, was, strict=True)]).cast(batch["n_chars"].type)
            if detail:
                cols += [pa.array([full_lines(x) for x in t], pa.int64()), pa.array([len(g or ()) for g in gone], pa.int64()), pa.array([x or 0 for x in batch[near_].to_pylist()], pa.int64())]
            out = pa.record_batch(cols, names=[*names, *(("n_lines", "n_removed", "n_near") if detail else ())])
            yield out if detail else out.filter(pa.array(keep, pa.bool_()))

    more = [T.StructField(x, T.LongType()) for x in ("n_lines", "n_removed", "n_near")] if detail else []
    return joined.mapInArrow(go, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), *more]))
