"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word n-grams. Two sets of Jaccard similarity
t or more differ in at most D = (1 - t) / (1 + t) * (|A| + |B|) elements. Elements are dealt by
hash to k parts, and each part's sketch is the XOR of its elements' hashes: every bit is a parity,
and an element in which two sets differ changes one part. So at least k - D parts agree. Documents
are joined on (size band, part, sketch).

Which parts: with k = D + 1 + S parts, each side sends only its D + 1 fullest (ties by number).
That loses nothing: S + 1 parts at least agree, so have equal counts on both sides, and the fullest
of these has S fuller-or-equal ones beneath it on either side, hence is sent by both. It keeps out
the near-empty parts, in which unrelated documents would meet.

Size bands are such that linked sets lie in one or in neighbouring bands; a document sends the
sketches of its own band and, as the smaller side, those of the next.

Documents that meet form candidate clusters (a spanning star per sketch, then connected
components). Each cluster is compared in tasks of bounded size: a bit sketch (an element toggles
one of 2048 bits, and the Hamming distance is at most the symmetric difference) rules pairs out,
the exact sets decide, and pairs that are connected already are skipped. What leaves a task is a
forest, never all pairs. Equal sets are one node from the start.

Nothing is capped. Sets are identified by 64-bit hashes of their elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

BITS = 2048
BLOCK_ROWS, BLOCK_BYTES = 4096, 24 << 20
#: Bytes of sketches that one task sorts.
SHARD_BYTES = 24 << 20
_U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, one without words has none."""
    for _, _, buf, offs in c.slices(column):
        starts, _, h = c.words(buf, c.SPACED)
        cut = np.searchsorted(starts, offs)
        grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            grams += h[k : k + len(grams)] * c.MULT[k]
        grams = c.mix(grams)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j - i >= n:
                yield np.unique(grams[i : j - n + 1])
            elif j > i:
                yield c.mix((h[i:j] * c.MULT[: j - i]).sum(dtype=np.uint64, keepdims=True) + c.MULT[40 + j - i])
            else:
                yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """Identity of a set; 0 is the empty one."""
    if not len(s):
        return 0
    a = c.mix(s * c.MULT[50]).sum(dtype=np.uint64) ^ c.mix(np.array([np.bitwise_xor.reduce(s)]) + _U(len(s)))[0]
    return int(c.mix(np.array([a]))[0] >> _U(1)) | 1


class Bands:
    """Size bands for 'den * |A and B| >= num * |A or B|'."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1]

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def differ(self, g: int) -> int:
        """Most elements in which two linked sets of sizes below band g + 1 differ."""
        while len(self.low) < g + 2:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        return 2 * (self.low[g + 1] - 1) * (self.den - self.num) // (self.den + self.num)


def sketches(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The keys that a set sends. Bands whose linked sets must be equal send none: equal sets are one node."""
    if not len(s):
        return np.zeros(0, np.uint64)
    own, keys = bands.band(len(s)), []
    total = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(s)))
    for g in (own, own + 1):
        d = bands.differ(g)
        if not d:
            continue
        k = d + 1 + d // 2
        edges = ((np.arange(1, k, dtype=np.uint64) << _U(32)) // _U(k)) << _U(32)
        at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
        count = np.diff(at)
        sent = np.lexsort((np.arange(k), count))[k - d - 1 :]
        keys.append(c.mix((total[at[1:]] ^ total[at[:-1]])[sent] + sent.astype(np.uint64) * c.MULT[51] + np.uint64(g * 0x9E3779B97F4A7C15 % (1 << 64))))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bit_sketch(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s >> _U(7)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def compare(t: pa.Table, num: int, den: int) -> pa.Table:
    """A forest of the links between the two blocks of a task (or in its one block)."""
    ids = t["id"].to_numpy()
    own, bi, bj = t["own"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["s"]]
    n = np.array([len(s) for s in sets])
    bits = np.stack([bit_sketch(s) for s in sets])
    found = c.Joined(len(ids), t["same"].to_numpy())
    left = np.flatnonzero(own == bi)
    right = np.flatnonzero(own == bj)
    for i in left.tolist():
        others = right[right > i] if bi == bj else right
        while True:
            others = others[found.label[others] != found.label[i]]
            others = others[(n[others] * den >= n[i] * num) & (n[i] * den >= n[others] * num)]
            if not len(others):
                break
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1)
            others = others[apart * (den + num) <= (n[others] + n[i]) * (den - num)]
            hit = next((k for k, j in enumerate(others.tolist()) if linked(sets[i], sets[j], num, den)), None)
            if hit is None:
                break
            found.join(i, int(others[hit]))
            others = others[hit + 1 :]
    e = np.array(found.edges, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ids[e[:, 0]], pa.int64()), "b": pa.array(ids[e[:, 1]], pa.int64())})


def classed(rows: DataFrame, n: int, num: int, den: int, value: Column) -> tuple[DataFrame, DataFrame]:
    """rows(row, id, text) as (row, id, n, node), and those of them with an n-gram, with `first`: the least value of their class, null for lone rows."""

    def measure(batches):
        for batch in batches:
            got = [(len(s), node_of(s)) for s in shingle_sets(batch["text"], n)]
            yield pa.record_batch([batch["row"], batch["id"], pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["row", "id", "n", "node"])

    seen = c.stored(rows.mapInArrow(measure, f"row long, id {rows.schema['id'].dataType.simpleString()}, n long, node long"))
    count, total = seen.agg(F.count("*"), F.sum("n")).first()
    shards = max(12, int((total or 0) * 4 * (den - num) / (den + num)) * 16 // SHARD_BYTES)

    def send(batches):
        out, bands, sent = c.Sender(shards), Bands(num, den), set()
        for batch in batches:
            for s in shingle_sets(batch["text"], n):
                node = node_of(s)
                if node in sent:
                    continue
                if len(sent) < 1 << 20:  # copies in one task go once as far as this remembers; more only cost room
                    sent.add(node)
                keys = sketches(s, bands)
                yield from out.add(keys, np.full(len(keys), node, np.int64))
        yield from out.flush()

    members = c.components(c.star_edges(rows.select("text").mapInArrow(send, c.BLOBS)))
    handed = rows.sparkSession.sparkContext.broadcast(c.Bitmap(members, members.count()))

    def sets_of(batches):
        sent = set()
        for batch in batches:
            got = []
            for s in shingle_sets(batch["text"], n):
                node = node_of(s)
                if node and node in handed.value and node not in sent:
                    got.append((node, s.tobytes()))
                    if len(sent) < 1 << 20:
                        sent.add(node)
            yield pa.record_batch([pa.array([m for m, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["node", "s"])

    def close(x: bytes, y: bytes) -> bool:
        return linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den)

    sets = rows.select("text").mapInArrow(sets_of, "node long, s binary").groupBy("node").agg(F.first("s").alias("s"))
    links = c.verified(members, sets, close, lambda t: compare(t, num, den), BLOCK_ROWS, BLOCK_BYTES)
    return seen, c.first_of_class(seen.where("node <> 0"), c.components(links), value, count, ["row"], "left")


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs.

    component_id is the smallest id reachable by links of similarity num / den or more. Null and
    empty texts have no n-gram and are linked with nothing; their component is their own id. Rows
    of equal sets (repeated rows among them) are in one component; ids may repeat. A null id takes
    the smallest id of its component that isn't null, or null. Columns besides the two are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen, full = classed(rows, n, num, den, F.col("id"))
    out = full.select("id", "n", F.coalesce("first", "id").alias("component_id")).unionByName(seen.where("node = 0").selectExpr("id", "n", "id component_id"))
    return out.withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, without those that are near copies of another that stays.

    Of the rows linked by similarity num / den or more, directly or by others, one stays: that of
    the smallest id (nulls last; of equal ids any one). Rows are told apart by a number of their
    own, so a different text under a repeated or null id is a document like any other. Texts
    without a word are linked with nothing and stay.
    """
    base, row = c.numbered(docs)
    rows = base.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = c.fresh(base, "gone_row")
    with c.scratch(docs.sparkSession) as last:
        _, full = classed(rows, n, num, den, F.struct(F.col("id").isNull().alias("none"), "id", "row"))
        gone = last(full.where("first is not null and first.row <> row").select(F.col("row").alias(key)))
    return base.join(gone, F.col(row) == F.col(key), "left_anti").drop(row)
