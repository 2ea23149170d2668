"""Benchmark decontamination with suffix arrays over the training texts.

Each task reads its documents in shards of up to a million words and sorts a shard's suffixes by
their first words (prefix doubling on hash order, at least as deep as the window). Every suffix of
a benchmark item that is long enough to begin a window is then found by binary search: the range it
delimits holds all occurrences, with their places. Windows that follow each other both in a document
and in an item make up a longest verbatim match. A document is whole in one shard, so nothing is
shuffled.

The suffixes of a benchmark of at most HANDED_BYTES of text are broadcast. Those of a larger one are
a table: documents send the windows that a bitmap of fixed size lets through, and these are joined
with it by 64-bit hash.

Window: `window` consecutive words of an item; an item of fewer words, but not none, is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SHARD_WORDS = (1 << 20) - 2
#: Text of a benchmark that is broadcast: its suffixes take some 30 times as much for a moment.
HANDED_BYTES = 8 << 20
_U = np.uint64


class Windows:
    """Distinct windows of benchmark items, by length, and where each stands: item and word."""

    def __init__(self, ids: list, texts: list, window: int):
        self.window, self.ids, rows = window, [None if i is None else str(i) for i in ids], {}
        for i0, _, buf, offs in c.slices(pa.array(texts, pa.string())):
            starts, _, h = c.words(buf, c.ALNUM)
            cut = np.searchsorted(starts, offs)
            for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                n = min(window, b - a)
                if n:
                    w = np.lib.stride_tricks.sliding_window_view(h[a:b], n)
                    rows.setdefault(n, []).append((np.full(len(w), i0 + k), np.arange(len(w)), w))
        self.by: dict[int, tuple] = {}
        for n, parts in rows.items():
            item, word, words = (np.concatenate([p[k] for p in parts]) for k in range(3))
            unique, inverse = np.unique(words, axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            order = np.argsort(inverse, kind="stable")
            self.by[n] = (unique, np.searchsorted(inverse[order], np.arange(len(unique) + 1)), item[order], word[order])


class Shard:
    """Suffix array of words; documents are kept apart by a word 0 after each."""

    def __init__(self, h: np.ndarray, depth: int):
        n = len(h)
        pos = np.arange(n, dtype=np.uint64)
        small = n <= SHARD_WORDS + 2
        low = _U(20)
        fixed = False
        if small:
            key = np.sort(h & ~_U(0xFFFFF) | pos)
            sa = (key & _U(0xFFFFF)).astype(np.int64)
            hs = h[sa]
            fixed = not ((key[1:] >> low == key[:-1] >> low) & (hs[1:] != hs[:-1])).any()
        if not fixed:
            sa = np.argsort(h, kind="stable")
            hs = h[sa]
        new = np.concatenate(([True], hs[1:] != hs[:-1]))
        self.vocabulary = hs[new]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new) - 1
        self.words, k = rank, 1
        while k < depth and not new.all():
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - k)] = rank[k:] + 1
            if small:
                key = np.sort(rank.astype(np.uint64) << _U(42) | ahead.astype(np.uint64) << low | pos)
                sa = (key & _U(0xFFFFF)).astype(np.int64)
                key >>= low
            else:
                whole = rank * np.int64(n + 1) + ahead
                sa = np.argsort(whole, kind="stable")
                key = whole[sa]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new) - 1
            k *= 2
        self.sa = sa

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of words: the rows whose words all occur, and the range of suffixes that begin with them."""
        at = np.searchsorted(self.vocabulary, q)
        at[at == len(self.vocabulary)] = 0
        known = np.flatnonzero((self.vocabulary[at] == q).all(1))
        q, n = at[known], len(self.sa)
        ends = []
        padded = np.concatenate((self.words, np.full(q.shape[1], -1)))
        step = np.arange(q.shape[1])
        for upper in (False, True):
            lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n)
            while True:
                todo = np.flatnonzero(lo < hi)
                if not len(todo):
                    break
                mid = (lo[todo] + hi[todo]) // 2
                p = padded[self.sa[mid][:, None] + step]
                differs = p != q[todo]
                first = differs.argmax(1)
                row = np.arange(len(todo))
                left = np.where(differs[row, first], p[row, first] < q[todo][row, first], upper)
                lo[todo] = np.where(left, mid + 1, lo[todo])
                hi[todo] = np.where(left, hi[todo], mid)
            ends.append(lo)
        return known, ends[0], ends[1]


def _each(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] of them, for each i in turn."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count - first, count)


def found(h: np.ndarray, windows: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length of the windows, places in the shard, and the window that stands at each."""
    shard = Shard(h, windows.window)
    for n, (unique, _, _, _) in windows.by.items():
        known, lo, hi = shard.find(unique)
        some = hi > lo
        count = (hi - lo)[some]
        if len(count):
            yield n, shard.sa[_each(count, lo[some])], np.repeat(known[some], count)


def hits(h: np.ndarray, doc: np.ndarray, docs: int, windows: Windows) -> tuple[np.ndarray, list[set]]:
    """Of a shard's documents: words inside a window, and ids of the items found."""
    items: list[set] = [set() for _ in range(docs)]
    cover = np.zeros(len(h) + 1, np.int64)
    for n, places, which in found(h, windows) if len(h) else ():
        _, at, item, _ = windows.by[n]
        np.add.at(cover, places, 1)
        np.add.at(cover, places + n, -1)
        pair = np.unique(doc[places] * np.int64(1 << 32) + which)
        d, which_of = pair >> 32, pair & 0xFFFFFFFF
        many = at[which_of + 1] - at[which_of]
        for k in np.unique(np.repeat(d, many) * np.int64(1 << 32) + item[_each(many, at[which_of])]).tolist():
            if windows.ids[k & 0xFFFFFFFF] is not None:
                items[k >> 32].add(windows.ids[k & 0xFFFFFFFF])
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(doc[inside], minlength=docs), items


def longest(h: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: Windows) -> Iterator[tuple[int, int, int, str | None, int]]:
    """Document, first word, words, item and first word there, of each longest match of a shard; start: of the documents in it."""
    parts = []
    for n, places, which in found(h, windows) if len(h) else ():
        _, at, item, word = windows.by[n]
        many = at[which + 1] - at[which]
        k = _each(many, at[which])
        parts.append(np.stack((item[k], np.repeat(places, many) - word[k], np.repeat(places, many), np.full(len(k), n))))
    if not parts:
        return
    item, ahead, place, n = np.concatenate(parts, 1)
    order = np.lexsort((place, ahead, item))  # what one item and one distance between the places have in common
    item, ahead, place, n = (x[order] for x in (item, ahead, place, n))
    first = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (ahead[1:] != ahead[:-1]) | (place[1:] != place[:-1] + 1))))
    size = np.diff(np.concatenate((first, [len(item)]))) + n[first] - 1
    for k, words in zip(first.tolist(), size.tolist(), strict=True):
        d = int(doc[place[k]])
        yield d, int(place[k] - start[d]), words, windows.ids[item[k]], int(place[k] - ahead[k])


def shards(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, words and a 0 after each text, the text of each word, and where each text begins."""
    held: list[np.ndarray] = []
    total = i0 = 0

    def done():
        size = np.array([len(x) + 1 for x in held])
        return i0, np.concatenate([np.append(x, _U(0)) for x in held]), np.repeat(np.arange(len(held)), size), np.cumsum(size) - size

    for _, _, buf, offs in c.slices(column):
        starts, _, h = c.words(buf, c.ALNUM)
        h[h == 0] = 1  # 0 parts documents
        cut = np.searchsorted(starts, offs)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and total + b - a + 1 > SHARD_WORDS:
                yield done()
                i0, held, total = i0 + len(held), [], 0
            held.append(h[a:b])
            total += b - a + 1
    if held:
        yield done()


def scan(column: pa.Array, windows: Windows) -> Iterator[tuple[int, int, int, str]]:
    """n_words, n_hit, n_items and the items' digest of each text, in order."""
    for _, h, doc, start in shards(column):
        n_hit, items = hits(h, doc, len(start), windows)
        for n, k, x in zip(np.diff(np.append(start, len(h))).tolist(), n_hit.tolist(), items, strict=True):
            yield n - 1, k, len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()


def suffixes(benchmark: DataFrame, window: int, id_col: str, text_col: str):
    """The benchmark's windows as a broadcast, or None if its text exceeds HANDED_BYTES."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    if (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > HANDED_BYTES:
        return None
    got = rows.collect()
    return benchmark.sparkSession.sparkContext.broadcast(Windows([r[0] for r in got], [r[1] for r in got], window))


# ---- a benchmark too large to hand out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.full(max(0, len(h) - n + 1), c.MULT[62] * _U(n))
    for k in range(n):
        out += h[k : k + len(out)] * c.MULT[k % 40] * _U(2 * (k // 40) + 1)
    return c.mix(out).view(np.int64)


def joined(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of docs(row, text) that the benchmark holds: (row, word, n, key); its (key, item, at); (row, words) of all rows."""

    def theirs(batches):
        for batch in batches:
            for i0, _, buf, offs in c.slices(batch["t"]):
                starts, _, h = c.words(buf, c.ALNUM)
                cut = np.searchsorted(starts, offs)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if n := min(window, b - a):
                        g = grams(h[a:b], n)
                        yield pa.record_batch([pa.array(g), pa.array([batch["i"][i0 + k].as_py()] * len(g), pa.string()), pa.array(np.arange(len(g))), pa.array(np.full(len(g), n, np.int32))], names=["key", "item", "at", "n"])

    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    bench = c.stored(items.mapInArrow(theirs, "key long, item string, at long, n int"))
    keys = bench.select("key").distinct()
    handed = docs.sparkSession.sparkContext.broadcast(c.Bitmap(keys.withColumnRenamed("key", "id"), bench.count()))
    sizes = sorted(r[0] for r in bench.select("n").distinct().collect())

    def ours(batches):
        bitmap = handed.value
        for batch in batches:
            for i0, _, buf, offs in c.slices(batch["text"]):
                starts, _, h = c.words(buf, c.ALNUM)
                cut = np.searchsorted(starts, offs)
                of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                for n in sizes:
                    g = grams(h, n)
                    at = g % (1 << bitmap.bits)
                    some = np.flatnonzero((bitmap.words[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool))
                    some = some[of[some] == of[some + n - 1]]
                    yield pa.record_batch([batch["row"].take(pa.array(of[some] + i0)), pa.array(some - cut[of[some]]), pa.array(np.full(len(some), n, np.int32)), pa.array(g[some])], names=["row", "word", "n", "key"])

    def measured(batches):
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(np.append(start, len(h))) - 1 for _, h, _, start in shards(batch["text"]))])
            yield pa.record_batch([batch["row"], pa.array(n, pa.int64())], names=["row", "words"])

    same = c.stored(docs.mapInArrow(ours, "row long, word long, n int, key long").join(keys, "key", "left_semi"))
    return same, bench, docs.mapInArrow(measured, "row long, words long")


def judged(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256) of docs(row, text), by the join."""
    same, bench, sizes = joined(docs, benchmark, window, id_col, text_col)
    before = F.max(F.col("word") + F.col("n")).over(Window.partitionBy("row").orderBy("word", "n").rowsBetween(Window.unboundedPreceding, -1))
    cover = same.withColumn("new", F.greatest(F.lit(0), F.col("word") + F.col("n") - F.greatest("word", F.coalesce(before, F.lit(0))))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    of = same.select("row", "key").distinct().join(bench.select("key", "item").distinct(), "key").where("item is not null").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    full = sizes.join(cover, "row", "left").join(of, "row", "left")
    return full.select("row", F.col("words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"))


# ---- operators

FOUND = "n_words long, n_hit long, n_items long, items_sha256 string"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    Null texts have no words on either side. A null item id marks words but isn't listed; repeated
    items count once. Other columns aren't read; rows aren't merged, whatever their ids. With an
    empty benchmark nothing is contaminated.
    """
    handed = suffixes(benchmark, window, item_col, text_col)
    if handed is None:
        base, row = c.numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
        got = judged(base.select(F.col(row).alias("row"), "text"), benchmark, window, item_col, text_col)
        out = base.select("id", F.col(row).alias("row")).join(got, "row").drop("row")
    else:

        def go(batches):
            for batch in batches:
                got = list(scan(batch["text"], handed.value))
                yield pa.record_batch([batch["id"], *(pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["id", "n_words", "n_hit", "n_items", "items_sha256"])

        kind = docs.schema[id_col].dataType.simpleString()
        out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, f"id {kind}, {FOUND}")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumnRenamed("id", id_col)


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id_col, first_word, n_words, item_id, item_word): each longest verbatim match of a document and an item, and where it stands in both.

    Words count from 0. A match has `window` words or more, or is a whole shorter item. Rows of equal
    id or text have each their own; null texts have none.
    """
    handed = suffixes(benchmark, window, item_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if handed is None:
        base, row = c.numbered(rows)
        same, bench, _ = joined(base.select(F.col(row).alias("row"), "text"), benchmark, window, item_col, text_col)
        one = same.join(bench.drop("n").distinct(), "key").selectExpr("row", "item", "word - at ahead", "word", "n")
        run = one.withColumn("run", F.col("word") - F.row_number().over(Window.partitionBy("row", "item", "ahead").orderBy("word")))
        runs = run.groupBy("row", "item", "ahead", "run").agg(F.min("word").alias("first_word"), (F.count("*") + F.max("n") - 1).alias("n_words"))
        return base.select("id", F.col(row).alias("row")).join(runs, "row").selectExpr("id", "first_word", "n_words", "item item_id", "first_word - ahead item_word").withColumnRenamed("id", id_col)

    def go(batches):
        for batch in batches:
            got = [(i0 + d, *x) for i0, h, doc, start in shards(batch["text"]) for d, *x in longest(h, doc, start, handed.value)]
            yield pa.record_batch([batch["id"].take(pa.array([x[0] for x in got], pa.int64())), *(pa.array([x[k] for x in got], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.int64())))], names=["id", "first_word", "n_words", "item_id", "item_word"])

    return rows.mapInArrow(go, f"id {kind}, first_word long, n_words long, item_id string, item_word long").withColumnRenamed("id", id_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, all their columns, without a benchmark window."""
    handed = suffixes(benchmark, window, item_col, text_col)
    if handed is None:
        base, row = c.numbered(docs)
        same, _, _ = joined(base.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), benchmark, window, item_col, text_col)
        key = c.fresh(base, "hit_row")
        return base.join(same.select(F.col("row").alias(key)).distinct(), F.col(row) == F.col(key), "left_anti").drop(row)

    def go(batches):
        for batch in batches:
            yield batch.filter(pa.array([x[1] == 0 for x in scan(batch[text_col], handed.value)], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)
