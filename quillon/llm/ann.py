"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and code books are fitted by k-means on a bounded sample. Every vector is put in
the list of its nearest centroid, with the codes of its residual. A query visits the lists that
promise most; there, per-query tables of inner products with the code words give approximate
scores, and the best are scored again on the original vectors.

Lists that lie together form a group, and a query is sent to a group once, with the lists that it
visits there. A row keeps how far its code is from it: so each score lies within bounds, and every row
whose upper bound reaches the k-th lower one is scored exactly, however many rows share a code. In the
lists that a query visits nothing is missed. Groups are cut into chunks of bounded size by a hash of the id, and so are a group's
queries: no task holds more than a chunk of each, whatever third of the vectors shares a list. How
many lists a query visits at least is measured when the index is fitted, by some of the queries
against the sample; it goes on down its order until the lists hold several times the rows it asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: The index is fitted on about this many vectors at most, chosen by a hash of the id.
FIT_ROWS = 20_000
CODES = 256
SUB = 8
CHUNK = 8192
QUERIES = 1024
#: Lists in a group, about.
GROUP = 16
#: Share of the sample's true neighbours that the visited lists must hold, and by how many queries this is measured.
REACH = 0.98
TRIED = 512
RERANK = 12
SEED = 11


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row; the distances of some rows at a time are held."""
    size = (centres**2).sum(1)
    step = max(1, (4 << 20) // max(1, len(centres)))
    return np.concatenate([(x[k : k + step] @ centres.T * 2 - size).argmax(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = closest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Centroids, code books of the residuals' parts, and how many lists a query visits."""

    def __init__(self, sample: np.ndarray, total: int, k: int, asked: np.ndarray | None = None):
        self.dim = sample.shape[1]
        self.centres = kmeans(sample, max(1, min(len(sample) // 8, int(total**0.5), 4096)))
        middles = kmeans(self.centres, -(-len(self.centres) // GROUP))
        self.group = closest(self.centres, middles)
        self.groups = len(middles)
        order = np.argsort(self.group, kind="stable")
        self.place = np.empty(len(order), np.int64)  # of a list within its group
        self.place[order] = np.arange(len(order)) - np.searchsorted(self.group[order], np.arange(self.groups))[self.group[order]]
        own = self.nearest(sample)
        self.cuts = np.linspace(0, self.dim, min(SUB, self.dim) + 1).astype(int)
        rest = sample - self.centres[own]
        self.books = [kmeans(rest[:, a:b], CODES) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        q = sample[np.random.default_rng(SEED).permutation(len(sample))[:TRIED]] if asked is None or not len(asked) else asked
        s = q @ sample.T
        for row, v in zip(s, q, strict=True):  # a query is no neighbour of its own
            row[(sample == v).all(1)] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        order = self.promise(q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        need = np.sort(np.take_along_axis(place, own[best], 1)[np.take_along_axis(s, best, 1) > -np.inf])
        need = need if len(need) else np.zeros(1, np.int64)
        self.probes = int(need[min(len(need) - 1, int(REACH * len(need)))]) + 1

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return closest(x, self.centres)

    def promise(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.centres.T), axis=1, kind="stable")

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = x - self.centres[own]
        return np.stack([closest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        return self.centres[own] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of the queries' parts with all code words: query, part, code."""
        out = np.zeros((len(q), len(self.books), CODES))
        for m, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[:, m, : len(book)] = q[:, a:b] @ book.T
        return out


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of finite components that aren't all 0, and of the most common length (ties: the smaller); ids that aren't null."""
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size[0] if size else 0))


def nearest(embeddings: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows nearest by inner product to each row that `queries` (SQL over id) picks.

    Candidates are all rows but those of the query's own id; ties go to the smaller id. Vectors
    that are null, zero, hold null or non-finite components or are of an odd length take no part.
    Rows that repeat an id count once if their vectors are equal. An empty table gives no row.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vector_col)
    total = rows.count()
    kind = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], kind)
    share = rows if total <= FIT_ROWS else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * FIT_ROWS / total))
    sample = np.array([r[0] for r in share.select("v").collect()] or [r[0] for r in rows.select("v").take(256)])
    ask = rows.where(queries)
    asks = ask.count()
    few = ask if asks <= TRIED else ask.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1_000_000)) < int(1e6 * TRIED / asks))
    index = Index(sample, total, k, np.array([r[0] for r in few.select("v").collect()]))
    handed = spark.sparkContext.broadcast(index)
    dim = index.dim

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def filed(batches):
        for batch in batches:
            x = matrix(batch["v"])
            if len(x):
                i: Index = handed.value
                own = i.nearest(x)
                codes = i.encode(x, own)
                off = np.sqrt(((x - i.decoded(codes, own)) ** 2).sum(1))
                yield pa.record_batch([batch["id"], pa.array(own, pa.int32()), pa.array(i.group[own], pa.int32()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(off), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "list", "grp", "code", "off", "v"])

    lists = c.stored(rows.dropDuplicates(["id", "v"]).mapInArrow(filed, "id long, list int, grp int, code binary, off double, v binary"))

    sizes = np.zeros(len(index.centres), np.int64)
    for r in lists.groupBy("list").count().collect():
        sizes[r[0]] = r[1]

    def asked(batches):
        for batch in batches:
            x = matrix(batch["v"])
            if not len(x):
                continue
            i: Index = handed.value
            to = i.promise(x)
            held = np.cumsum(sizes[to], axis=1)
            short = held < RERANK * k + batch["own"].to_numpy()[:, None]  # an id's own rows are no candidates
            n = np.minimum(np.maximum(short.sum(1) + 1, i.probes), to.shape[1])
            visit = np.zeros(to.shape, bool)
            np.put_along_axis(visit, to, np.arange(to.shape[1])[None, :] < n[:, None], 1)
            ids, got = batch["id"].to_numpy(), []
            for g in range(i.groups):
                its = np.flatnonzero(i.group == g)
                its = its[np.argsort(i.place[its])]
                some = np.flatnonzero(visit[:, its].any(1))
                bits = np.packbits(visit[np.ix_(some, its)], axis=1)
                got += [(int(ids[q]), g, b.tobytes(), x[q].tobytes()) for q, b in zip(some.tolist(), bits, strict=True)]
            yield pa.record_batch([pa.array([r[j] for r in got], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["q", "grp", "visits", "qv"])

    cut = lists.groupBy("grp").agg(F.count("*").alias("n")).selectExpr("grp", f"cast(ceil(n / {CHUNK}) as int) chunks")
    probes = c.stored(ask.dropDuplicates(["id", "v"]).withColumn("own", F.count("*").over(Window.partitionBy("id"))).mapInArrow(asked, "q long, grp int, visits binary, qv binary"))
    qcut = probes.groupBy("grp").agg(F.count("*").alias("n")).selectExpr("grp", f"cast(ceil(n / {QUERIES}) as int) blocks")
    cuts = F.broadcast(c.stored(cut.join(qcut, "grp")))  # a row a group: 4096 / GROUP at most, or so
    left = lists.join(cuts, "grp").selectExpr("grp", "cast(pmod(xxhash64(id), chunks) as int) chunk", "explode(sequence(0, blocks - 1)) block", "id", "list", "code", "off", "v")
    right = probes.join(cuts, "grp").selectExpr("grp", "explode(sequence(0, chunks - 1)) chunk", "cast(pmod(xxhash64(q), blocks) as int) block", "q", "visits", "qv")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list = []
        if len(a) and len(b):
            i: Index = handed.value
            order = np.argsort(a["id"].to_numpy(), kind="stable")
            ids, own = a["id"].to_numpy()[order], a["list"].to_numpy()[order]
            codes = np.frombuffer(b"".join(a["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            x = np.frombuffer(b"".join(a["v"].to_pylist()), float).reshape(len(ids), dim)[order]
            off, size = a["off"].to_numpy()[order], np.sqrt((x**2).sum(1))
            qs, qv = b["q"].to_numpy(), np.frombuffer(b"".join(b["qv"].to_pylist()), float).reshape(len(b), dim)
            visits = np.unpackbits(np.frombuffer(b"".join(b["visits"].to_pylist()), np.uint8).reshape(len(b), -1), axis=1).astype(bool)
            for at in range(0, len(qs), 32):
                q = qv[at : at + 32]
                tables = i.tables(q)
                rough = (q @ i.centres.T)[:, own]
                for m in range(codes.shape[1]):
                    rough += tables[:, m][:, codes[:, m]]
                rough[~visits[at : at + 32][:, i.place[own]] | (ids[None, :] == qs[at : at + 32, None])] = -np.inf
                long = np.sqrt((q**2).sum(1))
                for r, key, v, n in zip(rough, qs[at : at + 32].tolist(), q, long.tolist(), strict=True):
                    near = np.flatnonzero(r > -np.inf)
                    slack = 1e-9 * n * size  # more than sums of doubles are off by
                    for width in (n * off + slack, slack):  # by the codes' bounds, then by products that are off by rounding only
                        if len(near) > k:
                            s, w = r[near] if width is not slack else x[near] @ v, width[near]
                            near = near[s + w >= np.partition(s - w, len(near) - k)[len(near) - k]]
                    s = (x[near] * v).sum(1)  # row by row: equal rows give equal numbers wherever they stand
                    best = np.argsort(-s, kind="stable")[:k]
                    out.append((np.full(len(best), key), ids[near][best], s[best]))
        cols = [np.concatenate([r[j] for r in out]) if out else np.zeros(0) for j in range(3)]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    keys = ["grp", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
