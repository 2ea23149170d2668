"""Hard-negative mining over a pivot table.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0): then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and an inner product is a distance. The pivot table has the
distances of all rows to a few pivots. For an anchor and a row, the triangle inequality over each
pivot brackets their distance, and so their score. Rows whose bracket misses what is asked for are
dropped; scores of the others are computed exactly, in integers.

Anchors and rows meet in tiles: both are dealt to groups of bounded size, and each pair of groups is
a task of its own, whatever share of the rows has one label or one vector. Within a task, rows are
taken in chunks that lie together, so whole chunks can be passed over. First tiles of one label give
the positives, then tiles of all rows the negatives between the bounds that positives set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Pivots are chosen among about this many rows at most, by a hash of the id; each next one lies farthest from those before.
PIVOTS, FIT_ROWS = 16, 4096
#: Rows and anchors of a tile at most, and groups that the rows of a small table are cut into.
TILE, ANCHORS, LEAST_TILES = 65_536, 16_384, 16
#: Rows, and anchors, that are scored at once.
CHUNK, BLOCK = 4096, 256
#: Whole numbers that a double holds.
EXACT = 1 << 53


def usable(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v): components floor(scale * x) as longs.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do
    vectors of another length than the most common one (ties: the shorter). Rows that repeat wholly count once.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (size[0] if size else 0))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")).distinct()


class Pivots:
    """Points of the augmented space, chosen farthest first, and the norm that augments."""

    def __init__(self, sample: np.ndarray, norm2: float):
        self.norm2 = norm2
        points = self.augmented(sample)
        chosen = [0]
        far = self._distances(points, points[:1])[:, 0]
        while len(chosen) < min(PIVOTS, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._distances(points, points[chosen[-1:]])[:, 0])
        self.points = points[chosen]

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))[:, None]), 1)

    @staticmethod
    def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in p], 1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self.augmented(x), self.points)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.concatenate((q, np.zeros((len(q), 1))), 1), self.points)


class Tile:
    """Rows of a task, cut into chunks of one label that lie together."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, d: np.ndarray):
        self.chunks: list[tuple] = []
        if not len(ids):
            return
        nearest = d.argmin(1)
        order = np.lexsort((ids, d[np.arange(len(d)), nearest], nearest, labels))
        ids, labels, x, d = ids[order], labels[order], x[order], d[order]
        for i in [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist()]:
            j = i + int(np.searchsorted(labels[i:], labels[i], side="right"))
            for k in range(i, j, CHUNK):
                part = slice(k, min(k + CHUNK, j))
                by_id = np.argsort(ids[part], kind="stable")  # so that the first of equal scores has the smallest id
                own = d[part][by_id]
                self.chunks.append((int(labels[k]), ids[part][by_id], x[part][by_id], own, own.min(0), own.max(0)))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles where they hold them."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def brackets(dq: np.ndarray, q2: np.ndarray, low: np.ndarray, high: np.ndarray, norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor with rows whose pivot distances lie in [low, high]; a little wider than it has to be, as the table's distances are floats."""
    near = np.zeros((len(dq), len(low)))
    far = np.full((len(dq), len(low)), np.inf)
    for j in range(dq.shape[1]):
        a = dq[:, j, None]
        np.maximum(near, np.maximum(a - high[None, :, j], low[None, :, j] - a), out=near)
        np.minimum(far, a + high[None, :, j], out=far)
    slack = 2e-6 * (q2[:, None] + norm2) + 1
    return (q2[:, None] + norm2 - far * far) / 2 - slack, (q2[:, None] + norm2 - near * near) / 2 + slack


class Best:
    """The first k (score, id) of each anchor so far: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            keep = np.flatnonzero(scores >= least)
            keep = keep[np.argsort(-scores[keep], kind="stable")][: self.k]
            scores, ids = scores[keep], ids[keep]
        self.held[i] = sorted([*self.held[i], *((-int(s), int(x)) for s, x in zip(scores, ids, strict=True))])[: self.k]
        if len(self.held[i]) == self.k:
            self.least[i] = -self.held[i][-1][0]


def positives_in(tile: Tile, label: int, ids: np.ndarray, q: np.ndarray, dq: np.ndarray, k: int, norm2: float) -> Best:
    """The k best rows of the anchors' label but the anchor's own id."""
    q2, best = (q.astype(np.float64) ** 2).sum(1), Best(len(q), k)
    for of, row_ids, x, d, low, high in tile.chunks:
        if of != label:
            continue
        some = np.flatnonzero(brackets(dq, q2, low[None], high[None], norm2)[1][:, 0] >= best.least)
        for i in range(0, len(some), BLOCK):
            block = some[i : i + BLOCK]
            may = brackets(dq[block], q2[block], d, d, norm2)[1] >= best.least[block, None]
            cols = np.flatnonzero(may.any(0))
            scores = _exact(q[block], x[cols])
            for r, a in enumerate(block):
                yes = may[r, cols] & (row_ids[cols] != ids[a])
                best.add(a, scores[r, yes], row_ids[cols][yes])
    return best


def negatives_in(tile: Tile, labels: np.ndarray, q: np.ndarray, dq: np.ndarray, bounds: list[list[tuple[int, int]]], k: int, ratio: tuple[int, int, int], norm2: float) -> list[Best]:
    """For each bound (positive's score) of each anchor, the k best rows of other labels whose score lies between its shares."""
    least, most, whole = ratio
    q2 = (q.astype(np.float64) ** 2).sum(1)
    found = [Best(len(b), k) for b in bounds]
    floor = np.array([min((least * s for s in b), default=np.inf) / whole for b in bounds])
    ceiling = np.array([max((most * s for s in b), default=-np.inf) / whole for b in bounds])
    for of, row_ids, x, d, low, high in tile.chunks:
        down, up = (v[:, 0] for v in brackets(dq, q2, low[None], high[None], norm2))
        some = np.flatnonzero((labels != of) & (up >= floor) & (down <= ceiling))
        for i in range(0, len(some), BLOCK):
            block = some[i : i + BLOCK]
            down, up = brackets(dq[block], q2[block], d, d, norm2)
            may = (up >= floor[block, None]) & (down <= ceiling[block, None])
            cols = np.flatnonzero(may.any(0))
            scores = _exact(q[block], x[cols])
            may = may[:, cols] & (scores >= np.floor(floor[block, None])) & (scores <= np.ceil(ceiling[block, None]))
            for r, a in enumerate(block):
                hit = np.flatnonzero(may[r])
                if not len(hit):
                    continue
                hit = hit[np.argsort(-scores[r, hit], kind="stable")]
                s, who = scores[r, hit], row_ids[cols][hit]
                for n, p in enumerate(bounds[a]):
                    at = int(np.searchsorted(-s, -(most * p // whole), side="left"))  # the first of at most this score
                    top = [j for j in range(at, min(at + k, len(s))) if whole * int(s[j]) >= least * p]
                    if top:
                        found[a].add(n, s[top], who[top])
    return found


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), kind) for x in column]) if len(column) else np.zeros((0, 0), kind)


def _parts(t: pa.Table, kind: type) -> tuple[Tile, pa.Table, np.ndarray, np.ndarray]:
    """A task's rows, its anchors, and the anchors' vectors and pivot distances."""
    rows, own = t.filter(pc.invert(t["anchor"])), t.filter(t["anchor"])
    tile = Tile(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["x"], kind).astype(np.int64), _matrix(rows["d"], np.float32).astype(np.float64))
    return tile, own, _matrix(own["x"], kind).astype(np.int64), _matrix(own["d"], np.float32).astype(np.float64)


def _groups(n: str) -> str:
    """How many groups n rows are cut into, in SQL."""
    return f"cast(greatest(1, ceil({n} / least({TILE}, greatest(256, ceil({n} / {LEAST_TILES}))))) as int)"


def mined(table: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, ratio: tuple[int, int, int] = (50, 95, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, which `anchors` (SQL over id) picks.

    A score is the inner product of components floor(scale * x). Positives are the best other rows of
    the anchor's label, negatives the best of other labels with ratio[0] * positive <= ratio[2] * score <=
    ratio[1] * positive; ties go to the smaller id. An anchor or positive with none gives no row.

    usable() says what takes no part; rows that repeat count once, and rows of the anchor's own id
    are none of its positives. Anchors of one id and label but different vectors are answered together, the
    best scores first. An empty table gives no row. Vectors may be zero. Scores beyond 64 bits overflow.
    """
    spark = table.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = c.stored(usable(table, id_col, label_col, vector_col, scale))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, norm2, most = rows.agg(F.count("*"), F.max(norm("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if not total:
        return spark.createDataFrame([], kind)
    share = max(1, -(-total // FIT_ROWS))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy(F.xxhash64("id"), "label").limit(FIT_ROWS).select("v").collect() or rows.limit(1).select("v").collect()
    packed = next((x for x in (np.int16, np.int32) if 0 <= most <= np.iinfo(x).max), np.int64)
    pivots = Pivots(np.array([r[0] for r in sample], np.float64), float(norm2))

    def measured(batches):
        for batch in batches:
            flat = batch["v"].flatten().to_numpy()
            x = flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, 0), np.int64)
            for anchor, d in ((False, pivots.of_rows), (True, pivots.of_anchors)):
                keep = np.flatnonzero(batch["is_anchor"].to_numpy(zero_copy_only=False)) if anchor else np.arange(len(batch))
                if len(keep):
                    got = d(x[keep].astype(np.float64)).astype(np.float32)
                    yield pa.record_batch([batch["id"].take(keep), batch["label"].take(keep), pa.array([anchor] * len(keep), pa.bool_()), pa.array([r.tobytes() for r in x[keep].astype(packed)], pa.binary()), pa.array([r.tobytes() for r in got], pa.binary())], names=["id", "label", "anchor", "x", "d"])

    pivot_table = c.stored(rows.withColumn("is_anchor", F.coalesce(F.expr(anchors), F.lit(False))).mapInArrow(measured, "id long, label long, anchor boolean, x binary, d binary"))
    counts = pivot_table.groupBy("label").agg(F.sum(F.expr("int(not anchor)")).alias("n"), F.sum(F.expr("int(anchor)")).alias("m"), F.count("*").alias("both")).where("m > 0")
    sizes = counts.selectExpr("label", "both", f"{_groups('n')} g", f"cast(ceil(m / {ANCHORS}) as int) b")
    dealt = c.spread_join(pivot_table, sizes, "label", "both", 2 * total, ["id"])

    def tiles(df: DataFrame, g: str, b: str) -> DataFrame:
        """Each row to a tile of its own group with each group of anchors, and the other way round."""
        own = df.withColumn("own", F.pmod(F.xxhash64("id", "label"), F.when(F.col("anchor"), F.expr(b)).otherwise(F.expr(g))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("anchor"), F.expr(g)).otherwise(F.expr(b)) - 1))
        return own.withColumn("other", other).withColumn("gi", F.when(F.col("anchor"), F.col("other")).otherwise(F.col("own"))).withColumn("bi", F.when(F.col("anchor"), F.col("own")).otherwise(F.col("other")))

    norm2 = float(norm2)

    def near(t: pa.Table) -> pa.Table:
        tile, own, q, dq = _parts(t, packed)
        out: list[tuple[int, int, int, int]] = []
        if len(own) and tile.chunks:
            ids, label = own["id"].to_numpy(), own["label"][0].as_py()
            best = positives_in(tile, label, ids, q, dq, positives, norm2)
            out = [(int(i), label, x, -s) for i, held in zip(ids, best.held, strict=True) for s, x in held]
        return pa.table({k: pa.array([r[n] for r in out], pa.int64()) for n, k in enumerate(("anchor_id", "label", "positive_id", "positive_score"))})

    found = tiles(dealt, "g", "b").select("label", "gi", "bi", "id", "anchor", "x", "d").groupBy("label", "gi", "bi").applyInArrow(near, "anchor_id long, label long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id", "label").orderBy(F.desc("positive_score"), "positive_id")
    found = c.stored(found.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n"))
    asked = found.groupBy(F.col("anchor_id").alias("of"), F.col("label").alias("of_label")).agg(F.sort_array(F.collect_list("positive_score")).alias("bounds"))
    bounded = pivot_table.where("anchor").join(asked, (F.col("id") == F.col("of")) & (F.col("label") == F.col("of_label"))).select("id", "label", "anchor", "x", "d", "bounds")
    many = asked.count()
    everything = pivot_table.where("not anchor").withColumn("bounds", F.lit(None).cast("array<long>")).unionByName(bounded)

    def hard(t: pa.Table) -> pa.Table:
        tile, own, q, dq = _parts(t, packed)
        out: list[tuple[int, ...]] = []
        if len(own) and tile.chunks:
            ids, labels, bounds = own["id"].to_numpy(), own["label"].to_numpy(), [sorted(set(b)) for b in own["bounds"].to_pylist()]
            order = np.lexsort((dq.argmin(1), labels))  # anchors that lie together are scored together
            got = negatives_in(tile, labels[order], q[order], dq[order], [bounds[i] for i in order], negatives, ratio, norm2)
            out = [(int(ids[i]), int(labels[i]), p, x, -s) for i, best in zip(order, got, strict=True) for p, held in zip(bounds[i], best.held, strict=True) for s, x in held]
        return pa.table({k: pa.array([r[n] for r in out], pa.int64()) for n, k in enumerate(("of", "of_label", "bound", "negative_id", "negative_score"))})

    everything = everything.withColumn("total", F.lit(total)).withColumn("many", F.lit(many))
    hit = tiles(everything, _groups("total"), f"cast(greatest(1, ceil(many / {ANCHORS})) as int)").select("gi", "bi", "id", "label", "anchor", "x", "d", "bounds").groupBy("gi", "bi").applyInArrow(hard, "of long, of_label long, bound long, negative_id long, negative_score long")
    last = Window.partitionBy("of", "of_label", "bound").orderBy(F.desc("negative_score"), "negative_id")
    hit = hit.distinct().withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
    out = found.join(hit, (F.col("anchor_id") == F.col("of")) & (F.col("label") == F.col("of_label")) & (F.col("positive_score") == F.col("bound")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
