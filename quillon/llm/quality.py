"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Each text becomes some thirty statistics of the whole of it. They are standardised and sent
through cos(W x + b), whose inner products approximate a Gaussian kernel. Every partition of the
labelled rows gives its A'A and A'y; their sum is solved on the driver. Scores are then calibrated
by pool-adjacent-violators over a fixed number of score bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

FEATURES = 384
RIDGE = 1e-2
BINS = 1024
#: The classifier is fitted on about this many labelled rows at most, chosen by a hash of the id.
FIT_ROWS = 200_000
#: Partitions that the fitted sample is dealt to, hence matrices that reach the driver.
FIT_PARTS = 16
SEED = 7
_U = np.uint64

_CLASS = np.zeros(256, np.int64)  # 0: other symbols
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[128:192] = 6  # continuation bytes
_CLASS[192:] = 7
for _k, _b in enumerate(b".,!?;:'\"-|#$%&*/<>()[]{}=+_@~^\\`"):
    _CLASS[_b] = {0: 8, 1: 9, 2: 10, 3: 8, 4: 9, 5: 9, 6: 9, 7: 9, 8: 9, 9: 11}.get(_k, 12)
CLASSES = 13
STATS = 30


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS finite numbers for each text; null counts as empty."""
    out = np.zeros((len(column), STATS))
    for i0, i1, buf, offs in c.slices(column):
        kinds = _CLASS[buf]
        row = np.repeat(np.arange(i1 - i0), np.diff(offs))
        count = np.bincount(row * CLASSES + kinds, minlength=(i1 - i0) * CLASSES).reshape(-1, CLASSES).astype(float)
        count[:, 2] -= 1  # the line feed put after each text
        a, b, h = c.words(buf, c.SPACED)
        cut = np.searchsorted(a, offs)
        length = (b - a).astype(float)
        last, first = kinds[b - 1] if len(b) else kinds[:0], kinds[a] if len(a) else kinds[:0]
        two = c.mix(h[:-1] * c.MULT[0] + h[1:] * c.MULT[1])
        three = c.mix(two[:-1] * c.MULT[2] + h[2:] * c.MULT[3]) if len(h) > 2 else h[:0]
        lines_a, lines_b = c.bounds(buf != 10)
        line_h = c.spans(c.prefix(buf), lines_a, lines_b)
        line_cut = np.searchsorted(lines_a, offs)
        for k in range(i1 - i0):
            x, y = int(cut[k]), int(cut[k + 1])
            n, chars = y - x, max(1.0, count[k].sum() - count[k, 6])
            f = out[i0 + k]
            f[:CLASSES] = np.sqrt(np.maximum(count[k], 0) / chars)
            f[13] = np.log1p(chars)
            if not n:
                continue
            w = h[x:y]
            unique, times = np.unique(w, return_counts=True)
            f[14] = np.log1p(n)
            f[15], f[16] = length[x:y].mean(), length[x:y].std()
            f[17] = len(unique) / n
            f[18] = times.max() / n
            f[19] = (w[1:] == w[:-1]).mean() if n > 1 else 0
            f[20] = len(np.unique(two[x : y - 1])) / (n - 1) if n > 1 else 1
            f[21] = len(np.unique(three[x : y - 2])) / (n - 2) if n > 2 else 1
            f[22] = (last[x:y] == 8).mean()
            f[23] = np.isin(last[x:y], (0, 10, 11, 12)).mean()
            f[24] = (first[x:y] == 4).mean()
            f[25] = np.isin(first[x:y], (0, 3, 10, 11, 12)).mean()
            f[26] = -(times / n * np.log(times / n)).sum() / np.log1p(n)
            l0, l1 = int(line_cut[k]), int(line_cut[k + 1])
            f[27] = np.log1p(l1 - l0)
            f[28] = len(np.unique(line_h[l0:l1])) / max(1, l1 - l0)
            f[29] = np.log1p((lines_b[l0:l1] - lines_a[l0:l1]).mean()) if l1 > l0 else 0
    return out


class Model:
    """mean, spread, W, b, weights and the calibrated steps; without labelled rows every score is 0.5."""

    def __init__(self, sums: tuple | None = None):
        self.steps = None
        if sums is None:
            return
        n, total, squares = sums
        self.mean = total / n
        self.spread = np.sqrt(np.maximum(squares / n - self.mean**2, 0))
        self.spread[self.spread < 1e-6] = 1.0
        rng = np.random.default_rng(SEED)
        self.w = rng.normal(size=(STATS, FEATURES)) / np.sqrt(STATS)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + STATS + 1)

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z / np.sqrt(STATS), np.ones((len(z), 1))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising means of y over x in order, and the centres they stand at."""
    pools: list[list[float]] = []
    for a, w, v in zip(x.tolist(), weight.tolist(), y.tolist(), strict=True):
        pools.append([a * w, w, v * w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of each row: the statistics of the whole text as 4-byte floats."""

    def go(batches):
        for batch in batches:
            x = statistics(batch["text"]).astype(np.float32)
            yield pa.record_batch([batch["id"], pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, f"id {kind}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, STATS).astype(float)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """rows(id, x, y): y is 0 or 1. Sums leave the partitions, rows never do."""
    total = rows.count()
    if not total:
        return Model()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * fit_rows / total))
    rows = c.stored(rows.select("x", "y").repartition(FIT_PARTS))

    def moments(batches):
        n, t, s = 0, np.zeros(STATS), np.zeros(STATS)
        for batch in batches:
            x = _matrix(batch["x"])
            n, t, s = n + len(x), t + x.sum(0), s + (x**2).sum(0)
        yield pa.record_batch([pa.array([np.concatenate(([n], t, s)).tobytes()], pa.binary())], names=["m"])

    m = sum(np.frombuffer(r[0], float) for r in rows.mapInArrow(moments, "m binary").collect())
    if not m[0]:
        return Model()
    model = Model((m[0], m[1 : STATS + 1], m[STATS + 1 :]))
    size = len(model.weights)

    def normal(batches):
        a, v = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x, y = model.expand(_matrix(batch["x"])), batch["y"].to_numpy()
            a += x.T @ x
            v += x.T @ y
        yield pa.record_batch([pa.array([np.concatenate((a.ravel(), v)).tobytes()], pa.binary())], names=["m"])

    s = np.zeros(size * size + size)
    for r in rows.mapInArrow(normal, "m binary").toLocalIterator():
        s += np.frombuffer(r[0], float)
    model.weights = np.linalg.solve(s[: size * size].reshape(size, size) + RIDGE * m[0] / size * np.eye(size), s[size * size :])

    def binned(batches):
        got = np.zeros((3, BINS))
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch["x"])), -0.5, 1.5)
            at = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
            got += [np.bincount(at, w, BINS) for w in (np.ones(len(at)), raw, batch["y"].to_numpy())]
        yield pa.record_batch([pa.array([got.tobytes()], pa.binary())], names=["m"])

    n, raw, y = sum(np.frombuffer(r[0], float).reshape(3, BINS) for r in rows.mapInArrow(binned, "m binary").collect())
    full = n > 0
    model.steps = isotonic(raw[full] / n[full], n[full], y[full] / n[full])
    return model


def scored(measures: DataFrame, model: Model) -> DataFrame:
    """(id, score) of each row of measured()."""
    handed = measures.sparkSession.sparkContext.broadcast(model)

    def go(batches):
        for batch in batches:
            yield pa.record_batch([batch["id"], pa.array(handed.value.score(_matrix(batch["x"])))], names=["id", "score"])

    return measures.select("id", "x").mapInArrow(go, f"id {measures.schema['id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of each row of docs.

    Learned from rows whose crc32 of the id as text leaves a remainder by `folds`; the others are
    held out. A document with several labels has their mean; null labels and ids teach nothing and
    a row of null id isn't held out. Null texts are scored as empty ones. Equal texts score alike.
    """
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    x = c.stored(measured(docs, id_col, text_col))
    y = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("double").alias("y")).where("lid is not null and y is not null").groupBy("lid").agg(F.avg("y").alias("y"))
    model = fit(x.where(~held).join(y, F.col("id") == F.col("lid")).select("id", "x", "y"))
    return scored(x, model).select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality_kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of docs, all their columns, that score `cut` or more."""
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    y = labels.select(F.col("doc_id").alias("lid"), F.col("quality").cast("double").alias("y")).where("lid is not null and y is not null").groupBy("lid").agg(F.avg("y").alias("y"))
    with c.scratch(docs.sparkSession):
        learn = c.stored(measured(docs.where(~held).join(y.select("lid"), F.col(id_col) == F.col("lid"), "left_semi"), id_col, text_col))
        model = docs.sparkSession.sparkContext.broadcast(fit(learn.join(y, F.col("id") == F.col("lid")).select("id", "x", "y")))

    def go(batches):
        for batch in batches:
            x = statistics(batch[text_col]).astype(np.float32).astype(float)
            yield batch.filter(pa.array(model.value.score(x) >= cut))

    return docs.mapInArrow(go, docs.schema)
