"""Shared pieces: work folder, vectorised word hashing, blob shuffles, connected components.

Texts never become Python objects per word here. A slice of about a megabyte of UTF-8 is
hashed at once: with T a random table over bytes and r odd, S(i) = sum of T[b_k] * r**k is a
prefix sum modulo 2**64, and a span [i, j) has the hash (S(j) - S(i)) * r**-i, whatever its
place. Spans that differ collide with a chance near 2**-64 a pair.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import lean

SLICE = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240607)
_FOLD = np.arange(256)
_FOLD[65:91] += 32  # A-Z
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
FOLDED = TABLE[_FOLD]
_R = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_POWERS: dict[str, np.ndarray] = {}
MULT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


#: Rows and bytes of the batches that reach Python; the functions here slice further.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Lowers the session's batch limits to BATCH for what runs inside: this bounds what a worker and its executor hold."""
    was = {key: spark.conf.get(key, None) for key in BATCH}
    for key, most in BATCH.items():
        if not (str(was[key]).isdigit() and 0 < int(was[key]) <= most):
            spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names; a temporary one only where none is named and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="quillon-")
        _OWN["dir"] = base
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"


#: The folders that stored() has written inside the innermost scratch().
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, the tables that stored() wrote inside. Gives a stored() whose tables stay: results that leave go through it."""
    paths: list[str] = []
    token = _WRITTEN.set(paths)

    def last(df: DataFrame) -> DataFrame:
        out, path = _written(df)
        if (outer := token.old_value) is not token.MISSING and outer is not None:
            outer.append(path)
        return out

    try:
        yield last
    finally:
        _WRITTEN.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends, a lost executor costs nothing."""
    out, path = _written(df)
    if (paths := _WRITTEN.get()) is not None:
        paths.append(path)
    return out


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_dir(df.sparkSession)
    with small_batches(df.sparkSession), lean(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["r"]) < n:
        m = max(n, SLICE + 4096)
        for k, r in (("r", _R), ("i", pow(_R, -1, 1 << 64))):
            a = np.full(m, r, np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a)
    return _POWERS["r"][:n], _POWERS["i"]


def prefix(buf: np.ndarray, values: np.ndarray = TABLE) -> np.ndarray:
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * _powers(len(buf))[0], out=s[1:])
    return s


def spans(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((s[ends] - s[starts]) * _powers(len(s))[1][starts] + (ends - starts).astype(np.uint64) * MULT[63])


def bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        d = np.concatenate(([0], d))
    if len(inside) and inside[-1]:
        d = np.concatenate((d, [len(inside)]))
    return d[0::2], d[1::2]


def words(buf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a buffer, A-Z taken as a-z."""
    if len(buf) <= 2 * SLICE:
        a, b = bounds(kind[buf])
        return a, b, spans(prefix(buf, FOLDED), a, b)
    parts, at = [], 0
    while at < len(buf):  # a long text: cut where a word ends
        end = min(len(buf), at + SLICE)
        while end < len(buf) and kind[buf[end - 1]] and kind[buf[end]]:
            rest = np.flatnonzero(~kind[buf[end : end + SLICE]])
            end += int(rest[0]) if len(rest) else min(SLICE, len(buf) - end)
        a, b = bounds(kind[buf[at:end]])
        parts.append((a + at, b + at, spans(prefix(buf[at:end], FOLDED), a, b)))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts of the rows and the end): each text ends with a line feed; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    joined = pc.binary_join_element_wise(column.cast(pa.large_string()).fill_null(""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)
    i = 0
    while i < len(joined):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, len(joined))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def planes(a: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane: the high planes compress to nothing."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return d.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: type = np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)
    return np.cumsum(d, dtype=dtype)


def dealt(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, rising with the key."""
    return ((keys >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


BLOBS = "shard int, a binary, b binary"


def blobs(keys: np.ndarray, nodes: np.ndarray, shards: int) -> pa.RecordBatch:
    """One row for each shard: its sorted keys and what goes with them."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    cut = np.searchsorted(dealt(keys, shards), np.arange(shards + 1))
    full = [(s, i, j) for s, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if j > i]
    return pa.record_batch(
        [pa.array([s for s, _, _ in full], pa.int32()), pa.array([planes(keys[i:j]) for _, i, j in full], pa.binary()), pa.array([nodes[i:j].tobytes() for _, i, j in full], pa.binary())],
        names=["shard", "a", "b"],
    )


class Sender:
    """Collects (key, node) pairs of a task and hands them out as blobs; a pair that repeats in the task goes once."""

    def __init__(self, shards: int, most: int = 1 << 21):
        self.shards, self.most, self.held, self.n = shards, most, [], 0

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append((keys, nodes))
            self.n += len(keys)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield blobs(np.concatenate([k for k, _ in self.held]), np.concatenate([v for _, v in self.held]), self.shards)
        self.held, self.n = [], 0


def stars(t: pa.Table) -> pa.Table:
    """The pairs of a shard: in each run of equal keys, every node with the smallest one, each pair once."""
    keys = np.concatenate([unplanes(x.as_py()) for x in t["a"]])
    nodes = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t["b"]])
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    run = np.cumsum(first) - 1
    low = np.minimum.reduceat(nodes, np.flatnonzero(first))[run]
    odd = low != nodes
    pairs = np.unique(np.stack((nodes[odd], low[odd]), 1), axis=0) if odd.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def star_edges(sent: DataFrame) -> DataFrame:
    return sent.groupBy("shard").applyInArrow(stars, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest node that each node of edges(a, b) reaches.

    By contraction: each node points to its smallest neighbour, pointers are doubled until they
    end in a root, edges go over to the roots, and repeat; every round at least halves the nodes
    that edges hold. All of it is joins and minima on distributed tables, each round written to
    the shared folder.
    """
    spark = edges.sparkSession
    known: DataFrame | None = None
    edges = stored(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    while not edges.isEmpty():
        both = edges.selectExpr("a id", "b to").unionAll(edges.selectExpr("b id", "a to"))
        up = stored(both.groupBy("id").agg(F.min("to").alias("to")).selectExpr("id", "least(id, to) to"))
        while True:  # pointers of pointers, until none moves
            over = stored(up.alias("x").join(up.selectExpr("id as mid", "to as end"), F.col("x.to") == F.col("mid"), "left").selectExpr("id", "to as was", "coalesce(end, to) to"))
            up = over.select("id", "to")
            if over.where("was <> to").isEmpty():
                break
        a = up.selectExpr("id as ai", "to as at")
        b = up.selectExpr("id as bi", "to as bt")
        edges = stored(edges.join(a, F.col("a") == F.col("ai")).join(b, F.col("b") == F.col("bi")).where("at <> bt").selectExpr("least(at, bt) a", "greatest(at, bt) b").distinct())
        up = up.selectExpr("id", "to as comp")
        if known is None:
            known = up
        else:
            known = stored(known.join(up.selectExpr("id as old", "comp as new"), F.col("comp") == F.col("old"), "left").selectExpr("id", "coalesce(new, comp) comp"))
    return known if known is not None else spark.createDataFrame([], "id long, comp long")


class Bitmap:
    """Which ids may be wanted: a bit array of at most 8 MiB. It lets too many through, never too few."""

    def __init__(self, ids: DataFrame, count: int):
        self.bits = 16
        while 1 << self.bits < 32 * count and self.bits < 26:
            self.bits += 1
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        bits = ids.selectExpr(f"pmod(id, {1 << self.bits}L) h").selectExpr("cast(shiftright(h, 6) as int) w", "shiftleft(1L, cast(h & 63 as int)) x")  # ids are hashes already
        for w, x in bits.groupBy("w").agg(F.bit_or("x")).collect():
            self.words[w] = _U(x & 0xFFFFFFFFFFFFFFFF)

    def __contains__(self, key: int) -> bool:
        at = key % (1 << self.bits)
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)


class Joined:
    """Union-find over the rows of one task; `same`: rows known to be one already."""

    def __init__(self, n: int, same: np.ndarray | None = None):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []
        if same is not None and same.any():
            self.label[same] = int(np.flatnonzero(same)[0])

    def join(self, i: int, j: int) -> None:
        a, b = int(self.label[i]), int(self.label[j])
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.edges.append((i, j))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df hasn't."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _place(df: DataFrame) -> Column | None:
    """A number for each row by its place in df's files, the same at every reading: a hash of the file's path plus the row's number within.

    None unless df is a scan of Parquet with columns and filters only, in which no two files' numbers overlap.
    """
    try:
        node = df._jdf.queryExecution().analyzed()
        if not node.deterministic() or "_metadata" in {x.lower() for x in df.columns}:
            return None
        while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
            node = node.children().head()
        if node.nodeName() != "LogicalRelation":
            return None
        at = df.metadataColumn("_metadata")
        first = F.xxhash64(at["file_path"]).bitwiseAND((1 << 62) - 1)
        ends = df.select(at["file_path"].alias("path"), first.alias("a"), at["row_index"].alias("n")).groupBy("path").agg(F.first("a").alias("a"), F.max("n").alias("n"))
    except (AnalysisException, AttributeError):
        return None
    ends = sorted((r.a, r.a + r.n) for r in ends.select("a", "n").collect())
    return first + at["row_index"] if all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False)) else None


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a number of its own for each row, and the number's column: ids may be null or repeat.

    Rows of files are numbered by their place and stay where they are; what was computed is written first.
    """
    row = fresh(df, "row_number")
    place = _place(df)
    return (stored(df.withColumn(row, F.monotonically_increasing_id())) if place is None else df.select("*", place.alias(row))), row


#: Keys that a join broadcasts at most, and rows from which on a key may be one of them.
HOT_KEYS, HOT_ROWS = 50_000, 256


def spread_join(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, salt: list[str], how: str = "inner") -> DataFrame:
    """big and the columns of small, unique by key, whatever share of big one key holds.

    weight: how many rows of big have the key; they sum to at most `total`. Keys of many rows are
    broadcast, at most HOT_KEYS of them; the rest are shuffled, hot rows being dealt by `salt`.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    more = [x for x in small.columns if x not in (key, weight)]
    hot = F.broadcast(small.where(F.col(weight) >= least).select(F.col(key).alias("_hot"), *(F.col(x).alias(f"_hot_{x}") for x in more)))
    rest = small.where(F.col(weight) < least).select(F.col(key).alias("_rest"), *more)
    j = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_by", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*salt).cast(big.schema[key].dataType)))
    j = j.join(rest, (F.col("_by") == F.col("_rest")) & F.col("_hot").isNull(), "left")
    if how == "inner":
        j = j.where("_hot is not null or _rest is not null")
    return j.select(*big.columns, *(F.coalesce(F.col(x), F.col(f"_hot_{x}")).alias(x) for x in more))


def first_of_class(seen: DataFrame, comps: DataFrame, value: Column, total: int, salt: list[str], how: str = "inner") -> DataFrame:
    """The rows of seen(node, ...) whose class has more than one row (left: all), with `first`: the class' least value.

    comps(id, comp): nodes that are in one class with others. Values are reduced by node, then by
    class, before anything is joined, so copies of one node are never gathered.
    """
    nodes = seen.groupBy("node").agg(F.min(value).alias("least"), F.count("*").alias("n"))
    nodes = stored(nodes.join(comps.withColumnRenamed("id", "member"), F.col("node") == F.col("member"), "left").select("node", F.coalesce("comp", "node").alias("class"), "least", "n"))
    classes = nodes.groupBy("class").agg(F.min("least").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("nodes")).where("rows > 1").drop("rows")
    info = spread_join(nodes.select("node", "class", "n"), classes, "class", "nodes", total, ["node"])
    return spread_join(seen, info.select("node", "n", "first"), "node", "n", total, salt, how)


#: Members of a candidate cluster from which on it is compared with its leader first.
LEAD = 512


def verified(members: DataFrame, content: DataFrame, close: Callable[[bytes, bytes], bool], compare: Callable[[pa.Table], pa.Table], most_rows: int, most_bytes: int) -> DataFrame:
    """Links (a, b), a forest of each task, between the members(id, comp) of candidate clusters by their content(node, s).

    A cluster of at most LEAD members and most_bytes is one task. In a larger one each member is
    first held against the leader, the smallest id, which is sent to as many tasks as it takes.
    Those close to it are one class from then on and are never compared with each other; the others
    are compared among themselves and with that class, in pairs of blocks. So a group of near
    copies costs one comparison a member, and no task holds more than two blocks.

    close: whether two contents are linked. compare gets a task's rows (id, own, bi, bj, same, s).
    """
    spark = members.sparkSession
    total = members.count()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    got = members.join(content, F.col("id") == F.col("node")).select("id", "comp", "s", F.octet_length("s").cast("long").alias("bytes"))
    got = stored(got)
    cut = stored(got.groupBy("comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("w"), F.min("id").alias("leader")).where("n > 1"))
    big = cut.where((F.col("n") > LEAD) | (F.col("w") > most_bytes))
    few = cut.where((F.col("n") <= LEAD) & (F.col("w") <= most_bytes))
    one = got.join(few.select(F.col("comp").alias("c")), F.col("comp") == F.col("c"), "left_semi").selectExpr("id", "comp", "s", "0 own", "0 bi", "0 bj", "false same")
    if big.isEmpty():
        return one.groupBy("comp", "bi", "bj").applyInArrow(compare, "a long, b long")
    led = spread_join(got, big.selectExpr("comp", "n", "leader", "cast(ceil(greatest(n / 256, w / 4194304)) as int) parts"), "comp", "n", total, ["id"])
    led = led.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    heads = led.where("id = leader").selectExpr("comp as hc", "explode(sequence(0, parts - 1)) hp", "s as head")

    def held(batches):
        for batch in batches:
            yes = [a == b or close(a, b) for a, b in zip(batch["s"].to_pylist(), batch["head"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["id"], batch["comp"], batch["leader"], batch["s"], batch["bytes"], pa.array(yes, pa.bool_())], names=["id", "comp", "leader", "s", "bytes", "same"])

    led = led.join(heads, (F.col("comp") == F.col("hc")) & (F.col("part") == F.col("hp"))).select("id", "comp", "leader", "s", "bytes", "head").mapInArrow(held, "id long, comp long, leader long, s binary, bytes long, same boolean")
    led = stored(led)
    rows, size = (lambda same: F.sum(F.when(F.col("same") == same, 1).otherwise(0))), (lambda same: F.sum(F.when(F.col("same") == same, F.col("bytes")).otherwise(0)))
    left = led.groupBy("comp").agg(F.count("*").alias("n"), rows(False).alias("u"), size(False).alias("uw"), rows(True).alias("r"), size(True).alias("rw")).where("u > 0")
    left = left.selectExpr("comp", "n", f"cast(greatest(ceil(u / {most_rows}), ceil(uw / {most_bytes})) as int) bu", f"cast(greatest(ceil(r / {most_rows}), ceil(rw / {most_bytes})) as int) br")
    own = spread_join(led, left, "comp", "n", total, ["id"]).withColumn("own", F.expr("cast(if(same, bu + pmod(xxhash64(id), br), pmod(xxhash64(id), bu)) as int)"))
    many = own.selectExpr("id", "comp", "s", "own", "explode(sequence(0, if(same, bu, bu + br) - 1)) other", "same").selectExpr("id", "comp", "s", "own", "least(own, other) bi", "greatest(own, other) bj", "same")
    links = one.unionByName(many).groupBy("comp", "bi", "bj").applyInArrow(compare, "a long, b long")
    return links.unionByName(led.where("same and id <> leader").selectExpr("id as a", "leader as b"))
