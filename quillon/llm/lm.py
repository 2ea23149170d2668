"""Language model scores from an Elias-Fano n-gram trie.

Level one is the vocabulary: sorted 64-bit word hashes, whose ranks are word ids, with counts. The
levels below hold, for each n-gram, its last word after its context, so that a level is one rising
sequence. A context of level three is the place of its pair in level two: the low bits are the word,
and the unary part, with one bucket for each pair, is the monotone pointers that delimit the pair's
children. Lookups are successor searches within that range. In level two, of whose contexts a shard
has few, the low bits are chosen for space. Beside each entry stands its smoothed probability,
quantised to a byte; where an n-gram isn't found, the shorter one's, times what the context leaves it.

Probabilities of the orders are interpolated; the weights, by the size of the context, are those
under which the training text itself is likeliest with each token left out of its own counts.

Counting: tasks send distinct n-grams of a few million tokens as blobs to shards by hash of the
first two words, so no shard holds more of a frequent word than of others. A shard's levels and
counts are a file in the shared folder, which must be mounted on all machines; once the weights are
known, a second job writes its probabilities. Files are mapped where they are used, a bounded number
at a time, and what is needed is paged in, so memory doesn't grow with the model. All counts cover
all training tokens; nothing is pruned.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .elias_fano import EliasFano, open_arrays, write_arrays

ORDER = 3
#: Tokens that a task counts before it sends.
CHUNK = 2 << 20
#: Text bytes for each shard of the trie, and of the vocabulary.
SHARD_BYTES, VOCABULARY_BYTES = 10 << 20, 64 << 20
#: The end of a text, and what stands before its first word, as a word hash.
END = np.uint64(0x9E3779B97F4A7C15)
WEIGHTS = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
SIZES = 32
_U = np.uint64
#: Files mapped by a worker at a time.
MAPS = 2048


@lru_cache(MAPS)
def opened(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """A file's arrays and facts; none if nothing was dealt to it."""
    return open_arrays(path) if os.path.exists(path) else ({}, {})


def local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if ":/" in path:
        raise ValueError(f"the trie's files need a shared folder that is mounted on all machines, not {path}")
    return path


def streams(column: pa.Array, limit: int = 3 << 20):
    """(first row, tokens a row, hashes): each text's words and its end."""
    for i0, _, buf, offs in c.slices(column, limit):
        starts, _, h = c.words(buf, c.SPACED)
        cut = np.searchsorted(starts, offs[1:])
        out = np.insert(h, cut, END)
        yield i0, np.diff(np.concatenate(([0], cut))) + 1, out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


def small(counts: np.ndarray) -> bytes:
    """Counts by byte plane, in four bytes or eight."""
    c_ = counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)
    return c_.view(np.uint8).reshape(-1, c_.itemsize).T.tobytes()


def unsmall(b: bytes, n: int) -> np.ndarray:
    size = len(b) // n if n else 4
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, n).T).view(np.uint32 if size == 4 else np.uint64).reshape(-1).astype(np.int64)


def by_shard(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The shards that occur, each with the places at which it does."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    full, first = np.unique(to[order], return_index=True)
    yield from zip(full.tolist(), np.split(order, first[1:]), strict=True)


def packed_counts(n: np.ndarray) -> dict[str, np.ndarray]:
    """Counts in a byte each; those from 255 on stand apart."""
    over = np.flatnonzero(n >= 255)
    return {"n": np.minimum(n, 255).astype(np.uint8), "at": over.astype(np.int64), "over": n[over].astype(np.int64)}


class Vocabulary:
    """Level one: word ids by rank of the hash, counts by id."""

    def __init__(self, folder: str, sizes: list[int], total: int):
        self.folder, self.starts, self.total = folder, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), total
        self.size = int(self.starts[-1])

    def shard(self, k: int) -> dict[str, np.ndarray]:
        return opened(f"{self.folder}/vocabulary-{k}")[0]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Of sorted distinct hashes; -1 for unknown words."""
        out, n = np.full(len(h), -1, np.int64), len(self.starts) - 1
        for k, own in by_shard(c.dealt(h, n)):
            if self.starts[k + 1] > self.starts[k]:
                known = self.shard(k)["hash"]
                at = np.minimum(np.searchsorted(known, h[own]), len(known) - 1)
                out[own] = np.where(known[at] == h[own], at + self.starts[k], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """0 for unknown words."""
        out, k = np.zeros(len(ids), np.int64), np.searchsorted(self.starts, ids, side="right") - 1
        for s in np.unique(k[ids >= 0]).tolist():
            own = np.flatnonzero((k == s) & (ids >= 0))
            out[own] = self.shard(s)["count"][ids[own] - self.starts[s]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.size + 1)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return c.dealt(c.mix(pairs.astype(np.uint64) * c.MULT[60] + _U(1)), shards)


def quantised(p: np.ndarray) -> tuple[np.ndarray, list[float]]:
    x = np.log10(p)
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    return np.round((x - lo) / max(hi - lo, 1e-9) * 255).astype(np.uint8), [lo, max(hi - lo, 1e-9) / 255]


def left_out(n: np.ndarray, of: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each size of context and weight: the log likelihood of the tokens, each left out of its own count."""
    r = (n - 1) / np.maximum(of - 1, 1)
    size = np.minimum(np.log2(of).astype(int), SIZES - 1)
    return np.stack([np.bincount(size, n * np.log(w * r + (1 - w) * lower), SIZES) for w in WEIGHTS])


def build_shard(path: str, vocabulary: Vocabulary, blobs: list[bytes], order: int) -> np.ndarray:
    """Writes a shard's levels and counts; gives back what chooses the weights."""
    pairs, pair_n, triples, triple_n = [], [], [], []
    parts = [pickle.loads(b) for b in blobs]  # noqa: S301 - our own tasks' blobs
    for keys, n, _, _ in parts:
        pairs.append(c.unplanes(keys, np.int64))
        pair_n.append(unsmall(n, len(pairs[-1])))
    own, count = summed(np.concatenate(pairs), np.concatenate(pair_n))
    size = vocabulary.size
    a, b = own >> 32, own & 0xFFFFFFFF
    stats = np.zeros((2, len(WEIGHTS), SIZES))
    stats[0] = left_out(count, vocabulary.counts(a), vocabulary.base(vocabulary.counts(b)))
    arrays, facts = {}, {}

    def level(k: str, values: np.ndarray, universe: int, n: np.ndarray, bits: int | None = None) -> None:
        got, facts[k] = EliasFano.build(values, universe, bits)
        arrays.update({f"{k}{x}": v for x, v in (got | packed_counts(n)).items()})

    level("2", a * size + b, size * size, count)
    if order > 2:
        for (_, _, keys, n), local_pairs in zip(parts, pairs, strict=True):
            t = c.unplanes(keys, np.int64)
            triples.append(np.searchsorted(own, local_pairs)[t >> 32] << 32 | t & 0xFFFFFFFF)
            triple_n.append(unsmall(n, len(t)))
        t, n = summed(np.concatenate(triples), np.concatenate(triple_n)) if sum(map(len, triples)) else (np.zeros(0, np.int64),) * 2
        at, w = t >> 32, t & 0xFFFFFFFF
        if len(t):
            stats[1] = left_out(n, count[at], vocabulary.base(vocabulary.counts(w)))
        word = int(size).bit_length()
        level("3", at << word | w, len(own) << word, n, word)
    write_arrays(path, arrays, **facts)
    return stats


class Shard:
    """A shard's levels with their counts and, once written, probabilities."""

    def __init__(self, folder: str, k: int):
        self.arrays, self.facts = opened(f"{folder}/levels-{k}")
        self.paths = f"{folder}/probabilities-{k}"

    def level(self, k: str) -> EliasFano:
        return EliasFano(*(self.arrays[f"{k}{x}"] for x in ("low", "high", "zeros")), self.facts[k]["bits"], self.facts[k]["n"])

    def counts(self, k: str, at: np.ndarray) -> np.ndarray:
        """0 for -1."""
        n, over = self.arrays[f"{k}n"][np.maximum(at, 0)].astype(np.int64), self.arrays[f"{k}at"]
        high = np.flatnonzero(n == 255)
        if len(high):
            n[high] = self.arrays[f"{k}over"][np.searchsorted(over, np.maximum(at, 0)[high])]
        return np.where(at >= 0, n, 0)

    def probability(self, k: str, at: np.ndarray) -> np.ndarray:
        arrays, facts = opened(self.paths)
        lo, step = facts[k]
        return 10.0 ** (lo + step * arrays[k][at])

    def pair(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Places of pairs, or -1."""
        return self.level("2").find(a * size + b) if self.arrays else np.full(len(a), -1, np.int64)

    def child(self, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the words that follow pairs, or -1."""
        three = self.level("3")
        return three.find(pair << three.bits | word)


class Model:
    def __init__(self, folder: str, vocabulary: Vocabulary, shards: int, order: int, weights: np.ndarray):
        self.folder, self.vocabulary, self.shards, self.order, self.weights = folder, vocabulary, shards, order, weights

    def shard(self, k: int) -> Shard:
        return Shard(self.folder, k)

    def weight(self, level: int, of: np.ndarray) -> np.ndarray:
        """Of a context's own share, by its count; 0 for one that never occurred."""
        return np.where(of > 0, self.weights[level][np.minimum(np.log2(np.maximum(of, 1)).astype(int), SIZES - 1)], 0.0)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        for k, own in by_shard(shard_of(pairs, self.shards)):
            s = self.shard(k)
            if s.arrays:
                out[own] = s.counts("2", s.pair(pairs[own] >> 32, pairs[own] & 0xFFFFFFFF, self.vocabulary.size))
        return out

    def smooth(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities of known words b after a, by how often the pairs occurred."""
        of = self.vocabulary.counts(a)
        w = self.weight(0, of)
        return w * n / np.maximum(of, 1) + (1 - w) * self.vocabulary.base(self.vocabulary.counts(b))

    def write_probabilities(self, k: int) -> None:
        """The smoothed probabilities of a shard's entries. Pairs that a triple ends in may be in any shard."""
        s, size = self.shard(k), self.vocabulary.size
        if not s.arrays:
            return
        v = s.level("2").all().astype(np.int64)
        a, b, n = v // size, v % size, s.counts("2", np.arange(len(v)))
        arrays, facts = {}, {}
        arrays["2"], facts["2"] = quantised(self.smooth(a, b, n))
        if self.order > 2:
            three = s.level("3")
            t = three.all().astype(np.int64)
            at, word = t >> three.bits, t & ((1 << three.bits) - 1)
            ends, which = np.unique(b[at] << 32 | word, return_inverse=True)
            lower = self.smooth(ends >> 32, ends & 0xFFFFFFFF, self.pair_counts(ends))[which]
            w = self.weight(1, n[at])
            arrays["3"], facts["3"] = quantised(w * s.counts("3", np.arange(len(t))) / np.maximum(n[at], 1) + (1 - w) * lower)
        write_arrays(f"{self.folder}/probabilities-{k}", arrays, **facts)

    def score(self, tokens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of each text; h: the texts' words and ends, one after the other."""
        voc = self.vocabulary
        unique, inverse = np.unique(h, return_inverse=True)
        ids = voc.ids(unique)
        counts = voc.counts(ids)
        base = voc.base(counts)[inverse]
        row = np.repeat(np.arange(len(tokens)), tokens)
        known = np.bincount(row, counts[inverse] > 0, len(tokens)).astype(np.int64)
        p = base.copy()
        if voc.size and self.shards:
            b, of = ids[inverse], counts[inverse]
            end = voc.ids(np.array([END]))  # what stands before a text's first word
            a, of_a = np.concatenate((end, b[:-1])), np.concatenate((voc.counts(end), of[:-1]))
            p = (1 - self.weight(0, of_a)) * base
            both = np.flatnonzero((a >= 0) & (b >= 0))
            pairs, which = np.unique(a[both] << 32 | b[both], return_inverse=True)
            to = shard_of(pairs, self.shards)
            place, times, p2 = np.full(len(pairs), -1, np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs))
            for k, own in by_shard(to):
                s = self.shard(k)
                at = place[own] = s.pair(pairs[own] >> 32, pairs[own] & 0xFFFFFFFF, voc.size)
                hit = own[at >= 0]
                if len(hit):
                    times[hit], p2[hit] = s.counts("2", place[hit]), s.probability("2", place[hit])
            seen = place[which] >= 0
            p[both[seen]] = p2[which[seen]]
            if self.order > 2 and len(both):
                pair_at = np.full(len(h), -1, np.int64)
                pair_at[both[seen]] = which[seen]
                pair_at[h == END] = -1  # a text's first word follows its end alone
                ctx = np.concatenate(([-1], pair_at[:-1]))
                after = np.flatnonzero(ctx >= 0)
                p[after] *= 1 - self.weight(1, times[ctx[after]])
                some = after[b[after] >= 0]
                triples, which3 = np.unique(ctx[some] << 32 | b[some], return_inverse=True)
                p3 = np.zeros(len(triples))
                for k, own in by_shard(to[triples >> 32]):
                    s = self.shard(k)
                    at = s.child(place[triples[own] >> 32], triples[own] & 0xFFFFFFFF)
                    p3[own[at >= 0]] = s.probability("3", at[at >= 0])
                hit = p3[which3] > 0
                p[some[hit]] = p3[which3[hit]]
        return known, np.bincount(row, np.log10(base), len(tokens)), np.bincount(row, np.log10(p), len(tokens))


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """texts(text): every row teaches, a null one as an empty text."""
    spark = texts.sparkSession
    folder = local(c.shared_dir(spark))
    total = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    word_shards, shards = max(1, -(-total // VOCABULARY_BYTES)), max(8, -(-total // SHARD_BYTES)) if total else 0

    def tally(batches):
        held, n = [], 0

        def sent():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(c.dealt(keys, word_shards), np.arange(word_shards + 1)).tolist()
            full = [(k, i, j) for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pa.record_batch([pa.array([k for k, _, _ in full], pa.int32()), pa.array([c.planes(keys[i:j]) for _, i, j in full], pa.binary()), pa.array([small(counts[i:j]) for _, i, j in full], pa.binary())], names=["shard", "a", "b"])

        for batch in batches:
            for _, _, h in streams(batch["text"]):
                held.append(h)
                n += len(h)
                if n > CHUNK:
                    yield sent()
                    held, n = [], 0
        if held:
            yield sent()

    def vocabulary_file(t: pa.Table) -> pa.Table:
        keys = [c.unplanes(x.as_py()) for x in t["a"]]
        keys, counts = summed(np.concatenate(keys), np.concatenate([unsmall(x.as_py(), len(k)) for x, k in zip(t["b"], keys, strict=True)]))
        k = t["shard"][0].as_py()
        write_arrays(f"{folder}/vocabulary-{k}", {"hash": keys, "count": counts.astype(np.uint32 if counts.max() < 1 << 32 else np.uint64)})
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([len(keys)]), "total": pa.array([int(counts.sum())])})

    with c.small_batches(spark):
        got = {r[0]: (r[1], r[2]) for r in texts.select("text").mapInArrow(tally, c.BLOBS).groupBy("shard").applyInArrow(vocabulary_file, "shard int, n long, total long").collect()}
    vocabulary = Vocabulary(folder, [got.get(k, (0, 0))[0] for k in range(word_shards)], sum(x[1] for x in got.values()))
    if vocabulary.size >= 1 << 31:
        raise ValueError("more than 2**31 words: give the ids more bits")

    def count(batches):
        held, n = [], 0

        def sent():
            h = np.concatenate((np.array([END]), *held))
            unique, inverse = np.unique(h, return_inverse=True)
            s = vocabulary.ids(unique)[inverse]
            end = h == END
            pairs, which, pair_n = np.unique(s[:-1] << 32 | s[1:], return_inverse=True, return_counts=True)
            triples, triple_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if order > 2:
                inside = np.flatnonzero(~end[1:-1])
                triples, triple_n = np.unique(which[inside] << 32 | s[2:][inside], return_counts=True)
            to, new, none = shard_of(pairs, shards), np.empty(len(pairs), np.int64), np.zeros(0, np.int64)
            theirs = dict(by_shard(to[triples >> 32]))
            for k, own in by_shard(to):
                new[own] = np.arange(len(own))
                own3 = theirs.get(k, none)
                t = new[triples[own3] >> 32] << 32 | triples[own3] & 0xFFFFFFFF
                blob = pickle.dumps((c.planes(pairs[own]), small(pair_n[own]), c.planes(t), small(triple_n[own3])))
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "a"])

        for batch in batches:
            for _, _, h in streams(batch["text"]):
                held.append(h)
                n += len(h)
                if n > CHUNK:
                    yield from sent()
                    held, n = [], 0
        if held:
            yield from sent()

    def levels_file(t: pa.Table) -> pa.Table:
        k = t["shard"][0].as_py()
        stats = build_shard(f"{folder}/levels-{k}", vocabulary, [x.as_py() for x in t["a"]], order).ravel()
        return pa.table({"cell": pa.array(np.arange(len(stats))), "x": pa.array(stats)})

    stats = np.zeros((2, len(WEIGHTS), SIZES))
    with c.small_batches(spark):
        for r in texts.select("text").mapInArrow(count, "shard int, a binary").groupBy("shard").applyInArrow(levels_file, "cell long, x double").groupBy("cell").agg(F.sum("x")).collect():
            stats.flat[r[0]] = r[1]
    model = Model(folder, vocabulary, shards, order, WEIGHTS[stats.argmax(1)])

    def probabilities(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                model.write_probabilities(k)
            yield batch

    if shards:
        spark.range(0, shards, 1, -(-shards // 2)).mapInArrow(probabilities, "id long").agg(F.count("*")).collect()
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of each row; null texts are empty ones: their end is scored."""

    def go(batches):
        for batch in batches:
            for i0, tokens, h in streams(batch["text"]):
                known, base, score = model.score(tokens, h)
                n = len(tokens)
                yield pa.record_batch([batch["id"].slice(i0, n), pa.array(tokens), pa.array(known), pa.array(np.full(n, model.vocabulary.total)), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)


def lm_scores(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scored() with held_out, by a model of the rows that aren't held out.

    Held out: the crc32 of the id as text leaves the remainder `fold` by `folds`; a null id never
    is. Rows that repeat teach as often as they occur. With nothing to learn from every word has
    probability one.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    model = train(docs.where(~held).select(F.col(text_col).cast("string").alias("text")), order)
    return c.stored(scored(docs, model, id_col, text_col)).select(id_col, held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
