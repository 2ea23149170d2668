"""Best-fit packing with swap-based local search.

Texts become token ids; longer ones than a sequence are cut, the first piece being the shorter.
Which pieces go together depends on their lengths only, so it is planned on the histogram of
lengths: bins of like content are one pattern with a count, however many pieces there are. Best-fit
decreasing makes the patterns; then the emptiest bin hands its pieces on to other underfull bins by
moves, one-for-one and two-for-one exchanges (either way), each of which raises the sum of squared
fills, until it is empty or nothing fits; so do all underfull patterns, each with all its copies.
Pieces then take the slots of their length by rank.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SEQUENCE = 2048
END_ID = 0
#: Pieces of one length in a bucket that is ranked by one task, about.
BUCKET = 100_000

# The public tokenizer's split pattern, in possessive form, and the texts (of Latin
# letters and common punctuation) whose characters every Unicode version classes alike.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_PLAIN = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-ſ‐-‧‰-⁞€]*")


class Tokens:
    """Ids of whole texts by a `tokenizers` file.

    Where the file is a byte-level byte-pair model of the kind that _SPLIT belongs to, with merges
    in the order of its ids, plain texts go through the same merges as ranks, which is some five
    times as fast. All other texts, those that hold a special token among them, go through the
    file's own model.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = [x["content"] for x in data.get("added_tokens") or []]
        self.ranked = None
        model, before = data["model"], data.get("pre_tokenizer") or {}
        usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        if usual and data.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
            vocab, joined = model["vocab"], ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
            # byte-level vocabularies write bytes as characters: printable ones as themselves, the rest from 256 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in shown]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
            if [vocab[t] for t in joined] == list(range(256, 256 + len(joined))):
                ranks = {bytes(byte[ch] for ch in t): i for t, i in vocab.items() if t not in self.special}
                self.ranked = tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is None or not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)


def cut(ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: all but the first are of full length."""
    first = len(ids) % most if len(ids) > most else len(ids)
    out = [(0, first)] if first else []
    return out + [(k, most) for k in range(first, len(ids), most)]


def pieces(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc) of each document's ids; a null text counts as empty and still has its end."""

    def go(batches):
        tokens = Tokens(tokenizer)
        for batch in batches:
            got = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(tokens(text or ""), np.uint32(end_id)).astype("<u4")
                got += [(key, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(ids, most))]
            yield pa.record_batch([pa.array([x[k] for x in got], pa.int32() if k == 1 else pa.int64()) for k in range(5)], names=["id", "piece", "start", "length", "crc"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(go, "id long, piece int, start long, length long, crc long")


class Bins:
    """Patterns (sorted lengths, longest first) with counts, found by the room that is left."""

    def __init__(self, most: int):
        self.most, self.by, self.rooms = most, {}, []

    def add(self, pattern: tuple[int, ...], n: int) -> None:
        if n:
            room = self.most - sum(pattern)
            if room not in self.by:
                self.by[room] = Counter()
                insort(self.rooms, room)
            self.by[room][pattern] += n

    def take(self, pattern: tuple[int, ...], n: int) -> None:
        room = self.most - sum(pattern)
        self.by[room][pattern] -= n
        if not self.by[room][pattern]:
            del self.by[room][pattern]
            if not self.by[room]:
                del self.by[room]
                self.rooms.remove(room)

    def count(self) -> int:
        return sum(n for x in self.by.values() for n in x.values())


def best_fit(lengths: dict[int, int], most: int, order: list[int] | None = None) -> Bins:
    """Each length in the fullest bins that take it, by falling length or in the order given."""
    bins = Bins(most)
    for size in sorted(lengths, reverse=True) if order is None else order:
        left = lengths[size]
        while left:
            k = bisect_right(bins.rooms, size - 1)
            if k < len(bins.rooms):
                pattern, n = next(iter(bins.by[bins.rooms[k]].items()))
                n = min(n, left)
                bins.take(pattern, n)
                bins.add((*pattern, size), n)
                left -= n
            else:
                each = min(most // size, left)
                n = left // each
                bins.add((size,) * each, n)
                left -= n * each
    return bins


def _less(pattern: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...] = ()) -> tuple[int, ...]:
    rest = list(pattern)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *into], reverse=True))


def exchange(victim: tuple[int, ...], bins: Bins) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
    """The other bin, what it gives and what it gets: what raises its fill most, the fullest bins first."""
    own, fill = Counter(victim), sum(victim)
    ones = sorted(own)
    twos = sorted({(a + b, a, b) for a in own for b in own if a < b or a == b and own[a] > 1})

    def gain(gives: tuple[int, ...], room: int) -> tuple[int, tuple, tuple]:
        """The most that what is handed over for `gives` exceeds it, if the bin has this much room besides."""
        given, best = sum(gives), (0, (), ())
        k = bisect_right(ones, given + room)
        if k:
            best = (ones[k - 1] - given, gives, (ones[k - 1],))
        if len(gives) == 1 and (k := bisect_right(twos, (given + room, bins.most, bins.most))):
            best = max(best, (twos[k - 1][0] - given, gives, twos[k - 1][1:]))
        return best

    for room in bins.rooms:
        if not room or bins.most - room < fill:
            continue
        for pattern in bins.by[room]:
            theirs = Counter(pattern)
            best = max((gain(x, room) for x in ((), *((a,) for a in theirs))), default=(0, (), ()))
            if best[0] < room:
                two = ((a, b) for a in theirs if 2 * a < ones[-1] for b in theirs if a + b < ones[-1] and (a < b or a == b and theirs[a] > 1))
                best = max(best, max((gain(x, room) for x in two), default=best))
            if best[0] > 0:
                return pattern, best[1], best[2]
    return None


def shift(victim: tuple[int, ...], bins: Bins) -> tuple[tuple[int, ...], int] | None:
    """One exchange, made by as many copies of the victim as find a partner alike: what is left of them, and how many."""
    n = bins.by[bins.most - sum(victim)][victim]
    bins.take(victim, 1)
    found = exchange(victim, bins)
    bins.add(victim, 1)
    if not found:
        return None
    pattern, gives, gets = found
    k = n // 2 if pattern == victim else min(n, bins.by[bins.most - sum(pattern)][pattern])
    bins.take(victim, k)
    bins.take(pattern, k)
    bins.add(_less(pattern, gives, gets), k)
    rest = _less(victim, gets, gives)
    if rest:
        bins.add(rest, k)
    return rest, k


def improve(bins: Bins) -> Bins:
    """Local search from the emptiest bin on, over every underfull pattern, until the bound on bins is met or nothing helps."""
    total = sum(sum(p) * n for x in bins.by.values() for p, n in x.items())
    least, count, moved = -(-total // bins.most), bins.count(), True
    while count > least and moved:
        moved, failed = False, set()
        while count > least and (victim := next((p for room in reversed(bins.rooms) if room for p in bins.by[room] if p not in failed), None)):
            while victim and (found := shift(victim, bins)):
                (victim, n), moved = found, True
                count -= 0 if victim else n
            failed.add(victim)
    return bins


class Plan:
    """For each length, the ranks at which patterns begin, and the sequence and offset that a rank takes."""

    def __init__(self, bins: Bins):
        by: dict[int, list] = {}
        taken: Counter = Counter()
        sequence = 0
        for x in bins.by.values():
            for pattern, n in x.items():
                offset = 0
                for size, each in sorted(Counter(pattern).items(), reverse=True):
                    by.setdefault(size, []).append((taken[size], each, sequence, offset))
                    taken[size] += each * n
                    offset += size * each
                sequence += n
        self.sequences = sequence
        self.by = {size: np.array(rows, np.int64).T for size, rows in by.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            own = np.flatnonzero(length == size)
            first, each, base, start = self.by[size]
            k = np.searchsorted(first, rank[own], side="right") - 1
            r = rank[own] - first[k]
            sequence[own] = base[k] + r // each[k]
            offset[own] = start[k] + r % each[k] * size
        return sequence, offset


def packed(docs: DataFrame, tokenizer: str, most: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each row of docs.

    Null texts are empty ones: their end is packed. Ids may be null or repeat; each row is packed.
    What reaches the driver is the histogram of at most `most` lengths. An empty table packs to none.
    """
    rows = c.stored(pieces(docs, tokenizer, most, end_id, id_col, text_col))
    lengths = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    handed = docs.sparkSession.sparkContext.broadcast(Plan(improve(best_fit(lengths, most))))
    buckets = max(1, -(-max(lengths.values(), default=1) // BUCKET))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "bucket").count().select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).select("id", "piece", "start", "length", "crc", (F.col("r") + F.col("before")).cast("long").alias("rank"))

    def go(batches):
        for batch in batches:
            sequence, offset = handed.value.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "crc", "sequence_id", "offset"])

    out = ranked.mapInArrow(go, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
    return out.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
