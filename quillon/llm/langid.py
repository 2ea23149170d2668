"""Language identification by rank order of character n-grams.

A profile is a language's `size` most frequent n-grams of one to three characters, in order. A
document's own profile is held against each: an n-gram costs the difference of its two ranks, or
`size` where the language lacks it, and the least sum wins. Letters are lower-cased; everything
else counts as one space, which marks word ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 300
#: Profiles are learned from about this many labelled rows at most, chosen by a hash of the text.
FIT_ROWS = 60_000
_LETTER: list[np.ndarray] = []
_U = np.uint64


def letters(text: str) -> np.ndarray:
    """Lower-cased code points, runs of anything but letters as one 0, a 0 at both ends; empty without a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[0][p]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    p = np.where(is_letter, p, 0).astype(np.uint64)
    keep = np.ones(len(p), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    p = p[keep]
    return np.concatenate((np.zeros(int(p[0] != 0), np.uint64), p, np.zeros(int(p[-1] != 0), np.uint64)))


def grams(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, 21 bits a character, and their counts."""
    two = p[:-1] << _U(21) | p[1:]
    three = two[:-1] << _U(21) | p[2:]
    return np.unique(np.concatenate((p[p != 0], two, three)), return_counts=True)


def ranked(text: str, size: int) -> np.ndarray:
    """A text's most frequent n-grams in order; ties by code."""
    p = letters(text)
    if not len(p):
        return p
    g, n = grams(p)
    return g[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.names = size, sorted({r[0] for r in rows})
        index = {x: i for i, x in enumerate(self.names)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64).astype(np.uint64))
        self.rank = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for lang, g, r in rows:
            self.rank[index[lang], np.searchsorted(self.grams, _U(g))] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text or "", self.size)
        if not len(own) or not self.names:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != own] = len(self.grams)
        r = self.rank[:, at]
        apart = np.where(r < 0, self.size, np.abs(r - np.arange(len(own)))).sum(1)
        best = int(apart.argmin())
        others = np.delete(apart, best)
        worst = others.min() if len(others) else self.size * len(own)
        return self.names[best], float((worst - apart[best]) / worst) if worst else 0.0


def learn(rows: DataFrame, size: int = SIZE, fit_rows: int = FIT_ROWS) -> Profiles:
    """rows(text, lang): null languages and texts teach nothing. Counts are summed where the rows are, then by key."""
    rows = rows.where("text is not null and lang is not null")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1e6 * fit_rows / total))

    def count(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                p = letters(text)
                if len(p):
                    held.setdefault(lang, []).append(grams(p))
            for lang, parts in held.items():
                g, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x for _, x in parts])).astype(np.int64)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "g", "n"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g")) - 1).where(F.col("r") < size)
    return Profiles([(r[0], r[1], r[2]) for r in top.select("lang", "g", "r").collect()], size)


def identified(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of each row; `und` and 0 for null, for no letter, and if nothing was learned.

    The score is the margin of the best language over the next, 0 to 1. Of languages at equal
    distance the first by name wins. Rows stand alone: repeats and equal ids get the same answer.
    """
    handed = docs.sparkSession.sparkContext.broadcast(profiles)

    def go(batches):
        for batch in batches:
            got = [handed.value.predict(t) for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["id"], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(go, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
