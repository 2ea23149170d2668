"""Personal data: patterns, and terms of the corpus that reveal what the patterns protect.

Emails, IP addresses, card and phone numbers are found by patterns. A value found is a protected
entity e, and information theory says how strongly a term t discloses it: with shares of the
corpus' word places, PMI(e; t) = log p(e, t) / (p(e) p(t)), where p(e, t) counts places of t within
a window around e. PMI reaches IC(e) = -log p(e) if t stands nowhere else. Their ratio is the
disclosure of t: 1 if t gives e away, 0 if it says nothing. Terms at or above a threshold are
generalised, those that reach the upper one removed, wherever they stand.

Such estimates need support: windows that differ. Copies of a document repeat a window, near copies
repeat most of it. A pair counts if it has several distinct windows whose sketches vary: the least
hashes of a window's pairs of words, in a few bins, are mostly other ones in each window.

The corpus is read as bytes: patterns only hold ASCII, words are hashed in slices. Candidate terms
come from windows, their places in the whole corpus are counted behind a bit array of bounded size,
and places found again are joined to the terms: no table of all words is made, and no text shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: The kinds in their order, and their patterns. Quantifiers that give nothing back match the same, without retries on long runs.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
TERM = "term"
#: Words on either side of an entity that make its window, and the least length of a term in bytes.
WINDOW, LEAST = 8, 3
#: Distinct windows that a pair needs.
SUPPORT = 3
#: Bins of a window's sketch, and distinct values a window and bin that the windows of a pair need.
BINS, VARIED = 4, 0.6
#: Disclosure from which on a term is generalised, and removed.
GENERALISE, REMOVE = 0.95, 0.99
_NOT_DIGIT = bytes(k for k in range(256) if not 48 <= k <= 57)
_LOCAL_SET = np.zeros(256, bool)
_LOCAL_SET[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True

Span = tuple[str, int, int]


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each @ outward: linear, whatever runs of letters a text has."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_SET[text[start - 1]]:
            start -= 1
        hit = DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            yield start, hit.end()
            done = hit.end()
        at = text.find(b"@", max(at + 1, done))


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> list[Span]:
    """(kind, start, end) in bytes, kinds as listed. A match that fails its check is dropped with all that it covers."""
    out: list[Span] = []
    if b"@" in text:
        out += [("email", i, j) for i, j in emails(text)]
    if text.count(b".") >= 3:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m.group().split(b"."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m.group().translate(None, _NOT_DIGIT)) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if b"+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(m.group().translate(None, _NOT_DIGIT)) <= 15]
    return out


def _points(text: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte place."""
    out, at, n = {}, 0, 0
    for p in sorted(set(places)):
        n += p - at - int(np.count_nonzero((np.frombuffer(text, np.uint8, p - at, at) & 0xC0) == 0x80)) if p > at else 0
        out[p], at = n, p
    return out


def _inside(starts: np.ndarray, ends: np.ndarray, spans: list[Span]) -> np.ndarray:
    """Which words overlap a span."""
    out = np.zeros(len(starts), bool)
    for _, i, j in spans:
        out[np.searchsorted(ends, i, side="right") : np.searchsorted(starts, j)] = True
    return out


def _entity(kind: str, value: bytes) -> int:
    """Identity of what a span protects: letters of an email in lower case, else digits (of an address, numbers)."""
    plain = value.lower() if kind == "email" else b".".join(p.lstrip(b"0") for p in value.split(b".")) if kind == "ip" else value.translate(None, _NOT_DIGIT)
    return int.from_bytes(hashlib.blake2b(kind.encode() + b":" + plain, digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    column = batch["text"].cast(pa.large_binary())
    for x in column:
        yield x.as_py() or b""


def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the spans of each text in code points, their counts, and the text's key."""
    for batch in batches:
        keys, counts, spans = [], [], []
        for text in _texts(batch):
            got = base_spans(text)
            point = _points(text, [p for s in got for p in s[1:]])
            keys.append(hashlib.md5(text, usedforsecurity=False).digest())
            counts.append([sum(s[0] == k for s in got) for k in KINDS])
            spans.append(",".join(f"{k}:{point[i]}:{point[j]}" for k, i, j in got))
        more = [pa.array([x[n] for x in counts], pa.int64()) for n in range(len(KINDS))]
        yield pa.record_batch([*(batch[k] for k in batch.schema.names if k != "text"), pa.array(keys, pa.binary()), *more, pa.array(spans, pa.string())], names=[*(k for k in batch.schema.names if k != "text"), "text_key", *(f"n_{k}" for k in KINDS), "base"])


def windows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, term, window, s0 and so on, places): terms near each entity of each text, with hash and sketch of their window; term 0 has the places of all words near it."""
    for batch in batches:
        rows: list[tuple[int, ...]] = []
        for text in _texts(batch):
            got = base_spans(text)
            if not got:
                continue
            starts, ends, hashes = c.words(np.frombuffer(text + b"\n", np.uint8), c.ALNUM)
            own = _inside(starts, ends, got)
            starts, ends, hashes = starts[~own], ends[~own], hashes[~own]
            near: dict[int, dict[int, tuple[int, ...]]] = {}  # entity: word's place: its window
            for kind, i, j in got:
                low, high = int(np.searchsorted(ends, i, side="right")), int(np.searchsorted(starts, j))
                around = np.arange(max(0, low - WINDOW), min(len(starts), high + WINDOW))
                places = near.setdefault(_entity(kind, text[i:j]), {})
                if len(around):
                    window = _window(hashes[around])
                    for k in around.tolist():
                        places.setdefault(k, window)
            for entity, places in near.items():
                rows.append((entity, 0, 0, *[0] * BINS, len(places)))
                rows += [(entity, int(hashes[k]), *window, 1) for k, window in places.items() if ends[k] - starts[k] >= LEAST]
        if rows:
            hashed = [np.array([r[n] for r in rows], np.uint64).view(np.int64) for n in range(1, 3 + BINS)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), *(pa.array(x) for x in hashed), pa.array([r[-1] for r in rows], pa.int64())], names=["entity", "term", "window", *SKETCH, "places"])


SKETCH = [f"s{k}" for k in range(BINS)]


def _window(h: np.ndarray) -> tuple[int, ...]:
    """Hash of a window's words in order, and the least hash of its pairs of words in each bin (of all where a bin is empty)."""
    pairs = c.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
    bins = pairs % np.uint64(BINS)
    least = [int((pairs[bins == k] if (bins == k).any() else pairs).min()) for k in range(BINS)]
    return int(np.bitwise_xor.reduce(c.mix(h + np.arange(len(h), dtype=np.uint64)))), *least


def _let_through(bits: c.Bitmap, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64((1 << bits.bits) - 1)
    return (bits.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def disclosing(documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame | None:
    """(term, disclosure, places, act) of the terms that reveal a protected entity of documents(text); None if no pair has the support."""
    words = documents.select("text")
    near = words.mapInArrow(windows_in, f"entity long, term long, window long, {' long, '.join(SKETCH)} long, places long")
    near = c.stored(near.groupBy("entity", "term", "window").agg(F.sum("places").alias("places"), *(F.min(x).alias(x) for x in SKETCH)))
    varied = sum(F.approx_count_distinct(x) for x in SKETCH)  # registers are merged; small counts are exact
    pairs = near.where("term <> 0").groupBy("entity", "term").agg(F.count("*").alias("windows"), F.sum("places").alias("both"), varied.alias("varied"))
    pairs = c.stored(pairs.where((F.col("windows") >= support) & (F.col("varied") >= VARIED * BINS * F.col("windows"))).select("entity", "term", "both"))
    terms = c.stored(pairs.groupBy("term").agg(F.count("*").alias("entities")))
    n = terms.count()
    if not n:
        return None
    bits = c.Bitmap(terms.select(F.col("term").alias("id")), n)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, buf, _ in c.slices(batch["text"]):
                hashes = c.words(buf, c.ALNUM)[2]
                own, times = np.unique(hashes[_let_through(bits, hashes)], return_counts=True)
                yield pa.record_batch([pa.array([0, *own.view(np.int64).tolist()], pa.int64()), pa.array([len(hashes), *times.tolist()], pa.int64())], names=["term", "places"])

    places = c.stored(words.mapInArrow(counted, "term long, places long").groupBy("term").agg(F.sum("places").alias("places")))
    total = places.where("term = 0").first()["places"]
    sizes = near.where("term = 0").groupBy("entity").agg(F.sum("places").alias("around"))
    scored = pairs.join(sizes, "entity").join(places.where("term <> 0"), "term")
    pmi = F.log(F.col("both") * F.lit(float(total)) / (F.col("around") * F.col("places")))
    scored = scored.withColumn("disclosure", pmi / F.log(F.lit(float(total)) / F.col("around"))).where(F.col("disclosure") >= generalise)
    scored = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.first("places").alias("places"))
    return c.stored(scored.withColumn("act", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")))


def term_places(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, spans): where the terms(term, places, act) stand in each distinct text of documents(text), but within other spans: array of (start, end, act), code points."""
    bits = c.Bitmap(terms.select(F.col("term").alias("id")), terms.count())

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hits, at, to = [], [], [], []
            for text in _texts(batch):
                starts, ends, hashes = c.words(np.frombuffer(text + b"\n", np.uint8), c.ALNUM)
                own = np.flatnonzero(_let_through(bits, hashes))
                if not len(own):
                    continue
                own = own[~_inside(starts[own], ends[own], base_spans(text))]
                point = _points(text, [*starts[own].tolist(), *ends[own].tolist()])
                keys += [hashlib.md5(text, usedforsecurity=False).digest()] * len(own)
                hits += hashes[own].view(np.int64).tolist()
                at += [point[p] for p in starts[own].tolist()]
                to += [point[p] for p in ends[own].tolist()]
            if keys:
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(hits, pa.int64()), pa.array(at, pa.int64()), pa.array(to, pa.int64())], names=["text_key", "term", "start", "end"])

    spots = c.stored(documents.select("text").mapInArrow(spotted, "text_key binary, term long, start long, end long").distinct())
    hit = c.spread_join(spots, terms.select("term", "places", "act"), "term", "places", spots.count(), ["text_key", "start"])
    return c.stored(hit.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "act"))).alias("spans")))


def personal_data(documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """documents' columns but text, with text_key, n_email, n_ip, n_card, n_phone, base (spans `kind:start:end`, by kind and place) and terms: an array of (start, end, act).

    Places are code points, ends exclusive. A null text is an empty one and has no spans. Rows that
    repeat are answered alike, and copies of a text support nothing more than one does. Terms are in no
    span of the patterns. Very long texts are read whole. An empty table gives no row. Columns of the
    names given here are replaced.
    """
    new = ["text_key", *(f"n_{k}" for k in KINDS), "base", "terms"]
    keep = [x for x in documents.columns if x.lower() not in new]
    documents = documents.select(*keep)
    others = [f for f in documents.schema.fields if f.name != "text"]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text_key binary", *(f"n_{k} long" for k in KINDS), "base string"])
    found = documents.mapInArrow(found_in, kind)
    found = c.stored(found)
    terms = disclosing(documents, support, generalise, remove)
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,act:string>>")
    if terms is None or terms.isEmpty():
        return found.withColumn("terms", none)
    places = term_places(documents, terms)
    copies = found.groupBy(F.col("text_key").alias("key")).agg(F.count("*").alias("rows"))
    places = c.stored(places.join(copies, F.col("text_key") == F.col("key")).select(F.hex("text_key").alias("key_hex"), "rows", F.col("spans").alias("terms")))
    total = found.count()
    out = c.spread_join(found.withColumn("key_hex", F.hex("text_key")), places, "key_hex", "rows", total, [others[0].name] if others else ["base"], how="left")
    return out.drop("key_hex")


def sanitised(documents: DataFrame, **options: float) -> DataFrame:
    """documents with texts in which personal data is replaced by its kind, as `[EMAIL]`, and terms that disclose it are generalised to `[TERM]` or removed. Where spans overlap, the first one, and of two that begin alike the longer, is taken."""
    row = c.fresh(documents, "row_number")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    numbered = c.stored(numbered)
    said = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["act"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    marks = personal_data(numbered.select(row, "text"), **options).select(F.col(row).alias("_row"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), said).alias("_marks")).where("_marks <> ''")
    both = numbered.join(marks, F.col(row) == F.col("_row"), "left")

    @F.pandas_udf("string")
    def clean(text: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t and _replaced(t, m or "") for t, m in zip(text, marks, strict=True)], dtype=object)

    return both.withColumn("text", clean("text", "_marks")).select(*documents.columns)


def _replaced(text: str, marks: str) -> str:
    put = {"remove": "", "generalise": "[TERM]"}
    spans = sorted((int(i), -int(j), put.get(k, f"[{k.upper()}]")) for k, i, j in (x.split(":") for x in marks.split(",") if x))
    parts, at = [], 0
    for i, j, by in spans:
        if i >= at:
            parts += [text[at:i], by]
            at = -j
    return "".join([*parts, text[at:]])


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): base spans as a digest, and all spans with the terms' last."""
    found = personal_data(documents.select("doc_id", "text"))
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit(TERM), x["start"].cast("string"), x["end"].cast("string")))
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(terms, ","))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
