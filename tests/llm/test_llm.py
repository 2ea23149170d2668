"""The operators against brute force and exact round trips, on small tables with hard cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, common, decontaminate, elias_fano, html_text, jaccard_join, langid, line_dedup, lm, packing, quality, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, id string"  # n and id clash with names used inside


def table(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k, "en"), "s", len(t or ""), "x", "y") for k, t in texts], SCHEMA)


def corpus(seed=5, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    out = []
    for k in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        if k % 3 == 1 and out:
            words = (out[-1][1] or "x").split()
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocab)
        out.append((k, " ".join(words)))
    long = "Große Wörter " * 30_000
    return [*out, (100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "ONE two"), (105, "one Two"), (3, out[3][1]), (3, "another text of the same id"), (106, long), (107, long + "end"), (None, "null id text here"), (None, None)]


# ---- shared


def test_word_hashes_cut_long_texts():
    text = ("word " * 700_000 + "x" * 3_000_000 + " tail").encode()
    buf = np.frombuffer(text, np.uint8)
    a, b, h = common.words(buf, common.SPACED)
    assert len(a) == 700_002 and b[-2] - a[-2] == 3_000_000 and len(set(h[:700_000].tolist())) == 1
    small = common.words(np.frombuffer(b"WORD tail ", np.uint8), common.SPACED)[2]
    assert small[0] == h[0] and small[1] == h[-1]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in parent)


# ---- n-gram Jaccard join


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard(spark, n, num, den):
    texts = corpus()
    got = jaccard_join.jaccard_classes(table(spark, texts), n, num, den).collect()

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [(k, shingles(t)) for k, t in texts]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {g: min((k for (k, s), h in zip(sets, group, strict=True) if h == g and k is not None), default=None) for g in group}
    want = Counter((k, len(s), least[g] if s else k) for (k, s), g in zip(sets, group, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_large_near_copy_group_and_empty(spark):
    r = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(400):
        w = list(base)
        w[r.randrange(80)] = f"v{k}"
        texts.append((k, " ".join(w)))
    got = jaccard_join.jaccard_classes(table(spark, texts), 3, 90, 100).collect()
    assert {r.component_id for r in got} == {0}
    assert jaccard_join.jaccard_classes(table(spark, [])).count() == 0


def test_sketch_keys_lose_no_link():
    r = np.random.default_rng(3)
    bands = jaccard_join.Bands(8, 10)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, r.integers(5, 300)).astype(np.uint64))
        cut = r.integers(0, max(1, len(a) // 9) + 1)
        b = np.unique(np.concatenate((a[cut:], r.integers(0, 1 << 63, r.integers(0, len(a) // 9 + 1)).astype(np.uint64))))
        if jaccard_join.linked(a, b, 8, 10) and not np.array_equal(a, b):
            assert np.intersect1d(jaccard_join.sketches(a, bands), jaccard_join.sketches(b, bands)).size


# ---- line dedup


def test_within_and_keys():
    r = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(4000):
        x = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        y = list(x)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randint(0, 1)] = r.choice(["", "a", "c"])
        y = "".join(y)
        for k in (1, 2, 3):
            assert line_dedup.within(x.encode(), y.encode(), k) == (distance(x, y) <= k)


def test_line_dedup(spark):
    a, b = "the quick brown fox jumps over the lazy dog tonight", "the quick brown fax jumps over the lazy dog tonight"
    texts = [(1, f"{a}\nshort\n\nown line"), (2, f"{b}\nshort line"), (3, f"  {a}\t\nshort"), (4, None), (5, ""), (6, " \n "), (7, f"{a}\nshort"), (7, f"{a}\nshort"), (8, "shorx"), (None, "only null")]
    out = [tuple(r) for r in line_dedup.deduplicated(table(spark, texts)).select("doc_id", "text", "n_chars").collect()]
    assert Counter(out) == Counter([(1, texts[0][1], len(texts[0][1])), (2, "short line", 10), (4, None, 0), (5, "", 0), (6, " \n ", 3), (8, "shorx", 5), (None, "only null", 9)])
    full = {r.doc_id: (r.n_lines, r.n_removed, r.n_near) for r in line_dedup.deduplicated(table(spark, texts), detail=True).collect()}
    assert full[2] == (2, 1, 1) and full[3] == (2, 2, 0) and full[1] == (3, 0, 0) and full[4] == (0, 0, 0)
    assert line_dedup.deduplicated(table(spark, [])).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_corpus():
    r = random.Random(12)
    letters = "abcdefgh é北"
    base = ["".join(r.choice(letters) for _ in range(r.choice([5, 19, 20, 25, 39, 40, 41, 60, 90]))).strip() or "x" for _ in range(30)]

    def bent(x):
        x = list(x)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randint(0, 1)] = r.choice(["", "é", "b"])
        return "".join(x).strip() or "y"

    texts = []
    for k in range(70):
        got = [r.choice(base) if r.random() < 0.4 else bent(r.choice(base)) if r.random() < 0.6 else f"unique line {k} {r.random()}" for _ in range(r.randint(1, 6))]
        texts.append((r.choice([k, k, k, 7, None]), "\n".join(got)))  # ids repeat and are null, with other texts
    return [*texts, (3, None), (None, None), (4, ""), (5, " \n\t"), texts[0], texts[0], (None, texts[1][1]), (8, "z" * 50_000 + "\n" + "z" * 49_999)]


@pytest.mark.parametrize("lead", [512, 5])
def test_line_dedup_against_brute_force(spark, monkeypatch, lead):
    """Of each class of lines exactly one stays, in a row of the smallest id; whatever isn't repeated stays."""
    monkeypatch.setattr(common, "LEAD", lead)
    texts = line_corpus()
    lines = sorted({x.strip() for _, t in texts for x in (t or "").split("\n") if x.strip()})
    group = list(range(len(lines)))
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            k = min(min(len(x), len(y)) // 20, 2)
            if k and abs(len(x) - len(y)) <= k and group[i] != group[j] and (len(x) > 1000 or edit_distance(x, y) <= k):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    of = dict(zip(lines, group, strict=True))
    places = {}
    for at, (k, t) in enumerate(texts):
        for x in (t or "").split("\n"):
            if x.strip():
                places.setdefault(of[x.strip()], []).append((k is not None, k or 0, at))
    out = line_dedup.deduplicated(table(spark, texts)).collect()
    kept = [(r.doc_id, of[x.strip()], x) for r in out for x in (r.text or "").split("\n") if x.strip()]
    assert Counter(g for _, g, _ in kept) == Counter(dict.fromkeys(places, 1))
    for k, g, _ in kept:
        assert (k is not None, k or 0) == min(p[:2] for p in places[g])
    blank = Counter((k, t) for k, t in texts if not (t or "").strip())
    assert Counter((r.doc_id, r.text) for r in out if not (r.text or "").strip()) == blank
    full = line_dedup.deduplicated(table(spark, texts), detail=True)
    assert full.count() == len(texts) and full.selectExpr("sum(n_lines - n_removed)").first()[0] == len(places)


def test_line_dedup_keeps_columns_of_clashing_names(spark):
    rows = [(1, "the same line of text in two rows\nmine", 5, "a", 1.0), (None, "the same line of text in two rows\nother", 6, "b", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number long, gone string, near double")
    got = {r.row_number: r for r in line_dedup.deduplicated(df).collect()}
    assert df.columns == line_dedup.deduplicated(df).columns and got[5].text == "mine" and got[6].text == rows[1][1] and (got[5].gone, got[5].near) == ("a", 1.0)


@pytest.mark.parametrize("lead", [512, 10])
def test_jaccard_groups_with_and_without_leaders(spark, monkeypatch, lead):
    """A drifting chain of near copies, whose ends share nothing, in a group with many copies close to its leader."""
    monkeypatch.setattr(common, "LEAD", lead)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    texts, w = [], list(base)
    for k in range(60):
        w[(k * 2) % 120] = f"d{k}"
        texts.append((k, " ".join(w)))
    for k in range(60, 100):
        v = list(base)
        v[r.randrange(120)] = f"v{k}"
        texts.append((k, " ".join(v)))
    texts += [(200 + k, " ".join(f"z{k}{j}" for j in range(30))) for k in range(5)]
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in texts}
    group = {k: k for k in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and group[i] != group[j] and 100 * len(a & b) >= 90 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_classes(table(spark, texts), 3, 90, 100).collect()}
    assert got == group and len(set(group.values())) >= 6


def test_one_of_each_tells_rows_apart(spark):
    w = " ".join(f"w{k}" for k in range(40))
    texts = [(5, w), (2, w + " end"), (2, "a different text under the same id, which stays"), (None, w), (None, "null id text of its own"), (None, None), (7, None), (9, w), (2, w + " end")]
    got = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(table(spark, texts)).collect())
    assert got == Counter([texts[1], texts[2], texts[4], texts[5], texts[6]])
    assert jaccard_join.one_of_each(table(spark, [])).count() == 0


# ---- decontamination


@pytest.mark.parametrize("handed", [1 << 20, 0])
def test_decontamination(spark, monkeypatch, handed):
    monkeypatch.setattr(decontaminate, "HANDED_BYTES", handed)
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([3, 9, 10, 30])))) for k in range(12)] + [(50, None), (51, "..."), (None, "alpha beta"), (3, "dup of an id")]
    texts = [(k, " ".join(r.choice(vocab) for _ in range(50)) + ". " + (r.choice(items)[1] or "") * (k % 2)) for k in range(40)] + corpus()[60:] + [(200, "ALPHA-beta"), (201, items[2][1].upper())]
    docs, bench = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = {}
    for k, t in items:
        w = rx.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else ():
            win.setdefault(tuple(w[i : i + n]), set()).add(k)
    want = Counter()
    for k, t in texts:
        w, hit, found = rx.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in win}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in win:
                    hit.update(range(i, i + n))
                    found |= win[tuple(w[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        want[(k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))] += 1
    got = Counter(tuple(x) for x in decontaminate.contamination(docs, bench).collect())
    assert got == want
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for x, n in want.items() if not x[5])
    words = [(k, rx.findall((t or "").translate(LOW))) for k, t in texts]
    matches = Counter()
    for d, w in words:
        for i, v in ((i, rx.findall((t or "").translate(LOW))) for i, t in items):
            n = min(10, len(v))
            for a in range(len(w)) if n else ():
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    if k >= n and (not a or not b or w[a - 1] != v[b - 1]):
                        matches[(d, a, k, None if i is None else str(i), b)] += 1
    assert Counter(tuple(x) for x in decontaminate.verbatim_matches(docs, bench).collect()) == matches
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_suffix_array_of_a_large_shard(monkeypatch):
    h = np.random.default_rng(1).integers(1, 50, 4000).astype(np.uint64)
    doc = np.zeros(len(h), np.int64)
    w = decontaminate.Windows(["a"], ["x"], 10)
    q = np.lib.stride_tricks.sliding_window_view(h, 10)[::97]
    w.by = {10: (np.unique(q, axis=0), np.arange(len(q) + 1), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64))}
    small = decontaminate.hits(h, doc, 1, w)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    large = decontaminate.hits(h, doc, 1, w)
    assert small[0][0] == large[0][0] >= 10 * 10


# ---- packing


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = [*corpus(), (300, "<|endoftext|> 北京 ²½ a b c"), (301, "it's 12ab—“q”  \n\n x ")]
    got = packing.packed(table(spark, texts), path).collect()
    t = Tokenizer.from_file(path)
    assert 50256 in t.encode(texts[-2][1], add_special_tokens=False).ids
    want = Counter()
    for k, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for p, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : first if not a else a + 2048]
            want[(k, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.concatenate(([0], np.cumsum([n for _, n in b])[:-1])).tolist() and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.packed(table(spark, []), path).count() == 0


def test_local_search_empties_bins():
    bins = packing.Bins(10)
    for p in ((6,), (6,), (4, 3), (4, 3), (2, 2, 2)):
        bins.add(p, 1)
    before = Counter(x for b in bins.by.values() for p, n in b.items() for x in p * n)
    packing.improve(bins)
    after = Counter(x for b in bins.by.values() for p, n in b.items() for x in p * n)
    assert before == after and bins.count() == 4


@pytest.mark.parametrize("copies", [1, 64, 5000])
def test_local_search_goes_on_past_copies_that_fail(copies):
    bins = packing.Bins(2048)
    bins.add((1030,), 300 * copies)  # emptiest: no two share a bin
    for p in ((1032, 400), (1040, 404), (1100, 500)):
        bins.add(p, copies)
    bins.add((700, 600, 300), copies)
    bins.add((1400, 200), copies)
    before = Counter()
    for b in bins.by.values():
        for p, n in b.items():
            before.update({x: c * n for x, c in Counter(p).items()})
    first = bins.count()
    packing.improve(bins)
    after = Counter()
    for b in bins.by.values():
        for p, n in b.items():
            after.update({x: c * n for x, c in Counter(p).items()})
            assert sum(p) <= 2048
    assert before == after and bins.count() <= first - copies


def test_local_search_alone_comes_near_the_bound():
    """From best fit in no order, the search takes away most of the sequences above the bound."""
    r = random.Random(5)
    lengths = Counter(min(2048, int(r.lognormvariate(5.6, 1.1)) + 1) for _ in range(4000))
    least = -(-sum(k * n for k, n in lengths.items()) // 2048)
    order = sorted(lengths, key=lambda x: zlib.crc32(str(x).encode()))
    bins = packing.best_fit(lengths, 2048, order)
    first, before = bins.count(), sum(sum(p) ** 2 * n for x in bins.by.values() for p, n in x.items())
    packing.improve(bins)
    held = Counter()
    for x in bins.by.values():
        for p, n in x.items():
            held.update({size: c * n for size, c in Counter(p).items()})
            assert sum(p) <= 2048
    assert held == lengths and sum(sum(p) ** 2 * n for x in bins.by.values() for p, n in x.items()) > before
    assert bins.count() - least <= (first - least) // 2
    assert packing.improve(packing.best_fit(lengths, 2048)).count() <= least + 1


# ---- language model


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 10**6), (1000, 1000), (5000, 2**50)):
        v = np.unique(r.integers(0, u, 2 * n))[:n] if u > n else np.arange(n)
        a, f = elias_fano.EliasFano.build(v, u)
        e = elias_fano.EliasFano(a["low"], a["high"], a["zeros"], f["bits"], f["n"])
        assert (e.access(np.arange(len(v))).astype(np.int64) == v).all() and (e.all().astype(np.int64) == v).all()
        q = np.concatenate((v, r.integers(0, u, 500)))
        place = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, order):
    texts = corpus()
    got = {(r.doc_id, round(r.base_score, 6)): r for r in lm.lm_scores(table(spark, texts), order=order).collect()}
    tokens = [(k, [*(t or "").translate(LOW).encode().split(), None]) for k, t in texts]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    train = [w for k, w in tokens if not held(k)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    for k, w in tokens:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        r = got[(k, round(base, 6))]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(w), sum(c[x] > 0 for x in w), n)
    seen = [r for r in got.values() if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert lm.lm_scores(table(spark, [])).count() == 0
    nothing = lm.scored(table(spark, texts[:2]), lm.train(table(spark, []).select("text"))).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in nothing)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_against_brute_force(spark, monkeypatch, order):
    """Every text's score, from counts in dictionaries; a stored probability is off by half a step of its byte at most."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 4000)
    monkeypatch.setattr(lm, "VOCABULARY_BYTES", 20_000)
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(30)]
    train = [[r.choice(vocab[: r.randint(2, 30)]) for _ in range(r.randint(0, 60))] for _ in range(120)] + [["w1"] * 400, [], ["w1", "w2"] * 300]
    model = lm.train(spark.createDataFrame([(" ".join(t),) for t in train] + [(None,)], "text string"), order)
    train.append([])
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        t = [None, *t, None]
        one.update(t[1:])
        two.update(zip(t, t[1:], strict=False))
        three.update(zip(t, t[1:], t[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def p(a, b, x, c_):
        """Of x after b, and after a and b if c_."""
        low = (one[x] + 1) / (n + v + 1)
        w = model.weight(0, np.array([one[b]]))[0]
        out = w * two[b, x] / max(1, one[b]) + (1 - w) * low
        if c_ and two[a, b]:
            w = model.weight(1, np.array([two[a, b]]))[0]
            out = w * three[a, b, x] / two[a, b] + (1 - w) * out
        return out

    texts = [*train[:20], ["w1", "unheard", "w2", "w1"], ["unheard"], [], ["w1", "w2", "w1", "w1"] * 50, [r.choice(vocab) for _ in range(300)]]
    got = lm.scored(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for row in got:
        t = [None, *texts[row.doc_id], None]
        want = sum(math.log10(p(t[k - 2] if k > 1 else None, t[k - 1], t[k], order > 2 and k > 1)) for k in range(1, len(t)))
        assert abs(row.score - want) <= 0.012 * (len(t) - 1), row.doc_id
    h = {w: next(iter(lm.streams(pa.array([w]))))[2][0] for w in [*vocab, "unheard"]} | {"": lm.END}
    total = 0.0  # over what may follow two words
    for x in h.values():
        t = np.array([h["w1"], h["w2"], x])
        total += 10 ** (model.score(np.array([3]), t)[2][0] - model.score(np.array([2]), t[:2])[2][0])
    assert total == pytest.approx(1, abs=0.02)


def test_trie_pointers_delimit_the_children(spark):
    model = lm.train(spark.createDataFrame([("a b a b c",), ("a b a c c a b",), ("c a b",)], "text string"))
    found = 0
    for k in range(model.shards):
        s = model.shard(k)
        if s.arrays:
            place, three = np.arange(s.facts["2"]["n"]), s.level("3")
            first, end = three.bucket(place)
            t = three.access(np.arange(three.n)).astype(np.int64)
            for i, a, b in zip(place, first, end, strict=True):
                assert (t[a:b] >> three.bits == i).all()
                found += b - a
                assert s.child(np.full(b - a, i), t[a:b] & ((1 << three.bits) - 1)).tolist() == list(range(a, b))
            assert end[-1] == len(t)
    assert found


# ---- WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://a/é", "<p>ü</p>", 1), (1, "http://b\r\nX: y", "<p>ü</p>", 1), (2, None, None, 1), (5, "u", "", 1), (4, "u", "big" * 1_000_000, 1), (1, "again", "<p>ü</p>", 1), (None, "n", "<p>ü</p>", 1), (None, "n", "lonely", 1)]
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, d int")).collect())
    first = {}
    for k, _, h, _ in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    want = Counter()
    for k, _, h, _ in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        alone = sum((x[2] or "") == (h or "") for x in rows) == 1
        again = not alone and f is not None and k != f
        want[(k, len(b), warc.digest(b), "revisit" if again else "response", f if again else None)] += 1
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_salvage():
    raw = [warc.record(k, f"http://x/{k}", warc.digest(b"p%d" % k), 2, b"p%d" % k) for k in range(6)]
    data = b"".join(warc.member(r) + b"\0" for r in raw)
    starts = [r.offset for r in warc.Salvage(data)]
    assert len(starts) == 6
    bad = bytearray(data)
    bad[starts[2] + 40] ^= 0xFF  # in the third member
    bad = bytes(bad[: len(bad) - 60])  # and the last one cut short
    s = warc.Salvage(bad)
    assert [warc.key_of(r.headers["warc-record-id"]) for r in s] == [0, 1, 3, 4]
    assert [(g.offset, g.length) for g in s.gaps] == [(starts[2], starts[3] - starts[2]), (starts[5], len(bad) - starts[5])]
    plain = b"junk" + raw[0] + raw[1].replace(b"p1", b"q1", 1) + raw[2]
    s = warc.Salvage(plain)
    assert [warc.key_of(r.headers["warc-record-id"]) for r in s] == [0, 2] and [g.reason for g in s.gaps] == ["no version line", "block digest differs"]


def records(n=6):
    out = []
    for k in range(n):
        p = f"payload {k} ".encode() * 5
        out.append(warc.record(k, f"http://x/{k}", warc.digest(p), len(p), p))
    return out


def keys(found):
    return [warc.key_of(r.headers["warc-record-id"]) for r in found]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_within_a_member(level):
    """Several records in one gzip member: a bad one, or a cut, costs no other record."""
    raw = records()
    bad = [*raw]
    bad[2] = bad[2].replace(b"payload 2", b"payload 9", 1)
    data = warc.member(b"".join(bad), level) + b"\0"
    s = warc.Salvage(data)
    assert keys(s) == [0, 1, 3, 4, 5]
    assert [(g.offset, g.inner, g.length, g.reason) for g in s.gaps] == [(0, len(raw[0] + raw[1]), len(raw[2]), "block digest differs")]
    whole = warc.member(b"".join(raw), level) + b"\0"
    s = warc.Salvage(whole[:-10])
    assert keys(s)[:5] == [0, 1, 2, 3, 4] and s.gaps
    follow = warc.member(raw[0], level) + b"\0"
    assert keys(warc.Salvage(whole[: len(whole) * 3 // 4] + follow))[-1] == 0
    lying = [*raw]
    lying[1] = raw[1].replace(b"payload 1 payload 1", b"payload 1 payload", 1)  # shorter than its headers say
    assert keys(warc.Salvage(warc.member(b"".join(lying), level) + b"\0")) == [0, 2, 3, 4, 5]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("members", [1, 2, 6])
def test_salvage_with_one_flipped_byte_at_every_place(level, members):
    """No record comes twice or changed, those of other members all come, and what is lost is logged."""
    raw = records()
    parts = [warc.member(b"".join(raw[k : k + 6 // members]), level) + b"\0" for k in range(0, 6, 6 // members)]
    data, true = b"".join(parts), {r.partition(b"\r\n\r\n")[2][:-4]: k for k, r in enumerate(raw)}
    ends = np.cumsum([len(p) for p in parts])
    lost_most = 0
    for at in range(0, len(data), 1 if level else 3):
        bad = bytearray(data)
        bad[at] ^= 0x5A
        s = warc.Salvage(bytes(bad))
        got = list(s)
        found = [true[r.block] for r in got]  # headers have no check of their own
        assert found == sorted(set(found)), at
        hurt = int(np.searchsorted(ends, at, side="right"))
        assert {k for k in range(6) if k // (6 // members) != hurt} <= set(found), at
        assert len(got) == 6 or s.gaps, at
        lost_most = max(lost_most, 6 - len(got))
    assert lost_most <= 6 // members


def test_archives_hold_any_bytes(spark, tmp_path):
    r = random.Random(4)
    members = [bytes(r.randrange(256) for _ in range(r.randrange(300))) for _ in range(50)]
    warc.put_members(spark.createDataFrame([(bytearray(m),) for m in members], "r binary").coalesce(1), str(tmp_path / "a"), 1000)
    (read,) = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(str(tmp_path / "a")).collect()
    assert bytes(read.content) == b"".join(m + b"\0" for m in members)


def test_warc_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "x", 5, "a"), (2, "u", "x", 6, "b")], "page_id long, url string, html string, n long, d string")
    assert [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(df).orderBy("page_id").collect()] == [(1, "response", None), (2, "revisit", 1)]


# ---- nearest neighbours


def test_ann(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1200, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:700] = x[300]  # a large group of copies
    rows = [(k, [float(v) for v in y], 0) for k, y in enumerate(x)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 0), (2004, [1.0], 0), (None, [1.0] * 16, 0), (20, [float(v) for v in x[20]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for q in ann.nearest(df, "id % 20 = 0", k=5).collect():
        got.setdefault(q.query_id, {})[q.rank] = (q.vec_id, q.score)
    assert set(got) == set(range(0, 1200, 20))
    d, hit = x.astype(float), 0
    for q in got:
        s = (d * d[q]).sum(1)
        s[q] = -9
        best = np.lexsort((np.arange(1200), -s))[:5]
        found = [got[q][k][0] for k in range(1, 6)]
        hit += len(set(found) & set(best.tolist()))
        assert all(abs(got[q][k + 1][1] - s[v]) < 1e-12 for k, v in enumerate(found))
        if 300 <= q < 700:
            assert found == best.tolist()
    assert hit >= 0.9 * 5 * len(got)
    assert ann.nearest(df.limit(0), "id % 20 = 0").count() == 0
    assert sorted(r.vec_id for r in ann.nearest(df.where("vec_id < 3"), "id = 0", k=20).collect()) == [1, 2]


def test_ann_gives_k_rows_to_outliers(spark):
    r = np.random.default_rng(3)
    y = r.normal(size=(50, 24))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x = np.concatenate((np.repeat(y[:10], 300, 0), y[10:]))  # ten groups of copies, and lists that hold one row
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for q in ann.nearest(df, "id >= 3000 or id % 500 = 0").collect():
        got.setdefault(q.query_id, {})[q.rank] = q.vec_id
    assert set(got) == {*range(0, 3000, 500), *range(3000, 3040)}
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -9
        assert [found[k] for k in range(1, 21)] == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


def test_ann_in_many_groups_and_chunks(spark, monkeypatch):
    """Recall against brute force with small chunks and blocks, a hot vector, and clashing column names."""
    monkeypatch.setattr(ann, "CHUNK", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 24)) + 3 * r.normal(size=(40, 24))[r.integers(0, 40, 3000)]
    x[1000:1900] = x[1000]
    df = spark.createDataFrame([(k, v.tolist(), 0, 1, 2.0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, list int, v double")
    got = {}
    for q in ann.nearest(df, "id % 20 = 0").collect():
        got.setdefault(q.query_id, {})[q.rank] = (q.vec_id, q.score)
    assert set(got) == set(range(0, 3000, 20)) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len({v for v, _ in found.values()} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
        assert all(score == s[v] for v, score in found.values())
    assert hit >= 0.9 * 20 * len(got)


def test_kmeans_holds_some_rows_at_a_time():
    x = np.random.default_rng(2).normal(size=(5000, 4))
    centres = ann.kmeans(x, 2000, 1)
    assert (ann.closest(x, centres) == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)).mean() > 0.999


# ---- language and quality


def test_langid(spark):
    r = random.Random(3)
    words = {"en": "the and of to in that it with".split(), "de": "der die und nicht über für ist das".split()}
    texts = [(k, " ".join(r.choice(words["en" if k % 2 else "de"]) for _ in range(30))) for k in range(80)]
    langs = {k: ("en" if k % 2 else "de") if k % 10 else None for k, _ in texts}
    learned = langid.learn(spark.createDataFrame([(t, langs[k]) for k, t in texts], "text string, lang string"))
    hard = [(200, None), (201, ""), (202, "123 !?"), (203, "Über"), (None, "the and of")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(table(spark, texts + hard), learned).collect()}
    assert all(got[k][0] == ("en" if k % 2 else "de") for k, _ in texts)
    assert [got[k] for k in (200, 201, 202)] == [("und", 0.0)] * 3 and got[203][0] == "de" and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.learn(spark.createDataFrame([], "text string, lang string"))
    assert langid.identified(table(spark, texts[:1]), none).first().lang_pred == "und"


def test_quality(spark):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["stone", "river", "walks", "under", "a", "the", "lamp."]) for _ in range(60)).capitalize()
    bad = lambda: " ".join([r.choice(["BUY", "NOW!!", "$$$", "WIN!!"])] * 40)
    texts = [(k, good() if k % 3 else bad()) for k in range(240)] + [(500, None), (501, ""), (None, good())]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(table(spark, texts), labels).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(240)) and got[None].held_out is False
    assert all(got[k].predicted == int(k % 3 > 0) for k in range(240)) and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.predicted == int(x.score >= 0.3) for x in got.values())
    kept = quality.quality_kept(table(spark, texts), labels)
    assert {r.doc_id for r in kept.collect()} >= {k for k in range(240) if k % 3} and kept.columns == table(spark, []).columns
    assert {r.score for r in quality.quality_scores(table(spark, texts[:3]), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(table(spark, []), labels).count() == 0


def test_long_texts_and_clashing_columns(spark):
    """A text of megabytes is scored whole, and columns named like internal ones don't disturb."""
    long = "the river walks under a stone lamp. " * 60_000
    texts = [(k, "the river walks under a lamp", "en", 0.5, "x") for k in range(40)] + [(100, long, "en", 0.1, "y"), (101, long, None, 0.1, "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, score double, id string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    q = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert len(q) == 42 and q[100] == q[101] and q[0] == q[39]
    found = {r.doc_id: r.lang_pred for r in langid.identified(docs, langid.learn(docs.select("text", "lang"))).collect()}
    assert set(found.values()) == {"en"} and len(found) == 42
    assert quality.quality_kept(docs, labels).columns == docs.columns


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.ones(6), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


# ---- pages


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>Menu</nav>", ""),
        ("<html><body><nav><a>Home</a></nav><article><h1>Ti&eacute;tle</h1><p>One\n  <b>bold</b><br>two &amp; three<p>Next</article><footer>(c)</footer>", "Tiétle\n\nOne bold two & three\n\nNext"),
        ("<body><div class='sidebar'>Links and more links</div><div id=main><p>" + "Long text here. " * 20 + "</p><p>Short.</p></div><div class='comments'><p>" + "me too " * 20 + "</p></div>", ("Long text here. " * 20).strip() + "\n\nShort."),
        ("plain words only", "plain words only"),
        ("<div><b>loose</i> ends <p>and more", "loose ends\n\nand more"),
    ],
)
def test_html(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("mark", ["<![foo[..]]>", "<![ x]>", "<![if x>", "<!foo [>", "&#" + "9" * 5000 + ";"])
def test_html_goes_on_after_a_broken_declaration(mark):
    got = html_text.main_text(f"<body><p>One one one.</p>{mark}<p>Two two two.</p></body>")
    assert got.startswith("One one one.") and got.endswith("Two two two.")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>T</title><body><p>One.</p></body></html>", "One."),
        ("<head><title>T<body><p>One.", "One."),
        ("<head><title>T</title><script>x()</script><div>One.</div>", "One."),
        ("<head><title>T</title>One <b>two</b>.", "One two."),
        ("<head><img src=x><title>T</title><body><p>One.</p>", "One."),
        ("<head><noscript><div>No script</div></noscript><template><div>No</div></template><title>T</title></head><body><p>One.</p>", "One."),
    ],
)
def test_html_open_head(html, text):
    assert html_text.main_text(html) == text


LONG = " ".join(["Long text of an article, with many words in it."] * 4)
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
TEXT = f"Title\n\n{LONG}\n\nShort.\n\n{LONG}"


@pytest.mark.parametrize("name", ["post has-sidebar", "no-sidebar", "ad-free", "page-with-comments", "layout-sidebar", "noSidebar", "comments-layout", "widget post"])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_html_class_around_the_article(name, inner):
    """A class of a wrapper takes no article away; those inside it still take theirs."""
    page = f"<body><nav>Menu</nav><div class='{name}'><{inner}>{ARTICLE}</{inner}><div class='comments'><p>{LONG * 3}</p></div></div><footer>(c)</footer>"
    assert html_text.main_text(page) == TEXT
    assert html_text.main_text(f"<form class='{name}'><div class='menu'>Menu</div><{inner}>{ARTICLE}</{inner}></form>") == TEXT


STOCK = "".join(f"<div>Item {k} of the stock</div>" for k in range(30))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div>{STOCK}</div><div>{ARTICLE}</div><div>{STOCK}</div>", TEXT),  # neither landmarks nor classes
        (f"<body>{STOCK}{ARTICLE}{STOCK}", None),  # nor a container of its own
        (f"<body><table><tr><td>{STOCK}</td><td>{ARTICLE}</td></tr></table>", TEXT),
    ],
)
def test_html_threshold_chooses_the_region(page, text):
    """Ablation: without the threshold the same pages give their menus as well."""
    got, without = html_text.main_text(page), html_text.main_text(page, level=-100.0)
    assert got == text or text is None and TEXT in got and got.count("of the stock") <= 4
    assert TEXT in without and without.count("of the stock") >= 30


def test_html_links_are_no_text():
    links = "".join(f"<p><a href=x>A link to another page {k}</a></p>" for k in range(20))
    assert html_text.main_text(f"<body>{links}{ARTICLE}{links}") == TEXT


def test_html_deep_and_long_pages():
    deep = "<div>" * 30_000 + f"<p>{LONG}</p><p>{LONG}</p>" + "</div>" * 30_000
    assert html_text.main_text(f"<body>{deep}") == f"{LONG}\n\n{LONG}"
    many = "".join(f"<p>Paragraph {k}. {LONG}</p>" for k in range(3000))
    assert html_text.main_text(f"<body><nav>Menu</nav><div>{many}</div>").count("\n\n") == 2999
    assert html_text.main_text("<body><header><b>Site</b></header><article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>") == "T\n\nx"


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", "t"), (1, None, None, "t")], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_text.extracted(df).collect())) == Counter([(1, "u", "é", 1), (1, None, "", 0)])


# ---- pipeline


def test_pipeline_on_hard_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    texts = corpus()
    docs = table(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[0][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert 0 not in kept and len(kept) > 15 and kept <= {k for k, _ in texts}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0, name


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, with null and repeated ids: which rows stay, and what the last packs."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    import corpus_pipeline

    r = random.Random(21)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ra") for b in ("ten", "dor", "vis", "pel", "sum", "gar")]
    item = " ".join(r.choice(vocab) for _ in range(14))
    texts = []
    for k in range(40):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(20, 90)))
        texts.append((r.choice([k, k, 5, None]), t))
        if k % 4 == 0:
            texts.append((100 + k, t + " extra word"))  # a near copy
        if k % 7 == 0:
            texts.append((None, f"{' '.join(r.choice(vocab) for _ in range(30))} {item.upper()} end"))
    texts += [(900, None), (901, ""), (902, "one two")]
    docs = table(spark, texts)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    good = Counter((x.doc_id, x.score >= 0.3) for x in quality.quality_scores(docs, labels).collect())
    assert Counter((x.doc_id, True) for x in stages["quality"](spark, docs, sf).collect()) == Counter({k: n for k, n in good.items() if k[1]})

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    stays = []
    for g in set(group):
        stays.append(min((t for t, h in zip(texts, group, strict=True) if h == g), key=lambda t: (t[0] is None, t[0] or 0)))
    kept = stages["near_copies"](spark, docs, sf)
    assert len(stays) < len(texts) and Counter(k for k, _ in stays) == Counter(x.doc_id for x in kept.collect())

    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = rx.findall(item.translate(LOW))
    windows = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    clean = [(k, t) for k, t in texts if not any(tuple(w[i : i + 10]) in windows for w in [rx.findall((t or "").translate(LOW))] for i in range(len(w)))]
    got = stages["benchmark"](spark, docs, sf)
    assert len(clean) < len(texts) and Counter((x.doc_id, x.text) for x in got.collect()) == Counter(clean)

    encode = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter((k, 0, len(encode.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in texts)
    assert Counter((x.doc_id, x.piece, x.length) for x in stages["packing"](spark, docs, sf).collect()) == want


POST = "<div class='post'><p>Short post here.</p></div>"
SAYS = "Reader {} says that this is quite a long comment about nothing in particular, as they are."


@pytest.mark.parametrize("kind", ["<div class='comment'><p>{}</p></div>", "<article class='comment-body'><h3>R</h3><p>{}</p></article>", "<li id='comment-7'>{}</li>", "<div class='menu-open'><div class='menu'>{}</div></div>", "<div class='cookie-notice'><p>{}</p></div>"])
def test_html_comments_and_notices_are_never_text(kind):
    """However little the page says itself."""
    many = "".join(kind.format(SAYS.format(k)) for k in range(200))
    assert html_text.main_text(f"<body><nav>Menu</nav>{POST}<div>{many}</div></body>") == "Short post here."
    assert html_text.main_text(f"<body><nav>Menu</nav>{many}</body>") == ""


def test_html_without_landmarks():
    """Known articles among menus, a banner and a footer: the same text with landmarks and with plain elements."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 9))) for _ in range(n))
    right = 0
    for _ in range(60):
        blocks = [f"{say(r.randint(25, 90)).capitalize()}." for _ in range(r.randint(3, 12))]
        links = "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(r.randint(3, 12)))
        page = "<nav><ul>{}</ul></nav><main><article><h1>{}</h1>{}</article></main><aside><ul>{}</ul></aside><footer>© {}</footer>".format(links, blocks[0][:30].strip(), "".join(f"<p>{b}</p>" for b in blocks), links, say(6))
        text = "\n\n".join([blocks[0][:30].strip(), *blocks])
        assert html_text.main_text(page) == text
        right += html_text.main_text(re.sub(r"<(/?)(nav|main|article|aside|footer)", r"<\1div", page)) == text
    assert right >= 57


def test_html_is_linear():
    began = time.time()
    for page in ("<b>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</div>" * 50_000, "<p><b>" * 50_000 + "text</i>" * 50_000, POST + "".join(f"<div class='comment'><p>{SAYS}</p></div>" for _ in range(10_000))):
        html_text.main_text(f"<body>{page}</body>")
    assert time.time() - began < 40  # the square would take hours


def test_html_smoothing_and_threshold_by_hand():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        ratio = r.random(n) * 50
        weight = lambda a, b: math.exp(-((a - b) ** 2) / (2 * html_text.SIGMA**2)) if abs(a - b) <= 3 else 0.0
        want = [sum(weight(i, j) * ratio[j] for j in range(n)) / sum(weight(i, j) for j in range(n)) for i in range(n)]
        assert np.allclose(html_text.smoothed(ratio), want)


def test_html_empty_table_and_repeats(spark):
    kind = "page_id long, url string, html string, text string"
    assert html_text.extracted(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(r) for r in html_text.extracted(spark.createDataFrame([(1, "u", "<p>é</p>", "t")] * 2, kind)).collect()] == [(1, "u", "é", 1)] * 2


def test_warc_long_addresses(spark):
    """Headers have no length of their own: a row for each page, whatever its address."""
    rows = [(1, "http://x/" + "a" * 4_000_000, "<p>1</p>"), (2, "b\x00\x01\x7f\r\n\r\nc", "<p>2</p>"), (3, "u", "<p>1</p>")]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("response", None, 8), 2: ("response", None, 8), 3: ("revisit", 1, 8)}


def test_ann_finds_the_nearest_among_near_copies(spark):
    """Groups larger than what used to be reranked, whose rows share their codes."""
    from quillon.llm.ann import nearest

    r = np.random.default_rng(5)
    x = r.normal(size=(4, 16))[r.integers(0, 4, 2400)] + 1e-4 * r.normal(size=(2400, 16))
    got = nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), "id % 20 = 0").toPandas()
    found = got.groupby("query_id")["vec_id"].apply(set)
    s = x[::20] @ x.T
    s[np.arange(len(s)), np.arange(0, 2400, 20)] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    assert len(got) == 2400 and np.mean([len(found[20 * k] & set(b)) / 20 for k, b in enumerate(best)]) >= 0.95
