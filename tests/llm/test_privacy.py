"""Personal data: base spans against the patterns as they stand, disclosure against counts in dictionaries."""

import hashlib
import math
import random
import re
import sys
import time

from quillon.llm import privacy as P

sys.set_int_max_str_digits(0)
SCHEMA = "doc_id long, text string, base string, n_email string, key string"  # clash with names used inside
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, s):
    digits = [int(x) for x in s if x in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(d * 2, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if right(k, m.group())]


def said(spans):
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def card(r):
    digits = [r.randrange(10) for _ in range(r.randint(12, 18))]
    return "".join(map(str, digits)) + next(str(d) for d in range(10) if right("card", "".join(map(str, digits)) + str(d)) or len(digits) > 18)


def texts(n=150):
    r = random.Random(8)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@@b.cd", "u@v", "q@r..s", "a@b.c+d@e.f", "é@é.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "1.2.3", "+1 (234) 555-0199", "+44 20 7946 0958", "+1 23", "+123456789012345678", "4111 1111 1111 1111", "4111-1111-1111-1112", "4242424242424242", "12 34", "0", ". ", "-", "ü", "слово", "word", "\n", "++1(2)3 4 5 6 7 8 9.", "+"]
    out = ["".join(r.choice((r.choice(bits), card(r), " ", ", ", r.choice("0123456789.@+- ()"))) for _ in range(r.randint(0, 25))) for _ in range(n)]
    return [*out, None, "", " \t\n", "0" * 5000 + ".1.1.1", "9" * 6000, "1 " * 3000]


def test_base_spans(spark):
    rows = [(k, t, "x", "y", "z") for k, t in enumerate(texts())]
    rows += [rows[3], (None, "null id a@b.cd", None, None, None)]
    got = P.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), said(brute(t))) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), re.sub(r"(^|,)term:.*", "", r["spans"])) for r in got) == want
    for r in got:
        base = re.sub(r"(^|,)term:.*", "", r["spans"])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k) for x in base.split(",")) for k in PLAIN]


def test_long_runs_are_linear():
    began = time.time()
    for t in ("a" * 2_000_000, "a" * 1_000_000 + "@", "1." * 1_000_000, "1" * 2_000_000, "1 " * 1_000_000, "+1" + "(" * 1_000_000, "a@" * 500_000, "+" * 1_000_000):
        P.base_spans(t.encode())
    assert time.time() - began < 20


def made():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs = [f"{say(20)} Qwertz writes to jo.doe@mail.example.com {say(20)}" for _ in range(5)]  # qwertz stands near the address, and once elsewhere
    docs += [f"{say(30)} common {say(3)} ann@mail.example.com {say(30)}" for _ in range(5)] + [f"{say(5)} common {say(5)}" for _ in range(60)]
    one = f"{say(20)} copied zebra to copy@mail.example.com {say(20)}"
    docs += [one] * 6  # copies support nothing
    near = f"{say(30)} yonder sits near@mail.example.com {say(30)}".split()
    for k in range(8):
        docs.append(" ".join([*near[: 27 + k % 3], r.choice(vocab), *near[28 + k % 3 :]]))  # near copies neither
    docs += [f"{say(4)} writes {say(4)}" for _ in range(20)]
    return docs + [say(40) for _ in range(300)] + ["Grüße, é Qwertz", None, ""]


def test_terms_that_disclose(spark):
    docs = made()
    table = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(docs)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["spans"] for r in P.report(table).collect()}
    for k, t in enumerate(docs):
        want = said(brute(t))
        at = (t or "").find("Qwertz")
        if at >= 0:
            want = ",".join(x for x in (want, f"term:{at}:{at + 6}") if x)
        assert got[k] == want, (k, t)
    clean = [r["text"] for r in P.sanitised(table).select("doc_id", "text").orderBy("doc_id").collect()]
    assert clean[0] == docs[0].replace("Qwertz", "[TERM]").replace("jo.doe@mail.example.com", "[EMAIL]") and clean[-3:] == ["Grüße, é [TERM]", None, ""]
    assert clean[20] == docs[20]


def test_disclosure_by_counts(spark):
    docs = made()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda x: "".join(chr(ord(y) + 32) if "A" <= y <= "Z" else y for y in x)
    both = around = places = total = 0
    for t in docs:
        words = [(*m.span(), m.group()) for m in word.finditer(fold(t or ""))]
        total += len(words)
        places += sum(w[2] == "qwertz" for w in words)
        spans = [s for s in brute(t)]
        out = [w for w in words if not any(w[0] < j and w[1] > i for _, i, j in spans)]
        for _, i, j in spans:
            if t[i:j] == "jo.doe@mail.example.com":
                n = sum(w[1] <= i for w in out)
                near = out[max(0, n - P.WINDOW) : n + P.WINDOW]
                around, both = around + len(near), both + sum(w[2] == "qwertz" for w in near)
    want = math.log(both * total / (around * places)) / math.log(total / around)
    table = spark.createDataFrame([(t,) for t in docs], "text string")
    got = P.disclosing(table, generalise=0.9).collect()
    assert len(got) == 1 and abs(got[0]["disclosure"] - want) < 1e-12 and got[0]["places"] == 6 and got[0]["act"] == "generalise"


def test_empty_table(spark):
    assert P.report(spark.createDataFrame([], SCHEMA)).collect() == []
