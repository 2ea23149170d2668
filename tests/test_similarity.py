"""Similarity of texts: no pair is worked out twice, and no trigrams either."""

from quillon.operators import history


def test_texts_alike_in_all_but_space_stand_as_one(spark, monkeypatch):
    scored, own = [], history.mutual_best
    monkeypatch.setattr(history, "mutual_best", lambda df: scored.append(df.count()) or own(df))
    words = "one two three four five six seven eight".split()
    spaced = lambda k: "".join(w + " " * (1 + (k >> i) % 2) for i, w in enumerate(words))
    df = lambda x: spark.createDataFrame(list(x.items()), "key long, text string")
    old = {k: spaced(k) for k in range(60)} | {500: "a b c d e f g h i j k", 501: "x y", 502: "p q", 503: "p  q"}
    new = {1000 + k: spaced(60 + k) for k in range(60)} | {1500: "a b c d e f g h i j l", 1501: "x  y", 1502: "p   q", 1503: "Q R"}
    assert {tuple(r) for r in history.renames(df(old), df(new)).collect()} == {(500, 1500, 88), (501, 1501, 100)}
    assert scored == [4]  # not 3600 and more


def test_trigrams_of_a_text_are_worked_out_once(spark):
    df = lambda x: spark.createDataFrame(x, "key long, text string")
    plan = history.similar(df([(1, "a b c d")]), df([(2, "b c d")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4  # each side once for its trigrams, once for texts of none
