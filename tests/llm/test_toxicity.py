import random
import zlib

import pytest

from tidelog.llm import toxicity as X

BAD = ["idiot", "moron", "stupid", "worthless"]


def data(n=900, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    rows = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(3):
                t[rnd.randrange(len(t))] = rnd.choice(BAD)
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_decoding():
    import numpy as np

    even = np.full((X._EDGE + 1, X._EDGE + 1), 3.0)
    assert "idiot" in X.readings("1d10t", even) and "stupid" in X.readings("$tup1d!!", even)
    assert "moron" in X.readings("m.o.r.o.n", even) and "stupid" in X.readings("stuuuupid", even)
    assert X.readings("Hello,", even) == ["hello"] and X.readings("", even) == [] and X.readings("***", even) == []
    # the cheapest path by trying all: each character's readings, or a skip
    rnd = np.random.default_rng(1)
    model = rnd.random((X._EDGE + 1, X._EDGE + 1)) * 5

    def every(word, i, last, cost, text):
        if i == len(word):
            yield cost + model[last, X._EDGE], text
            return
        c = word[i]
        for x, extra in [(c, 0.0)] if c in X._INDEX else [(x, X.SUBSTITUTE) for x in X.READINGS.get(c, "")]:
            yield from every(word, i + 1, X._INDEX[x], cost + extra + model[last, X._INDEX[x]], text + x)
        if c in X.SEPARATORS or i and c == word[i - 1]:
            yield from every(word, i + 1, last, cost + X.SKIP, text)

    for word in ("1d11t", "a.b-1", "aa1||b", "s0000n"):
        want = sorted(every(word, 0, X._EDGE, 0.0, ""))[0]
        got = X.decode(word, model)[0]
        assert got[0] == pytest.approx(want[0])


def test_held_out_accuracy_and_disguises(spark):
    rows = data()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, "er on 1d10t an m-o-r-o-n he s t u p i d in"), (9002, None), (9003, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    for i, _, x in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == x == int(got[i].score >= 0.7)
    assert got[9001].predicted == 1 and got[9002].score == got[9003].score < 0.7
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 0, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in X.score(docs, X.fit(docs, flipped)).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "x"), (1, "x")], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as words")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in X.score(docs, X.fit(docs, none)).collect()] == [0, 0, 0]
    assert X.score(docs.limit(0), X.fit(docs.limit(0), none)).collect() == []


def test_disguises_of_any_length(spark):
    rows = data()
    rnd = random.Random(8)
    clean = " ".join(t for _, t, x in rows[:40] if not x).split(" ")
    spelled = lambda words: " ".join("".join(words))
    long = [rnd.choice(clean) for _ in range(60)]
    toxic = [
        "er on an a s t u p i d in", "he i d i o t m o r o n th", "er " + spelled([*long[:30], "stupid", *long[30:], "moron", *long]),
        "on stu" + "u" * 90 + "pid an mo" + "r" * 70 + "on", "th " + "-".join("".join([*long[:20], "idiot", *long[20:40], "moron"])),
    ]
    texts = toxic + [spelled(long), "x " * 3000, "1 2 3 4 5 6 7 8 9 " * 40]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in X.score(docs, X.fit(docs, labels)).collect()}
    assert [got[9000 + i] for i in range(len(texts))] == [1] * len(toxic) + [0, 0, 0]
