import random

import numpy as np
import pyarrow as pa

from helpers import SCHEMA
from tidelog.llm import weak_labels as Q
from tidelog.llm._common import sampled
from tidelog.llm._text import Words


def data(n=600, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["th", "er", "on", "an"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        kind = rnd.choice(["symbols", "bars", "capitals", "repeats"]) if rnd.random() < 0.25 else "good"
        if kind == "symbols":
            t = [w + "###" for w in t]
        if kind == "bars":
            t = [x for w in t for x in (w, "|")]
        if kind == "capitals":
            t = [w.upper() + "!!" for w in t]
        if kind == "repeats":
            t = [w for w in t[:8] for _ in range(20)]
        out.append((i, ". ".join(" ".join(t[k : k + 9]) for k in range(0, len(t), 9)) + ".", kind == "good"))
    return out


def test_em_recovers_accuracies():
    rnd = np.random.default_rng(2)
    k, n = len(Q.LABELLERS), 40_000
    good = rnd.random(n) < 0.7
    right = np.linspace(0.65, 0.95, k)
    voted = rnd.random((n, k)) < 0.8
    correct = rnd.random((n, k)) < right
    cast = np.where(voted, np.where(correct == good[:, None], 1, 2), 0)
    own, count = np.unique(cast, axis=0, return_counts=True)
    model = Q.expectation_maximisation(own, count.astype(float))
    assert abs(model.good - 0.7) < 0.03
    assert np.allclose(list(model.accuracies().values()), right, atol=0.03)
    assert ((model.posterior(cast) > 0.5) == good).mean() > 0.95


def test_end_to_end(spark):
    rows = data()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    train, test = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    got = {r.doc_id: r for r in Q.score(test, *Q.fit(train)).collect()}
    right = [got[i].kept == good for i, _, good in rows if i % 2]
    assert np.mean(right) > 0.9 and all(got[i].kept for i, _, good in rows if i % 2 and good)
    assert all(len(r.votes) == len(Q.LABELLERS) for r in got.values())


def test_measures_of_plain_texts():
    m = Q.measures(Words(pa.array(["A b b | # X!", None, "", "YES NO yes"])))
    assert m["words"].tolist() == [6, 0, 0, 3] and m["capital_share"][3] == 2 / 3
    assert m["bar_share"][0] == 1 / 6 and m["symbol_share"][0] == 1 / 6 and m["repeat_share"][0] == 1 / 6
    assert m["distinct_share"][0] == 5 / 6


def test_edges(spark):
    df = spark.createDataFrame([(None, None, "x", "y", 1), (1, "", "x", "y", 1), (1, "", "x", "y", 1)], SCHEMA).withColumnRenamed("n_chars", "score")
    got = Q.score(df, *Q.fit(df)).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    empty = df.limit(0)
    assert Q.score(empty, *Q.fit(empty)).collect() == []


def test_kinds_of_badness_that_never_meet():
    """Bad texts with one bad vote each are found, though all other labellers call them good."""
    rnd = np.random.default_rng(4)
    k, n = len(Q.LABELLERS), 20_000
    bad = rnd.random(n) < 0.15
    kind = rnd.choice(np.flatnonzero(Q.FALSE_ALARMS < 1), n)
    cast = np.where(rnd.random((n, k)) < 0.98, 1, 0)
    cast[bad, kind[bad]] = 2
    own, count = np.unique(cast, axis=0, return_counts=True)
    model = Q.expectation_maximisation(own, count.astype(float), false_alarms=Q.FALSE_ALARMS)
    dropped = model.posterior(cast) < 0.5
    assert dropped[bad].all() and dropped[~bad].mean() < 0.002
    assert abs(model.good - 0.85) < 0.03


def test_short_texts_are_no_bad_ones():
    m = Q.votes(Q.measures(Words(pa.array(["This.", "In. The.", "A short note on birds."]))))
    assert (m != 2).all()


def test_fit_reads_no_more_rows_than_its_bound(spark):
    df = spark.createDataFrame([(1, "one id of many rows.")] * 40 + [(i, f"text {i}. of its own") for i in range(2, 30)], "doc_id long, text string")
    ids = df.selectExpr("doc_id as sampled").distinct()
    held = sampled(df, ids, 20)
    assert held.count() == 20 and held.where("sampled = 1").count() == 0
    assert sampled(df, ids, 100).count() == 29
    Q.fit(df, rows=20)


def test_long_and_disguised_columns(spark):
    long = " ".join(f"word{i}." for i in range(60_000))
    df = spark.createDataFrame([(1, long, 0.1), (2, "a b. c d.", 0.2)], "doc_id long, text string, kept double")
    assert {r.doc_id for r in Q.score(df, *Q.fit(df)).collect()} == {1, 2}
