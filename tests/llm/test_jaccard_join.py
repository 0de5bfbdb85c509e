import random

import numpy as np
import pyarrow as pa
import pytest

from helpers import SCHEMA, corpus, jaccard_rows, shingles
from tidelog.llm import jaccard_join as J


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("seed,most,vocabulary", [(1, 120, 400), (2, 14, 60)])
def test_against_all_pairs(spark, seed, most, vocabulary):
    rows = corpus(160, seed=seed, most=most, vocabulary=vocabulary)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(J.jaccard_classes(df)) == jaccard_rows(rows)


def test_common_shingles_are_dear(spark):
    rows = corpus(100, seed=3)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert len(J.common_shingles(J.measured(df.select("doc_id", "text"), 5), 3)) > 0
    assert rows_of(J.jaccard_classes(df, common_least=3, common_most=500)) == jaccard_rows(rows)


def test_families_of_loosely_similar_texts(spark):
    """Copies of one text with more and more edits: some link with it, some with each other, most with nothing."""
    rnd = random.Random(9)
    text = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(300):
        own = list(text)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own), "en", "s", 0))
    want = jaccard_rows(rows)
    assert 20 < len({c for _, _, c in want}) < 280
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(J.jaccard_classes(df)) == want
    old, J.BLOCK = J.BLOCK, 16  # groups in blocks
    try:
        assert rows_of(J.jaccard_classes(df)) == want
    finally:
        J.BLOCK = old


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows_of(J.jaccard_classes(empty)) == []
    odd = [(7, None), (7, None), (3, "a b c d e f g"), (9, "A b\tc d\ne f g"), (None, "a b c d e f g"), (5, "x")]
    df = spark.createDataFrame([(*r, 1, "s") for r in odd], "doc_id long, text string, n_shingles int, component_id string")
    got = [tuple(r) for r in J.jaccard_classes(df).collect()]
    assert sorted(got, key=str) == sorted([(7, 0, 7), (7, 0, 7), (3, 3, 3), (9, 3, 3), (None, 3, None), (5, 1, 5)], key=str)


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(4, one), (4, two), (6, one), (2, two), (8, one + " z"), (9, two + " z"), (9, two + " z"), (5, "apart from all of them")]
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(4, 2), (6, 2), (2, 2), (8, 2), (9, 2), (5, 5)} and len(got) == len(rows)


def test_sets_against_brute_force():
    texts = [r[1] for r in corpus(60, seed=4, most=40)] + ["A a", " ", "q" * 100 + " " + "q" * 101, "é É e E"]
    flat, at = J.shingle_sets(pa.array(texts))
    sizes = [len(shingles(t)) for t in texts]
    assert np.diff(at).tolist() == sizes
    known: dict = {}
    for i, t in enumerate(texts):
        own = flat[at[i] : at[i + 1]]
        assert np.all(own[1:] > own[:-1])
        known.setdefault(frozenset(shingles(t)), tuple(own.tolist()))
        assert known[frozenset(shingles(t))] == tuple(own.tolist())
    assert len(set(flat.tolist())) == len(set().union(*map(shingles, texts)))


def random_pairs(seed, rounds, hot):
    rnd = np.random.default_rng(seed)
    for i in range(rounds):
        base = np.unique(rnd.integers(0, 2**63, int(rnd.integers(1, (12, 40, 400)[i % 3]))).astype(np.uint64))
        common = np.sort(base[rnd.random(len(base)) < rnd.random()]) if hot else None
        drop = rnd.random(len(base)) < rnd.random() * 0.2
        other = np.unique(np.concatenate([base[~drop], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + len(base) // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(base, other))
        if both < len(base) + len(other) - both and 100 * both >= 80 * (len(base) + len(other) - both):
            yield base, other, common


@pytest.mark.parametrize("hot", [False, True])
def test_pigeonhole_holds_for_random_pairs(hot):
    n = 0
    for base, other, common in random_pairs(5, 4000, hot):
        sig, row = J.signatures(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), 80, common)
        assert len(np.intersect1d(sig[row == 0], sig[row == 1]))
        n += 1
    assert n > 1000


def test_allocation_follows_cost():
    """Dear subsets aren't indexed, and one-deletion neighbourhoods make up for them."""
    rnd = np.random.default_rng(6)
    tokens = np.unique(rnd.integers(0, 2**63, 400).astype(np.uint64))
    at = np.array([0, len(tokens)])
    plain = len(J.signatures(tokens, at)[0])
    segments = int(J.differ(len(tokens) * 2, 80)) + 1
    assert segments <= plain < 4 * segments
    # a twentieth of the shingles common: some segments have no rare one
    few = np.sort(tokens[rnd.random(len(tokens)) < 0.3])
    with_few = len(J.signatures(tokens, at, 80, few)[0])
    assert plain < with_few < plain + len(tokens)
    # two sets that share common shingles only, and many of them: no signature in common
    own = [np.unique(rnd.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(2)]
    sets = [np.unique(np.concatenate([few, x])) for x in own]
    both = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
    sig, row = J.signatures(*both, 80, few)
    assert not len(np.intersect1d(sig[row == 0], sig[row == 1]))
    sig, row = J.signatures(*both, 80, None)
    assert len(np.intersect1d(sig[row == 0], sig[row == 1]))


def test_bitmaps_never_exceed_the_difference():
    for base, other, _ in random_pairs(7, 300, False):
        maps = np.stack(J.bitmaps(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)])))
        flipped = sum(int(x).bit_count() for x in (maps[:, 0] ^ maps[:, 1]).view(np.uint64))
        assert flipped <= len(np.setxor1d(base, other)) <= J.differ(len(base) + len(other), 80)
