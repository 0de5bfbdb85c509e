import hashlib
import re

import pytest

from helpers import SCHEMA
from tidelog.llm import spotsigs as S

COMMON = set(S.COMMON)


def chains(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in COMMON and i + 1 < len(words) and words[i + 1] not in COMMON:
            rest, gap, ok = [], 0, True
            for x in words[i + 1 :]:
                if x in COMMON:
                    continue
                rest.append(x)
                if len(rest) == S.CHAIN:
                    break
            if len(rest) == S.CHAIN:
                out.add(tuple(rest))
    return out or {("whole", tuple(words) if not set(words) & COMMON else " ".join("#" if w in COMMON else w for w in words))}


def jaccard(a, b):
    x = len(a & b) / len(a | b)
    return 0.0 if x < S.LEAST else x


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(chains(t), chains(edited)), jaccard(chains(t), chains(other)))
    return out


def texts():
    import random

    rnd = random.Random(11)
    words = ["the", "of", "and", "la", "der", "que"] * 6 + ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(3, 7))) for _ in range(80)]
    out = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 150))) for _ in range(60)]
    out += [None, "", "one", "the the the", "😀 of the 😀😀 cat dog", "the " * 5000 + "cat sat", "the cat, of dog", out[3], out[3]]
    return out


@pytest.mark.parametrize("bucket,cells", [(7, 65536), (1, 5), (10**6, 65536)])
def test_against_plain_python(spark, monkeypatch, bucket, cells):
    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S.with_next, "__defaults__", (bucket,))
    rows = [(i * i * 37, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).repartition(3)
    got, want = S.compare_with_edits(df).collect(), brute(rows)
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.near_edited, r.near_next) == (pytest.approx(edited), pytest.approx(after)), (r.doc_id, r)
        prints.setdefault(frozenset(chains(dict(rows)[r.doc_id])), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values()) and len(prints) == len({min(x) for x in prints.values()})


def test_edges(spark):
    df = spark.createDataFrame([(1, "the cat sat down")], "doc_id long, text string").selectExpr("*", "'x' as bucket", "1 as found")
    r = S.compare_with_edits(df).first()
    assert (r.n_chars, r.near_next) == (16, 1.0)
    assert S.compare_with_edits(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (5, "x y"), (5, "x y")], "doc_id long, text string")
    got = S.compare_with_edits(odd).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("5", 3), ("5", 3), ("None", 0), ("None", 5)]
