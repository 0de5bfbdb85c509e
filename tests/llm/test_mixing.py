import hashlib

import duckdb
import pytest

from helpers import SCHEMA, corpus
from tidelog.llm import mixing as M


def fill(given, children):
    """children: {name: (room, weight)}; water filling by repeated shares, then whole tokens by name."""
    left, open_, out = given, dict(children), {}
    while True:
        total = sum(w for _, w in open_.values())
        full = [k for k, (room, w) in open_.items() if room * total <= left * w]
        if not full:
            break
        k = min(full, key=lambda k: open_[k][0] / open_[k][1])
        out[k] = open_.pop(k)[0]
        left -= out[k]
    total = sum(w for _, w in open_.values())
    for k, (_, w) in open_.items():
        out[k] = left * w // total
    spare = left - sum(out[k] for k in open_)
    for k in sorted(open_, key=lambda x: (x is not None, x or ""))[:spare]:
        out[k] += 1
    return out


def brute(rows, mix):
    def tokens(t):
        return -(-len((t or "").encode()) // 4)

    leaves = {}
    for i, t, lang, source, _ in rows:
        leaves.setdefault((mix.domain_of.get(source, mix.other_domain), lang, source), []).append((i, tokens(t)))
    weight = lambda level, name: mix.weights.get(level, {}).get(name, mix.other)
    room = {k: mix.epochs * sum(n for _, n in v) for k, v in leaves.items()}
    budget = {(): sum(n for v in leaves.values() for _, n in v) * mix.share // 1000}
    for depth, level in enumerate(M.LEVELS):
        below = {}
        for parent, given in budget.items():
            names = {k[depth] for k in leaves if k[:depth] == parent}
            shares = fill(given, {n: (sum(r for k, r in room.items() if k[: depth + 1] == (*parent, n)), weight(level, n)) for n in names})
            below |= {(*parent, n): q for n, q in shares.items()}
        budget = below
    out = []
    for leaf, docs in leaves.items():
        supply, quota = sum(n for _, n in docs), budget[leaf]
        whole, rest = divmod(quota, supply) if supply else (0, 0)
        out += [(i, *leaf, n, e) for i, n in docs for e in range(whole)]
        order = sorted(docs, key=lambda d: (hashlib.md5(f"{mix.seed}:{whole}:{d[0]}".encode()).hexdigest(), d[0]))
        reach = 0
        for i, n in order:
            reach += n
            if rest and reach <= rest:
                out.append((i, *leaf, n, whole))
    return sorted(out, key=str)


MIXES = [M.PRODUCTION, M.Mix(share=400, epochs=1), M.Mix(domain_of={"src1": "a", "src7": "b"}, weights={"domain": {"a": 9}, "lang": {"en": 3}}, share=1500, epochs=3)]


@pytest.mark.parametrize("mix", MIXES)
def test_against_model_and_sql(spark, mix, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    rows = corpus(150, seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mixed(df, mix).select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epoch").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, mix)
    documents = df.toPandas()
    con = duckdb.connect()
    con.register("documents", documents.astype({"doc_id": "int64"}))
    assert sorted(con.sql(M.oracle(mix)).fetchall(), key=str) == brute(rows, mix)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "lookup_join", lambda *a, **k: __import__("tidelog.llm._common", fromlist=["x"]).lookup_join(*a, **k, limit=0))
    df = spark.createDataFrame([(None, "abcd", "en", "src0", 1), (1, "abcd", None, None, 1), (1, "abcd", None, None, 1), (2, None, "en", "src0", 1)], SCHEMA).selectExpr("*", "1 as domain", "2 as bucket")
    got = M.mixed(df, M.Mix(share=2000))
    assert got.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "domain", "bucket"]
    assert sorted((str(r.doc_id), r.mix_epoch) for r in got.collect()) == [("1", 0), ("1", 0), ("1", 1), ("1", 1), ("2", 0), ("2", 1), ("None", 0), ("None", 1)]
    assert M.mixed(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.Mix(epochs=0)
