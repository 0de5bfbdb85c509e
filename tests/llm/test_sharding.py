import hashlib
import zlib
from collections import Counter

import pytest

from helpers import SCHEMA, corpus
from tidelog.llm import sharding as H


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("shards,most_rows", [(40, 2000), (7, 3), (400, 2000)])
def test_against_exact_law(spark, shards, most_rows, monkeypatch):
    monkeypatch.setattr(H.intervals, "__defaults__", (H.SHARDS, 0, most_rows))
    monkeypatch.setattr(H, "MOST_REFINED", 10**6)
    rows = [(r[0], r[1]) for r in corpus(150, seed=12)] + [(1000 + i, "same text") for i in range(80)] + [(2000, "dup"), (2000, "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as shard")
    keys = {r.doc_id: r.key for r in H.slim(df).collect()}
    for i, t in rows:
        assert keys[i] >> H.ID_BITS == int(hashlib.md5((t or "").encode()).hexdigest()[:10], 16)
    size = lambda t: len((t or "").encode()) + 16
    total, below, want = sum(size(t) for _, t in rows), 0, {}
    for key in sorted(set(keys.values())):
        want[key] = min(shards - 1, below * shards // total)
        below += sum(size(t) for i, t in rows if keys[i] == key)
    got = rows_of(H.shard(df, shards).select("doc_id", "size", "text_crc32", "shard", "slot"))
    assert sorted(x[:3] for x in got) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for i, _, _, s, slot in got:
        assert s == want[keys[i]]
        by.setdefault(s, []).append((slot, keys[i]))
    for held in by.values():
        assert [x[0] for x in sorted(held)] == list(range(len(held)))
        assert [x[1] for x in sorted(held)] == sorted(x[1] for x in held)


def test_sizes_near_equal_and_tolerance(spark):
    rows = [(i, "x" * (i % 90)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tolerance in (0, 400):
        sums = Counter()
        for _, size, _, s, _ in rows_of(H.shard(df, 40, tolerance).select("doc_id", "size", "text_crc32", "shard", "slot")):
            sums[s] += size
        mean = sum(sums.values()) / 40
        assert len(sums) == 40 and max(abs(x - mean) for x in sums.values()) <= 2 * (106 + tolerance)


def test_edges(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "")], SCHEMA.replace(", lang string, source string, n_chars long", ""))
    assert sorted(str(x[0]) for x in rows_of(H.shard(df))) == ["1", "None", "None"]
    assert rows_of(H.shard(df.limit(0))) == []
