import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from helpers import SCHEMA, corpus
from tidelog.llm import packing as P

ODD = ["a  b", " lead", "trail ", "x \n y", "\n\n", "don't we'll\tgo\r\nnow", "é à b  c", "<|endoftext|> <|endoftext|>x", "１２ 3４", "naïve \u0085z", "\x1c \x1d", "a\n b\n\nc", "   ", "ends\n", "café le été　la", "tab \tb", "a   b", " x y"]


def ids_of(text):
    t = ids_of.t = getattr(ids_of, "t", None) or Tokenizer.from_file(P.vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    texts = ODD + [r[1] for r in corpus(40, seed=9)] + [a + b for a in ODD for b in ODD]
    flat, n = P.encode(pa.array(texts, pa.string()), P.vocabulary())
    at = 0
    for t, k in zip(texts, n, strict=True):
        assert flat[at : at + k].tolist() == ids_of(t), repr(t)
        at += k
    assert at == len(flat)


def check(pieces, texts, limits):
    docs, sequences = {}, {}
    for r in pieces:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids, at = ids_of(t) + [0], 0
        for r in sorted(docs[i], key=lambda r: r.start):
            own = ids[r.start : r.start + r.length]
            assert r.start == at and r.length == len(own) > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and own == r.ids
            prompt = min(64, len(ids) // 8)
            assert r.loss_tokens == sum(k >= prompt for k in range(r.start, r.start + r.length))
            at += r.length
        assert at == len(ids)
    padded = 0
    for parts in sequences.values():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.offset)):
            assert r.offset == at and r.segment == k
            at += r.length
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(r.loss_tokens for r in parts) <= limits.loss
        padded += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padded / max(1, sum(r.length for r in pieces))


@pytest.mark.parametrize("limits,most", [(P.Limits(), 0.01), (P.Limits(256, 4, 200), 1.5), (P.Limits(64, 64, 50), 1.5)])
def test_pieces_and_limits(spark, limits, most, monkeypatch):
    monkeypatch.setattr(P, "POOL", 64)
    texts = [r[1] for r in corpus(150, seed=10)] + ODD
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    assert check(P.pack(df, limits, with_ids=True).collect(), texts, limits) <= most


def test_every_limit_of_the_query_binds():
    """Long and short examples under the query's limits, and under the limit on tokens alone."""
    rnd = np.random.default_rng(3)
    sizes = [int(x) for x in np.concatenate([rnd.integers(2000, 6000, 30), rnd.integers(20, 90, 3000)])]
    for limits, pairs in ((P.Limits(), 3), (P.Limits(segments=1 << 30, loss=1 << 30), 1)):
        rows = []
        packer = P.Packer(limits, lambda key, start, ids, sequence, offset, segment, loss: rows.append((sequence, len(ids), loss)))  # noqa: B023
        for size in sizes:
            packer.add((0, size), np.zeros(size, np.int32), min(64, size // 8))
        packer.flush()
        sequence, n, loss = map(np.array, zip(*rows, strict=True))
        tokens, losses, pieces = np.bincount(sequence, n), np.bincount(sequence, loss), np.bincount(sequence)
        assert tokens.sum() == sum(sizes) and tokens.max() == 1024
        bound = sum(map(bool, ((losses == limits.loss).any(), (pieces == limits.segments).any(), (tokens == limits.tokens).any())))
        assert bound == pairs
        assert losses.max() <= limits.loss and pieces.max() <= limits.segments


def test_special_tokens_and_long_parts():
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>\nc", "x" * 3000 + " " + "é" * 700 + " y", " <|endoftext|>", "a<|endoftext|> <|endoftext|>"]
    flat, n = P.encode(pa.array(texts), P.vocabulary())
    assert [flat[b - k : b].tolist() for b, k in zip(np.cumsum(n), n, strict=True)] == [ids_of(t) for t in texts]
    assert (flat == 50256).sum() == 6


def test_edges(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as start").coalesce(1)
    got = P.pack(df).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.doc_tokens) for r in got) == [("1", 0, 1, 1), ("1", 0, 1, 1), ("None", 0, 1, 1)]
    assert sorted((r.sequence_id, r.offset) for r in got) == sorted(set((r.sequence_id, r.offset) for r in got))
    assert P.pack(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        P.Limits(tokens=0)
