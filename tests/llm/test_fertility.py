import math
from collections import Counter

import pytest

from helpers import SCHEMA, WORD, corpus
from tidelog.llm import fertility as Q


def brute(text, lang):
    import sentencepiece

    sp = brute.sp = getattr(brute, "sp", None) or sentencepiece.SentencePieceProcessor(model_file=Q.vocabulary())
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    ids = [i for w in words for i in sp.encode(w)]
    n, chars = len(ids), sum(map(len, words))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values()) if n else 0.0
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    ascii_, other = sum(len([c for c in w if ord(c) < 128]) for w in words), sum(len([c for c in w if ord(c) >= 128]) for w in words)
    name = lang if lang in Q.BANDS else "latin" if 2 * other <= ascii_ + other else "other"
    b = Q.BANDS[name]
    share, density = sum(i in Q.BYTE_IDS for i in ids) / max(1, n), chars / max(1, n)
    need = b.entropy * min(1, math.log2(max(n, 2)) / math.log2(b.full))
    kept = not failed and b.chars_per_token[0] <= density <= b.chars_per_token[1] and share <= b.byte_share and entropy >= need
    return len(words), chars, sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, n, density, share, entropy, name, kept


def test_against_plain_python(spark):
    texts = [r[1] for r in corpus(60, seed=8)] + ["a b c d e f g h " * 9, "x\n\nx\nx \n\x0b\ny y", "数学の物語 😀 💩 b", "é" * 90 + " ##$ <b>", "\x1c\x1d word word", "\x00 null"]
    langs = ["en", "de", None, "xx"]
    df = spark.createDataFrame([(i, t, langs[i % 4], None, 0) for i, t in enumerate(texts)], SCHEMA)
    for r in Q.fertility(df).collect():
        w = brute(texts[r.doc_id], langs[r.doc_id % 4])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_tokens) == w[:7], texts[r.doc_id]
        assert (r.chars_per_token, r.byte_share, r.token_entropy) == pytest.approx(w[7:10], abs=1e-9)
        assert (r.band, r.kept) == w[10:]


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, "s", 1), (1, "", "en", "s", 1), (1, "", "en", "s", 1)], SCHEMA).selectExpr("*", "'x' as kept", "array(1) as l")
    got = Q.fertility(df, carry=["doc_id", "text", "lang", "source", "n_chars", "l"])
    assert got.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "l"]
    assert [(r.n_words, r.base_failed, r.kept) for r in got.collect()] == [(0, True, False)] * 3
    assert Q.fertility(df.limit(0)).collect() == []


def test_long_text_in_small_chunks(spark):
    text = "\n".join(f"w{i} " + "é" * (i % 7) for i in range(40_000))
    df = spark.createDataFrame([(0, text, "fr", "s", 1)], SCHEMA)
    assert Q.fertility(df).first().n_words == brute(text, "fr")[0]
