"""Quality rules: tokeniser fertility.

Each word of a text is segmented by a public vocabulary with byte fallback. Three measures follow: characters per
token, the share of tokens that are byte fallbacks, and the entropy of the text's tokens in bits. Each language (or,
for an unknown one, the text's script) has a band for each measure; a text outside of one is rejected.

Words are segmented apart from each other, as the vocabulary does itself, so every distinct word of a batch is
segmented once. Batches are worked on as arrays; memory follows the batch, not the partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import ship
from tidelog.llm._text import U64, Words, chunks, mix, spread, sums

#: Name of the vocabulary file of the public tokenizers; see ``vocabulary``.
VOCABULARY = "piece_bpe_32k.model"
#: Byte-fallback pieces of that vocabulary: ids 3 to 258.
BYTE_IDS = range(3, 259)
WINDOW = 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Bounds within which a text stays. The entropy's lower bound is for ``full`` tokens; shorter texts, whose
    entropy can't reach it, need the same share of the most they could have (log2 of their tokens)."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: float
    full: int = 256

    def needed_entropy(self, tokens: np.ndarray) -> np.ndarray:
        return self.entropy * np.minimum(1.0, np.log2(np.maximum(tokens, 2)) / np.log2(self.full))


#: By language, then by script where the language has none: at least half of the letters are ASCII ("latin") or not.
BANDS = {
    "en": Band((1.7, 6.0), 0.05, 5.9),
    "de": Band((1.7, 6.0), 0.05, 5.8),
    "fr": Band((1.5, 6.0), 0.05, 5.8),
    "es": Band((1.5, 6.0), 0.05, 5.8),
    "latin": Band((1.2, 7.0), 0.10, 5.0),
    "other": Band((0.3, 7.0), 0.60, 3.5),
}

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, base_failed boolean, band string, kept boolean"
MEASURES = [x.split()[0] for x in SCHEMA.split(", ")]


def vocabulary(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary file on the machine that asks; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict = {}


def _processor(path: str):
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def _repeated(words: Words, window: int = WINDOW) -> np.ndarray:
    """For each row the words that stand in a window of words found twice or more in that row."""
    n = len(words.codes)
    held = np.zeros(n + 1, np.int64)
    row = words.rows()
    starts = np.flatnonzero(words.n >= window)
    if len(starts):
        at = spread(words.first[:-1][starts], words.n[starts] - window + 1)
        base = mix(np.arange(len(words.dictionary), dtype=U64) + U64(1))
        key = np.zeros(len(at), U64)
        for i in range(window):
            key = key * U64(0x9E3779B97F4A7C15) + base[words.codes[at + i]]
        key = mix(key) ^ mix(row[at].astype(U64) + U64(1 << 40))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(held, at[twice], 1)
        np.add.at(held, at[twice] + window, -1)
    return sums((np.cumsum(held[:-1]) > 0).astype(np.int64), words.first)


def _entropy(row: np.ndarray, token: np.ndarray, n: np.ndarray, vocabulary_size: int) -> np.ndarray:
    """Bits of entropy of each row's tokens."""
    out = np.zeros(len(n))
    key = np.sort(row * vocabulary_size + token)
    if len(key):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(starts, len(key))).astype(float)
        np.add.at(out, key[starts] // vocabulary_size, count * np.log2(count))
    total = np.maximum(n, 1)
    return np.where(n > 0, np.log2(total) - out / total, 0.0)


def measure(texts: pa.Array, langs: list, path: str, bands: dict[str, Band]) -> list[np.ndarray | list]:
    """The columns of SCHEMA for a batch of texts (null: no words)."""
    words = Words(texts)
    data, at = words.data, words.at
    points = (data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    word_chars, n_symbols = sums(points & words.inside, at), sums(symbol[data], at)
    plain, marked = sums(words.inside & (data < 0x80), at), sums(points & (data >= 0xC0), at)
    whole, dup_lines = data.tobytes(), np.zeros(len(words.n), np.int64)
    for i in range(len(words.n)):
        lines = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    repeated = _repeated(words)

    model = _processor(path)
    ids = model.encode([w.decode() for w in words.dictionary], num_threads=1)
    per_word = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for y in ids for x in y), np.int64, int(per_word.sum()))
    begin = np.cumsum(per_word) - per_word
    fallback = (flat >= BYTE_IDS.start) & (flat < BYTE_IDS.stop)
    bytes_per_word = sums(fallback, np.append(begin, len(flat)))
    n_tokens, n_bytes = sums(per_word[words.codes], words.first), sums(bytes_per_word[words.codes], words.first)
    token = flat[spread(begin[words.codes], per_word[words.codes])]
    entropy = _entropy(np.repeat(np.arange(len(words.n)), n_tokens), token, n_tokens, model.vocab_size())
    tokens = np.maximum(n_tokens, 1)
    density, share = word_chars / tokens, n_bytes / tokens

    base_failed = (words.n < 20) | (100 * repeated > 30 * words.n)
    names = [x if x in bands else "latin" if 2 * m <= p + m else "other" for x, p, m in zip(langs, plain, marked, strict=True)]
    kept = ~base_failed
    for name in set(names):
        band, own = bands[name], np.array([x == name for x in names])
        good = (density >= band.chars_per_token[0]) & (density <= band.chars_per_token[1]) & (share <= band.byte_share) & (entropy >= band.needed_entropy(n_tokens))
        kept &= ~own | good
    return [words.n, word_chars, n_symbols, dup_lines, repeated, n_tokens, density, share, entropy, base_failed, names, kept]


def fertility(docs: DataFrame, vocabulary_path: str | None = None, bands: dict[str, Band] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (doc_id by default) and the measures of SCHEMA for each row of ``docs`` (text, lang, ...).

    Null, empty and wordless texts have no words and fail the base rule. A null or unknown lang takes the band of
    the text's script. Repeated rows each return a row; an empty table returns none. A measure replaces a column in
    ``carry`` that has its name. Very long texts are measured whole, one at a time. Nothing is shuffled.
    """
    carry = [c for c in (carry or ["doc_id"]) if c not in MEASURES]
    out, named = _measured(docs, carry, vocabulary_path, bands, False)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *MEASURES) if named else out


def kept(docs: DataFrame, vocabulary_path: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all of their columns, whatever these are named."""
    out, _ = _measured(docs, docs.columns, vocabulary_path, bands, True)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _measured(docs: DataFrame, carry: list[str], vocabulary_path: str | None, bands: dict[str, Band] | None, only_kept: bool) -> tuple[DataFrame, bool]:
    """The ``carry`` columns as c0, c1, ... of rows that are kept, or of all rows with MEASURES."""
    ship(docs.sparkSession)
    path, bands = vocabulary_path or vocabulary(), bands or BANDS
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    # with all columns carried, text and lang are among them and aren't sent twice
    text, lang = (carry.index(c) if only_kept else len(carry) + k for k, c in enumerate(("text", "lang")))
    rows = docs.select(*named, *([] if only_kept else [F.col("text").alias("t"), F.col("lang").cast("string").alias("l")]))
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches):
        for part in chunks(batches, text):
            langs = part.column(lang)
            measures = measure(part.column(text), langs.to_pylist(), path, bands)
            if only_kept:
                yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(measures[-1]))
            else:
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *map(pa.array, measures)], [*names, *MEASURES])

    fields = ", ".join(f"c{i} {rows.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(carry)))
    return rows.mapInArrow(run, fields if only_kept else ", ".join(x for x in (fields, SCHEMA) if x)), not only_kept
