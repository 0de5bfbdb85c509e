"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A word that may be disguised (digits and signs for letters, letters apart, letters repeated) becomes a lattice of the
letters each character can stand for. Viterbi decoding finds its best readings under a bigram model of characters,
whose counts are gathered from the words of all documents. Runs of single letters, and words that stay long when their
repeats are collapsed, have breaks between words in their lattice and may be of any length. The text so restored is
scored by a logistic model over the words that tell toxic from other texts in the labelled training rows.

The classifier is fitted on a bounded sample, TRAIN_ROWS labelled training rows by the least hash of their ids; only
hashes of those rows' words reach the driver. Labels, languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import sampled, ship
from tidelog.llm._text import LOWER, U64, Words, chunks, hashes, mix, spread, sums

#: Labelled rows that the classifier is fitted on at most.
TRAIN_ROWS = 8000
#: Words of the model at most, and the training rows in which a word must be seen.
LEXICON, LEAST_ROWS = 400, 5
#: Log-odds of a word of the model at least.
LEAST_ODDS = 2.5
THRESHOLD = 0.7
#: Lengths of the stems of words that are features beside the words.
STEMS = (4, 5)
#: Flips bits of a feature's hash where the feature is seen more than once in a text.
AGAIN = 0x2545F4914F6CDD1D
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßàâçèéêëîïôùûáíñóú"
#: Readings of signs. A sign read as a letter costs SUBSTITUTE nats, a skipped separator or repeat costs SKIP.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
SEPARATORS = ".-_*~'`,/"
SUBSTITUTE, SKIP, BEST, MARGIN, LONGEST = 1.5, 0.5, 4, 5.0, 48

_PLAIN = re.compile(rf"[{ALPHABET}]+")
_OUTER = re.compile(r"^[\"'(\[{<.,;:?*#%&|~`-]+|[\"')\]}>.,;:?!*#%&|~`-]+$")
_LETTERS = re.compile(rf"[{ALPHABET}]")
_TRIPLE = re.compile(r"(.)\1\1")
_REPEATS = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Stretches of characters that can be spelled letters.
_SPELLED = re.compile(f"[{ALPHABET}{re.escape(''.join(READINGS) + SEPARATORS)}]+")
_INDEX = {c: i for i, c in enumerate(ALPHABET)}
_EDGE = len(ALPHABET)
#: Outer punctuation, letters and their places by byte; letters beyond ASCII are two bytes, of which the first is _TWO.
_TWO = 0xC3
_LEADING, _TRAILING, _ASCII, _SECOND = (np.isin(np.arange(256), list(x)) for x in (b"\"'([{<.,;:?*#%&|~`-", b"\"')]}>.,;:?!*#%&|~`-", bytes(range(97, 123)), bytes(c.encode()[1] for c in ALPHABET[26:])))
_PLACE, _PLACE_TWO = np.zeros(256, np.int64), np.zeros(256, np.int64)
for _c, _i in _INDEX.items():
    if _c.isascii():
        _PLACE[ord(_c)] = _i
    else:
        _PLACE_TWO[_c.encode()[1]] = _i


def suspicious(word: str) -> bool:
    """Whether a lower-case word without its outer punctuation may be disguised."""
    if len(word) < 3:
        return False
    letters = len(_LETTERS.findall(word))
    if letters == len(word):
        return bool(_TRIPLE.search(word))
    signs = sum(c in READINGS or c in SEPARATORS for c in word)
    return letters + signs == len(word) and letters >= 1 and signs <= max(3, 2 * letters)


def decode(word: str, model: np.ndarray, best: int = BEST) -> list[tuple[float, str]]:
    """The best readings of a word as (cost, letters), the cheapest first: list Viterbi over the lattice.

    ``model`` has the cost of each character after each other one; the last row and column are the word's edges.
    """
    states: dict[int, list[tuple[float, str]]] = {_EDGE: [(0.0, "")]}
    for i, c in enumerate(word):
        moves = [(c, 0.0)] if c in _INDEX else [(x, SUBSTITUTE) for x in READINGS.get(c, "")]
        skip = SKIP if c in SEPARATORS or i and c == word[i - 1] else None
        after: dict[int, list[tuple[float, str]]] = {}
        for last, paths in states.items():
            if skip is not None:
                after.setdefault(last, []).extend((cost + skip, text) for cost, text in paths)
            for letter, cost in moves:
                step = cost + model[last, _INDEX[letter]]
                after.setdefault(_INDEX[letter], []).extend((c0 + step, text + letter) for c0, text in paths)
        states = {}
        for s, paths in after.items():
            kept: dict[str, float] = {}
            for cost, text in sorted(paths):
                kept.setdefault(text, cost)
                if len(kept) == best:
                    break
            states[s] = [(cost, text) for text, cost in kept.items()]
    done = sorted((cost + model[s, _EDGE], text) for s, paths in states.items() for cost, text in paths)
    return done[:best]


def segments(run: str, model: np.ndarray) -> set[tuple[int, str]]:
    """(start, letters) of the words, of at most LONGEST characters, in the good segmentations of a run of any length.

    The lattice is that of ``decode`` with breaks between words. A word is returned if the best segmentation with it
    costs at most MARGIN more than the best of all for each of its two ends. The time is in proportion to the run.
    """
    m, n = model.tolist(), len(run)
    moves = [[(_INDEX[c], c, 0.0)] if c in _INDEX else [(_INDEX[x], x, SUBSTITUTE) for x in READINGS.get(c, "")] for c in run]
    skips = [c in SEPARATORS or i > 0 and c == run[i - 1] for i, c in enumerate(run)]
    far = math.inf
    before: list[dict[int, float]] = [{_EDGE: 0.0}]
    for i in range(n):
        after: dict[int, float] = {}
        for s, cost in before[i].items():
            if skips[i]:
                after[s] = min(after.get(s, far), cost + SKIP)
            for x, _, extra in moves[i]:
                after[x] = min(after.get(x, far), cost + extra + m[s][x])
        ends = [cost + m[s][_EDGE] for s, cost in after.items() if s != _EDGE]
        after[_EDGE] = min([after.get(_EDGE, far), *ends])
        before.append(after)
    rest: list[dict[int, float]] = [{}] * n + [{s: m[s][_EDGE] if s != _EDGE else 0.0 for s in before[n]}]
    for i in range(n - 1, -1, -1):
        to, own = rest[i + 1], {}
        for s in sorted(before[i], reverse=True):  # the break's state first
            cost = to[s] + SKIP if skips[i] else far
            for x, _, extra in moves[i]:
                cost = min(cost, extra + m[s][x] + to[x])
            own[s] = min(cost, m[s][_EDGE] + own[_EDGE]) if s != _EDGE else cost
        rest[i] = own
    limit = rest[0][_EDGE] + 2 * MARGIN + 1e-9
    found: set[tuple[int, str]] = set()
    for start in range(n):
        states = {_EDGE: [(before[start][_EDGE], "")]}
        for i in range(start, min(n, start + LONGEST)):
            grown: dict[int, list[tuple[float, str]]] = {}
            for s, paths in states.items():
                if skips[i] and s != _EDGE:
                    grown.setdefault(s, []).extend((cost + SKIP, text) for cost, text in paths)
                for x, letter, extra in moves[i]:
                    step = extra + m[s][x]
                    grown.setdefault(x, []).extend((cost + step, text + letter) for cost, text in paths)
            states = {}
            for s, paths in grown.items():
                kept: dict[str, float] = {}
                for cost, text in sorted(paths):
                    if cost + rest[i + 1][s] > limit or len(kept) == BEST:
                        break
                    kept.setdefault(text, cost)
                if kept:
                    states[s] = [(cost, text) for text, cost in kept.items()]
                    out = m[s][_EDGE] + rest[i + 1][_EDGE]
                    found.update((start, text) for text, cost in kept.items() if cost + out <= limit)
            if not states:
                break
    return found


def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of words given by their bytes: of each one, and of the stems of STEMS characters it begins with."""
    of, out = [np.arange(len(starts))], [hashes(data, starts, lengths)]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    begin, end = np.searchsorted(first, starts), np.searchsorted(first, starts + lengths)
    for n in STEMS:
        long = np.flatnonzero(end - begin >= n)
        to = np.append(first, len(data))[begin[long] + n]
        of.append(long)
        out.append(mix(hashes(data, starts[long], to - starts[long]) ^ U64(n)))
    return np.concatenate(of), (np.concatenate(out) >> U64(1)).astype(np.int64)


def _features(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of readings and of the stems they begin with, which tell inflected and compound words."""
    texts = [w.encode() for w in found]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    lengths = np.diff(np.concatenate((np.zeros(1, np.int64), ends)))
    return _hashed(np.frombuffer(b"".join(texts), np.uint8), ends - lengths, lengths)


def _plain(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words by their bytes: which are letters of ALPHABET, none three times in a row, but for outer
    punctuation; and where each one's letters start and end. What ``readings`` returns for these is the letters."""
    start, end, n = at[:-1].copy(), at[1:].copy(), len(data)
    if not n:
        return np.zeros(len(start), bool), start, end
    for edge, table, step in ((start, _LEADING, 1), (end, _TRAILING, -1)):
        todo = np.flatnonzero(end > start)
        while len(todo):
            todo = todo[table[data[edge[todo] - (step < 0)]]]
            edge[todo] += step
            todo = todo[end[todo] > start[todo]]
    second = np.zeros(n, bool)
    second[1:] = (data[:-1] == _TWO) & _SECOND[data[1:]]
    good = _ASCII[data] | second
    good[:-1] |= second[1:]
    thrice = np.zeros(n + 1, np.int64)
    same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    thrice[1 : len(same) + 1] = same
    twice = np.zeros(n + 1, np.int64)
    if n >= 6:
        pair = (data[2:] == data[:-2])
        whole = (data[:-5] == _TWO) & pair[:-3] & pair[1:-2] & pair[2:-1] & pair[3:]
        twice[1 : len(whole) + 1] = whole
    bad, thrice, twice = (np.concatenate((np.zeros(1, np.int64), np.cumsum(~good)))), np.cumsum(thrice), np.cumsum(twice)
    within = lambda upto, less: upto[np.maximum(end - less, start)] - upto[start]
    return (end > start) & (within(bad, 0) == 0) & (within(thrice, 2) == 0) & (within(twice, 5) == 0), start, end


def readings(word: str, model: np.ndarray) -> list[str]:
    """What a word of the text may say: itself in lower case without outer punctuation, or its restored readings."""
    word = word.lower()
    bare = _OUTER.sub("", word)
    if _PLAIN.fullmatch(bare) and not _TRIPLE.search(bare):
        return [bare]
    # signs at an edge may be letters, so they are tried before they are taken for punctuation
    tries = {_REPEATS.sub(r"\1\1\1", w) for w in (word.rstrip(".,;:?\"')"), bare) if suspicious(w)}
    found = [r for w in tries if len(w) <= LONGEST for r in decode(w, model)]
    parts = sorted({text for w in tries if len(w) > LONGEST for _, text in segments(w, model)})
    if not found and not parts:
        return [bare] if bare else []
    least = min(found)[0] if found else 0.0
    return list(dict.fromkeys([bare, *(text for cost, text in sorted(found) if text and cost <= least + MARGIN), *parts]))


def _spaced(run: str, model: np.ndarray) -> np.ndarray:
    """Features of a run of single characters: as one word, and as the words of its good segmentations.

    A feature counts once for each place where it begins.
    """
    run = _REPEATS.sub(r"\1\1\1", run.lower())
    found = {(0, text) for text in readings(run, model)} if len(run) <= LONGEST else set()
    for stretch in _SPELLED.finditer(run):
        if _LETTERS.search(stretch[0]):
            found |= {(stretch.start() + at, text) for at, text in segments(stretch[0], model)}
    at = np.array([a for a, _ in sorted(found)], np.int64)
    of, feature = _features([text for _, text in sorted(found)])
    return np.unique(np.stack([at[of], feature], axis=1), axis=0)[:, 1] if len(of) else feature


@dataclass
class Model:
    characters: np.ndarray
    words: np.ndarray  # hashes, sorted
    weights: np.ndarray
    bias: float

    def score(self, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(hits + self.bias, -30, 30)))


def _spelled(words: Words, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the features of each row's words and of its runs of single letters, in order of rows."""
    data, at = words.letters
    data = LOWER[data]
    plain, start, end = _plain(data, at)
    easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
    of, hashed = _hashed(data, start[easy], (end - start)[easy])
    own, found = [], []
    for i in hard.tolist():
        said = readings(words.dictionary[i].decode(), characters)
        own += [i] * len(said)
        found += said
    of_hard, hashed_hard = _features(found)
    of, hashed = np.concatenate([easy[of], np.array(own, np.int64)[of_hard]]), np.concatenate([hashed, hashed_hard])
    order = np.argsort(of, kind="stable")
    per = np.bincount(of, minlength=len(at) - 1)
    single = sums((data & 0xC0) != 0x80, at) == 1
    hashed_by_word, begin = hashed[order], np.cumsum(per) - per
    row, code = words.rows(), words.codes
    rows, found = np.repeat(row, per[code]), hashed_by_word[spread(begin[code], per[code])]
    # letters set apart by blanks: runs of three one-character words or more within a row
    alone = single[code]
    if alone.any():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], alone.astype(np.int8), [0]))))
        extra: list[tuple[int, int]] = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            for lo in np.unique(np.searchsorted(words.first, np.arange(a, b), side="right") - 1) if row[a] != row[b - 1] else (row[a],):
                x, y = max(a, words.first[lo]), min(b, words.first[lo + 1])
                if 3 <= y - x:
                    joined = "".join(words.dictionary[c].decode() for c in code[x:y])
                    extra += [(int(lo), h) for h in _spaced(joined, characters).tolist()]
        if extra:
            rows, found = np.append(rows, [e[0] for e in extra]), np.append(found, [e[1] for e in extra])
    if not len(rows):
        return rows, found
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])))
    # a feature that is seen again in its row is one more feature
    again = np.diff(np.append(np.flatnonzero(new), len(new))) > 1
    rows, found = rows[new], found[new]
    rows, found = np.append(rows, rows[again]), np.append(found, found[again] ^ AGAIN)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def character_model(docs: DataFrame) -> np.ndarray:
    """Costs of characters after each other, from the plain words of all ``docs`` (text)."""

    def count(batches):
        total = np.zeros((_EDGE + 1) ** 2, np.int64)
        for part in chunks(batches, 0):
            words = Words(part.column(0), lower=True)
            often = np.bincount(words.codes, minlength=len(words.letters[1]) - 1)
            data, at = words.letters
            plain, start, end = _plain(data, at)
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            n = np.searchsorted(begins, end) - np.searchsorted(begins, start)
            used = np.flatnonzero(plain & (n >= 2) & (n <= LONGEST))
            place = _PLACE[data[begins]]
            two = np.flatnonzero(data[begins] == _TWO)
            place[two] = _PLACE_TWO[data[begins[two] + 1]]
            first = np.searchsorted(begins, start[used])
            here = place[spread(first, n[used])]
            # an edge before each word's characters and behind them
            ends = np.cumsum(n[used])
            after = np.append(here, _EDGE)[1 : len(here) + 1]
            after[ends - 1] = _EDGE
            pair = np.concatenate([here * (_EDGE + 1) + after, _EDGE * (_EDGE + 1) + here[ends - n[used]]])
            total += np.bincount(pair, np.concatenate([np.repeat(often[used], n[used]), often[used]]), len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    pairs = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.full((_EDGE + 1) ** 2, 0.5)  # at most one row for each pair of the alphabet
    for pair, n in pairs:
        counts[pair] += n
    counts = counts.reshape(_EDGE + 1, _EDGE + 1)
    return -np.log(counts / counts.sum(axis=1, keepdims=True))


def held_out(doc: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows held out are not read for labels.

    Without labelled training rows, or without both labels among them, every text has the score of the label's share.
    """
    spark = docs.sparkSession
    ship(spark)
    characters = character_model(docs)
    sample = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("sampled"), F.col("toxic").cast("int").alias("toxic"))
    sample = sampled(docs, sample.distinct().orderBy(F.xxhash64("sampled"), "sampled", "toxic").limit(rows), rows)
    shared = spark.sparkContext.broadcast(characters)

    def spell(batches):
        for part in chunks(batches, 1):
            row, found = _spelled(Words(part.column(1)), shared.value)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found))], ["toxic", "words"])

    # the sample has at most ``rows`` rows of 12 bytes, and so many rows of ``docs`` belong to it
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("sampled")).select("toxic", "text")
    spelled = joined.mapInArrow(spell, "toxic int, words array<long>").toArrow()
    toxic = spelled.column(0).to_numpy().astype(float)
    lists = spelled.column(1).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy()
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    empty = Model(characters, np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)))
    if not 0 < toxic.sum() < len(toxic):
        return empty
    row = np.repeat(np.arange(len(toxic)), n)
    words, code = np.unique(flat, return_inverse=True)
    bad, good = np.bincount(code, toxic[row], len(words)), np.bincount(code, 1 - toxic[row], len(words))
    # log-odds of the word's share of rows, and how many deviations it is from none
    p, q = (bad + 0.5) / (toxic.sum() + 1), (good + 0.5) / (len(toxic) - toxic.sum() + 1)
    odds = np.log(p / (1 - p)) - np.log(q / (1 - q))
    z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    # words that tell: clearly (z), strongly (odds), and by what they explain together (share of toxic rows times odds)
    chosen = np.flatnonzero((bad + good >= min(LEAST_ROWS, len(toxic) // 20 + 2)) & (z > 3) & (odds > LEAST_ODDS))
    chosen = chosen[np.argsort(-(bad * odds)[chosen], kind="stable")][:LEXICON]
    if not len(chosen):
        return empty
    chosen = np.sort(chosen)
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(toxic), len(chosen) + 1))
    known = place[code] >= 0
    x[row[known], place[code[known]]] = 1
    x[:, -1] = 1
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.001)
    ridge[-1] = 1e-6
    for _ in range(60):  # Newton steps of the penalised likelihood
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x + np.diag(ridge), x.T @ (toxic - mu) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(characters, words[chosen], beta[:-1], float(beta[-1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text).

    Null and empty texts have the score of a text without telling words. A null doc_id isn't held out. Repeated rows
    each return a row, with the same score; an empty table returns none. Very long texts are scored whole, one at a
    time. Further columns of ``docs`` are not read, whatever their names. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part in chunks(batches):
            row, found = _spelled(Words(part.column(1)), model.characters)
            weight = np.zeros(len(found))
            if len(model.words):
                at = np.minimum(np.searchsorted(model.words, found), len(model.words) - 1)
                weight = np.where(model.words[at] == found, model.weights[at], 0.0)
            hits = np.bincount(row, weight, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(hits))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
