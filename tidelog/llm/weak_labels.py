"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers each vote good, bad or nothing on a text. What they vote together is counted over all documents,
and expectation-maximisation estimates from those counts the share of good texts and each labeller's accuracy, class
by class. Every pattern of votes then has a posterior, and posterior labels train a logistic scorer over hashed
features of the text, which also tells apart texts that no labeller votes on.

The patterns are at most 3 to the number of labellers, so the counts are small whatever the input. The scorer is
fitted on a bounded sample, TRAIN_ROWS rows by the least hash of their ids (an id with more rows than that is not
sampled).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import sampled, ship
from tidelog.llm._text import Words, chunks, spread, sums

#: Rows that the scorer is fitted on at most, and its hashed features.
TRAIN_ROWS, FEATURES = 8000, 1 << 14
THRESHOLD = 0.5
#: (name, measure, bad below, bad above, good from, good to, the most of the good texts that it may call bad); bounds
#: that don't apply are None. Signs, tables, shouting and stutter beyond these bounds aren't prose, so few good texts
#: may have them; how often the other labellers err is left to the votes. A short text is no bad one.
LABELLERS: tuple[tuple[str, str, float | None, float | None, float, float, float], ...] = (
    ("length", "words", None, None, 50, 1e9, 1.0),
    ("symbols", "symbol_share", None, 0.10, 0.0, 0.01, 0.002),
    ("bars", "bar_share", None, 0.15, 0.0, 0.01, 0.002),
    ("capitals", "capital_share", None, 0.40, 0.0, 0.20, 0.002),
    ("repeats", "repeat_share", None, 0.30, 0.0, 0.05, 0.002),
    ("variety", "distinct_share", 0.20, None, 0.35, 1.0, 1.0),
    ("exclamations", "exclamation_share", None, 0.20, 0.0, 0.05, 0.002),
    ("word length", "mean_length", 2.5, 12.0, 3.5, 9.0, 1.0),
    ("stops", "stop_share", 0.004, None, 0.02, 1.0, 1.0),
)
NAMES = tuple(x[0] for x in LABELLERS)
#: How often a labeller sees the kind of badness that it alone sees.
SEEN = 0.9
FALSE_ALARMS = np.array([x[6] for x in LABELLERS])


def measures(words: Words) -> dict[str, np.ndarray]:
    """What the labellers look at, for each row."""
    n = np.maximum(words.n, 1)
    size = np.fromiter(map(len, words.dictionary), np.int64, len(words.dictionary))
    counted = {
        "symbol": np.fromiter((sum(w.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) for w in words.dictionary), np.int64, len(size)),
        "bar": np.fromiter((w == b"|" for w in words.dictionary), np.int64, len(size)),
        "capital": np.fromiter((w.isupper() and len(w) > 1 for w in words.dictionary), np.int64, len(size)),
        "exclamation": np.fromiter((b"!" in w for w in words.dictionary), np.int64, len(size)),
        "stop": np.fromiter((w[-1:] in b".!?" and len(w) > 1 for w in words.dictionary), np.int64, len(size)),
    }
    row, code = words.rows(), words.codes.astype(np.int64)
    out = {f"{k}_share": sums(v[code], words.first) / n for k, v in counted.items()}
    again = np.concatenate(([False], (code[1:] == code[:-1]) & (row[1:] == row[:-1]))) if len(code) else np.zeros(0, bool)
    pairs = np.unique(row * max(1, len(size)) + code)
    out |= {
        "words": words.n.astype(float),
        "mean_length": sums(size[code], words.first) / n,
        "repeat_share": sums(again.astype(np.int64), words.first) / n,
        # texts of more than 400 words repeat common ones anyway
        "distinct_share": np.bincount(pairs // max(1, len(size)), minlength=len(n)) / np.minimum(n, 400),
    }
    out["distinct_share"] = np.minimum(out["distinct_share"], 1.0)
    return out


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each labeller: 0 nothing, 1 good, 2 bad."""
    out = []
    for _, name, low, high, good, to, _ in LABELLERS:
        x = found[name]
        bad = np.zeros(len(x), bool)
        if low is not None:
            bad |= x < low
        if high is not None:
            bad |= x > high
        out.append(np.where(bad, 2, np.where((x >= good) & (x <= to), 1, 0)))
    return np.stack(out, axis=1)


def patterns(cast: np.ndarray) -> np.ndarray:
    return cast @ (3 ** np.arange(cast.shape[1]))


@dataclass
class LabelModel:
    """``shares`` of the classes and their ``chances`` [class, labeller, vote]. Class 0 is bad in general, 1 is good;
    further ones are bad in a way of their own, which one labeller sees and all others take for good."""

    shares: np.ndarray
    chances: np.ndarray

    @property
    def good(self) -> float:
        return float(self.shares[1])

    def classes(self, cast: np.ndarray) -> np.ndarray:
        """The posterior of each class for each row of votes."""
        at = np.arange(cast.shape[1])
        logs = np.stack([np.log(x[at, cast]).sum(axis=1) for x in self.chances], axis=1) + np.log(self.shares)
        top = np.exp(logs - logs.max(axis=1, keepdims=True))
        return top / top.sum(axis=1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        return self.classes(cast)[:, 1]

    def accuracies(self) -> dict[str, float]:
        """How often each labeller's votes are right."""
        bad = np.arange(len(self.shares)) != 1
        right = np.where(bad[:, None], self.chances[:, :, 2], self.chances[:, :, 1])
        voted = self.chances[:, :, 1] + self.chances[:, :, 2]
        return dict(zip(NAMES, ((self.shares @ right) / (self.shares @ voted)).tolist(), strict=True))


def expectation_maximisation(cast: np.ndarray, count: np.ndarray, rounds: int = 200, false_alarms: np.ndarray | float = 1.0) -> LabelModel:
    """The label model of vote patterns ``cast`` seen ``count`` times each.

    It starts from labellers that hardly ever call a good text bad. With ``false_alarms`` below 1 (see LABELLERS) a
    labeller has a class of bad texts that it alone sees: there it votes bad SEEN of the time, and all others vote as
    on good texts. Without such classes, kinds of badness that don't meet in one text can't be told from errors.
    """
    k = cast.shape[1]
    most = np.broadcast_to(np.asarray(false_alarms, float), (k,))
    alone = np.flatnonzero(most < 1)
    common = np.tile(np.array([[0.2, 0.6, 0.2], [0.2, 0.79, 0.01]])[:, None, :], (1, k, 1))
    shares = np.array([0.2, 0.8, *[0.01] * len(alone)])

    def model() -> LabelModel:
        kinds = np.repeat(common[1:], len(alone), axis=0)
        kinds[np.arange(len(alone)), alone] = [(1 - SEEN) / 2, (1 - SEEN) / 2, SEEN]
        return LabelModel(shares / shares.sum(), np.concatenate([common, kinds]))

    for _ in range(rounds):
        weight = model().classes(cast) * count[:, None]
        new = np.empty_like(common)
        for c in (0, 1):
            # on good texts and on those with a badness that another labeller sees, a labeller votes alike
            own = np.repeat(weight[:, [c]], k, axis=1)
            if c == 1:
                own += weight[:, 2:].sum(axis=1, keepdims=True)
                own[:, alone] -= weight[:, 2:]
            for v in range(3):
                # a few imagined rows, of votes that are right, keep the classes' names in place
                new[c, :, v] = (own * (cast == v)).sum(axis=0) + (2.0 if v == 2 - c else 0.5)
            new[c] /= new[c].sum(axis=1, keepdims=True)
        bad = np.minimum(new[1, :, 2], most)
        new[1, :, :2] *= ((1 - bad) / (1 - new[1, :, 2]))[:, None]
        new[1, :, 2] = bad
        held = weight.sum(axis=0) / count.sum()
        held = np.concatenate([np.clip(held[:2], 0.001, 0.999), np.maximum(held[2:], 1e-9)])
        moved = max(np.abs(held - shares).max(), np.abs(new - common).max())
        common, shares = new, held
        if moved < 1e-7:
            break
    return model()


def _shape(word: bytes) -> str:
    """Capitals, letters, digits and signs of a word, runs shortened."""
    out = []
    for c in word.decode():
        kind = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


def features(words: Words, found: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight): hashed shapes and pairs of shapes, by root of their share, and levels of the measures."""
    shapes = [_shape(w) for w in words.dictionary]
    own = np.fromiter((xxhash.xxh3_64_intdigest(s.encode()) & 0x7FFFFFFF for s in shapes), np.int64, len(shapes))
    row, code = words.rows(), words.codes
    one = own[code]
    same = row[1:] == row[:-1]
    two = ((one[:-1] * 31 + one[1:]) & 0x7FFFFFFF)[same]
    keys = np.concatenate([row * size + one % size, row[1:][same] * size + two % size])
    key, n = np.unique(keys, return_counts=True)
    rows = key // size
    weight = np.sqrt(n / np.maximum(words.n[rows], 1))
    levels_row, levels = [], []
    for name, x in found.items():
        level = np.floor(np.log2(np.maximum(x, 1e-4)) * 2).astype(np.int64)
        levels_row.append(np.arange(len(x)))
        levels.append(np.fromiter((xxhash.xxh3_64_intdigest(f"{name}:{v}".encode()) % size for v in level.tolist()), np.int64, len(level)))
    return np.concatenate([rows, *levels_row]), np.concatenate([key % size, *levels]), np.concatenate([weight, np.full(sum(map(len, levels)), 0.5)])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, rows: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(row, weight * self.weights[feature], rows) + self.bias, -30, 30)))


def train(rows: int, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, target: np.ndarray, size: int, rounds: int = 300) -> Scorer:
    """A logistic scorer for soft targets: gradient steps, scaled by each feature's own past (AdaGrad), with decay."""
    weights, bias, past, past_bias = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        error = Scorer(weights, bias).score(rows, row, feature, weight) - target
        step = np.bincount(feature, weight * error[row], size) / max(rows, 1) + 1e-5 * weights
        past, past_bias = past + step**2, past_bias + error.mean() ** 2
        weights, bias = weights - 0.5 * step / np.sqrt(past), bias - 0.5 * error.mean() / np.sqrt(past_bias)
    return Scorer(weights, float(bias))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = FEATURES) -> tuple[LabelModel, Scorer]:
    """Both models from ``docs`` (doc_id, text). An empty table gives models that call everything good."""
    ship(docs.sparkSession)

    def count(batches):
        for part in chunks(batches, 0):
            own, n = np.unique(patterns(votes(measures(Words(part.column(0))))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    # at most 3 to the number of labellers
    seen = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    k = len(LABELLERS)
    if not seen:
        return LabelModel(np.array([0.01, 0.99]), np.full((2, k, 3), 1 / 3)), Scorer(np.zeros(size), 5.0)
    cast = np.array([r.pattern for r in seen])[:, None] // 3 ** np.arange(k) % 3
    model = expectation_maximisation(cast, np.array([r.n for r in seen], float), false_alarms=FALSE_ALARMS)

    ids = docs.select(F.col("doc_id").alias("sampled")).where("sampled is not null").distinct().orderBy(F.xxhash64("sampled"), "sampled").limit(rows)
    sample = sampled(docs, ids, rows)

    def describe(batches):
        for part in chunks(batches, 0):
            words = Words(part.column(0))
            found = measures(words)
            row, feature, weight = features(words, found, size)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order].astype(t))) for x, t in ((feature, np.int32), (weight, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(patterns(votes(found)), pa.int64()), *lists], ["pattern", "feature", "weight"])

    # ``rows`` ids at most are broadcast, and as many rows are described
    told = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("sampled")).select("text")
    told = told.mapInArrow(describe, "pattern long, feature array<int>, weight array<float>").toArrow()
    target = model.posterior(told.column(0).to_numpy()[:, None] // 3 ** np.arange(k) % 3) if told.num_rows else np.zeros(0)
    lists = told.column(1).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    feature = lists.flatten().to_numpy().astype(np.int64)
    weight = told.column(2).combine_chunks()
    weight = (weight.combine_chunks() if isinstance(weight, pa.ChunkedArray) else weight).flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(told.num_rows), np.diff(lists.offsets.to_numpy())) if told.num_rows else np.zeros(0, np.int64)
    return model, train(told.num_rows, row, feature, weight, target, size)


def score(docs: DataFrame, label_model: LabelModel, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, votes, weak_label, score and kept for each row of ``docs`` (doc_id, text).

    ``votes`` has a character for each labeller (- nothing, g good, b bad), ``weak_label`` is the posterior of good,
    ``score`` the scorer's. Null and empty texts are scored as texts without words. Repeated rows each return a row,
    with the same score; an empty table returns none. Very long texts are measured whole, one at a time. Further
    columns of ``docs`` are not read, whatever their names. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    size = len(scorer.weights)
    shared = docs.sparkSession.sparkContext.broadcast((label_model, scorer))
    letters = np.array(list("-gb"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        label_model, scorer = shared.value
        for part in chunks(batches):
            words = Words(part.column(1))
            found = measures(words)
            cast = votes(found)
            given = scorer.score(part.num_rows, *features(words, found, size))
            shown = ["".join(x) for x in letters[cast]]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown, pa.string()), pa.array(label_model.posterior(cast)), pa.array(given)], ["doc_id", "votes", "weak_label", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)
