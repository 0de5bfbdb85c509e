"""License scans: ordered signature rules with a keyword prefilter and interval-containment suppression.

A text is reduced to its words (digits, ASCII letters in lower case, and everything beyond ASCII) joined by single
spaces. One search for the keywords of all rules decides which patterns are tried. Detections are taken by priority,
then by the longer and the earlier one; a detection whose words lie inside those of one already taken is suppressed.
The base phrases are counted wherever they stand and their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import ship
from tidelog.llm._text import chunks, raw
from tidelog.llm.license_rules import BASE, Rule, compiled, rules

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:int,end:int,priority:int,score:double>>"

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = [(re.compile(rb"(?<![^ ])(?=" + p.encode() + rb"(?![^ ]))"), label, p.split()[0].encode()) for p, label in BASE]


class Scanner:
    def __init__(self, found: list[Rule]):
        self.rules = compiled(found)
        names = {k for _, _, keywords in self.rules for k in keywords}
        # a keyword counts where a word begins with it
        self.prefilter = re.compile(rb"(?<![^ ])(?:" + b"|".join(sorted(names, key=lambda k: (-len(k), k))) + rb")")
        self.by: dict[bytes, list[int]] = {}
        for i, (_, _, keywords) in enumerate(self.rules):
            for k in keywords:
                self.by.setdefault(k, []).append(i)

    def detect(self, text: bytes) -> list[tuple[int, int, Rule]]:
        """(first word, end word, rule) of what stays after suppression, for normalised text."""
        present = set(self.prefilter.findall(text))
        if not present:
            return []
        hits = []
        for i in sorted({i for k in present for i in self.by[k]}):
            rule, pattern, _ = self.rules[i]
            hits += [(m.start(), m.end(), rule) for m in pattern.finditer(text)]
        hits.sort(key=lambda h: (-h[2].priority, h[0] - h[1], h[0]))
        taken: list[tuple[int, int, Rule]] = []
        # kept in order of their starts for the containment test, so many detections stay fast
        spans: list[tuple[int, int]] = []
        widest = 0
        for a, b, rule in hits:
            at, inside = bisect_right(spans, (a, 1 << 62)), False
            while at and not inside and spans[at - 1][0] >= b - widest:
                inside = spans[at - 1][1] >= b
                at -= 1
            if not inside:
                insort(spans, (a, b))
                widest = max(widest, b - a)
                taken.append((a, b, rule))
        taken.sort(key=lambda h: h[:2])
        out, at, words = [], 0, 0
        for a, b, rule in taken:
            words += text.count(b" ", at, a)
            at = a
            out.append((words, words + text.count(b" ", a, b) + 1, rule))
        return out


def _base(text: bytes) -> tuple[int, int | None, int | None, set[str]]:
    n, first, last, labels = 0, None, None, set()
    for pattern, label, _ in _BASE:
        for m in pattern.finditer(text):
            word = m.start()
            n, first, last = n + 1, word if first is None else min(first, word), word if last is None else max(last, word)
            labels.add(label)
    if n:
        first, last = text.count(b" ", 0, first), text.count(b" ", 0, last)
    return n, first, last, labels


def scan(docs: DataFrame, found: list[Rule] | None = None, with_detections: bool = False) -> DataFrame:
    """doc_id and the columns of SCHEMA for each row of ``docs`` (doc_id, text).

    Words count from 0. ``score`` is the chance that some detection holds, taking them as independent; base phrases
    count as notices. Null and empty texts have no words, null first and last words, empty labels and a score of 0.
    Repeated rows each return a row; an empty table returns none. Nothing is shuffled.
    """
    ship(docs.sparkSession)
    found = rules() if found is None else found

    def run(batches):
        scanner = Scanner(found)
        for part in chunks(batches):
            data, at = raw(part.column(1))
            plain, at = data.tobytes().translate(_TABLE), at.tolist()
            columns: list[list] = [[] for _ in range(7 + with_detections)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                words = plain[a:b].split()
                text = b" ".join(words)
                n, first, last, labels = _base(text)
                hits = scanner.detect(text)
                miss = np.prod([1 - h[2].score for h in hits] + [0.05] * bool(n))
                row = [len(words), n, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | {h[2].label for h in hits})), float(1 - miss)]
                if with_detections:
                    row.append([{"label": r.label, "start": x, "end": y, "priority": r.priority, "score": r.score} for x, y, r in hits])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            if with_detections:
                types.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    schema = "doc_id long, " + (SCHEMA if with_detections else SCHEMA.partition(", detections")[0])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] + ["detections"] * with_detections
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
