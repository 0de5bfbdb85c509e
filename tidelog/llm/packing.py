"""Packing: vector bin packing with the dot-product heuristic.

Examples go into sequences under three limits at once: tokens, segments (pieces) and loss-bearing tokens. An example
longer than a sequence gives whole sequences first; what remains waits in a pool. A sequence is filled by the pool's
piece that fits and whose vector of demands has the largest dot product with the vector of what is left of the
limits, each in shares of its limit. Where nothing fits, a piece is cut. A sequence that still ends well short is cut
back to a power of two, which needs no padding, and the rest returns to the pool.

The pool belongs to one partition and holds POOL pieces at most before it is packed, so memory is bounded and nothing
is shuffled. The same input partition always gives the same sequences, so a recomputed task repeats its result.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import ship
from tidelog.llm._text import chunks, raw, spread, sums

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that wait before they are packed.
POOL = 4096
#: Bytes of text that are encoded at once; bytes of a part above which it goes through the tokenizer itself.
ENCODED_BYTES, LONG_PART = 2 << 20, 512
#: The shortest piece that a cut leaves in a sequence, and padding that is not worth a cut.
LEAST_CUT, PADDING = 16, 24
#: White space of ASCII, and lead bytes of white space beyond it (and of much else).
_BLANK, _LEAD2, _LEAD3 = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]], _LEAD2[0xC2], _LEAD3[[0xE1, 0xE2, 0xE3]] = True, True, True
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    """Most tokens, pieces and loss-bearing tokens of a sequence. The limit on loss is a
    thirty-second below the one on tokens, so no sequence is cut from the inside of one long document alone; prompts
    are a tenth of typical tokens, so sequences can still be filled."""

    tokens: int = 1024
    segments: int = 16
    loss: int = 992

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be 1 or more")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the vocabulary's byte-level pre-tokeniser cuts a text, in the words of the second encoder.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_LOADED: dict = {}


@dataclass(frozen=True)
class Encoder:
    """A vocabulary's tokenizer, and for ordinary parts of text a faster encoder with the same ids, if there is one."""

    tokenizer: object
    fast: object | None
    size: np.ndarray  # bytes of each id
    special: tuple[bytes, ...]


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _LOADED[path] = Encoder(tokenizer, *_fast(spec), tuple(x["content"].encode() for x in spec.get("added_tokens", [])))
    return _LOADED[path]


def _fast(spec: dict) -> tuple[object | None, np.ndarray]:
    """The second encoder for a byte-level BPE whose merges are in the order of their ids; else None."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    order = [model["vocab"].get(a + b, -1) for a, b in merges]
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    if not plain or not order or order[0] < 256 or any(x >= y for x, y in zip(order, order[1:])):
        return None, np.zeros(0, np.int64)
    import tiktoken

    # the printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    added = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
    size = np.zeros(max(model["vocab"].values()) + 1, np.int64)
    size[list(ranks.values())] = [len(w) for w in ranks]
    return tiktoken.Encoding("parts", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), size


def _one_by_one(tokenizer, parts: list[bytes]) -> list[list[int]]:
    out: list[list[int]] = []
    for at in range(0, len(parts), 20_000):
        out += [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in parts[at : at + 20_000]], add_special_tokens=False)]
    return out


def _encoded(data: np.ndarray, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct parts (their bytes and where each starts) one after another, and how many each has."""
    own, n = encoder(path), len(at) - 1
    length = np.diff(at)
    ordinary = np.zeros(n, bool)
    if own.fast is not None and len(data):
        # led by one blank and ended by another sign, so that parts side by side are cut where they meet
        first, second, last = data[at[:-1]], data[np.minimum(at[:-1] + 1, len(data) - 1)], data[at[1:] - 1]
        ordinary = (length >= 2) & (length <= LONG_PART) & ((first == 32) | (first == 10)) & ~(_BLANK | _LEAD2 | _LEAD3)[second] & ~_BLANK[last]
        ordinary &= ~(_LEAD2[data[at[1:] - 2]] | ((length >= 3) & _LEAD3[data[np.maximum(at[1:] - 3, 0)]]))
        whole = data.tobytes()
        for mark in own.special:
            k = whole.find(mark)
            while k >= 0:
                ordinary[np.searchsorted(at, k, side="right") - 1] = False
                k = whole.find(mark, k + 1)
    others = np.flatnonzero(~ordinary)
    raw_parts = [data[a:b].tobytes() for a, b in zip(at[others].tolist(), at[others + 1].tolist(), strict=True)]
    found = _one_by_one(own.tokenizer, raw_parts)
    per = np.zeros(n, np.int64)
    per[others] = [len(x) for x in found]
    if ordinary.any():
        text = data[np.repeat(ordinary, length)].tobytes().decode()
        ids = np.asarray(own.fast.encode_to_numpy(text, disallowed_special=())).astype(np.int32)
        ends = np.cumsum(own.size[ids])
        upto = np.searchsorted(ends, np.cumsum(length[ordinary])) + 1
        per[ordinary] = np.diff(np.concatenate((np.zeros(1, np.int64), upto)))
    flat, begin = np.empty(int(per.sum()), np.int32), np.cumsum(per) - per
    if ordinary.any():
        flat[spread(begin[ordinary], per[ordinary])] = ids
    for i, x in zip(others.tolist(), found, strict=True):
        flat[begin[i] : begin[i] + len(x)] = x
    return flat, per


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts (null: empty) one after another, and how many each has, without an end id.

    The vocabulary's pre-tokeniser never joins a blank with what precedes it, so a text can be cut before any single
    space or line break that stands between other characters. Each distinct part of a batch is encoded once.
    """
    data, at = raw(texts)
    n = len(data)
    cut = (data == 32) | (data == 10)
    odd = _BLANK[data]
    cut[1:] &= ~odd[:-1]
    cut[:-1] &= ~(odd | _LEAD3[data] | _LEAD2[data])[1:]
    cut[2:] &= ~_LEAD2[data[:-2]]
    cut[3:] &= ~_LEAD3[data[:-3]]
    if n:
        cut[-1] = False
    filled = at[:-1][np.diff(at) > 0]
    ends = at[1:][np.diff(at) > 0] - 1
    cut[ends] = False  # a blank that ends a text may belong to a run
    cut[filled] = True
    starts = np.flatnonzero(cut)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, n).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = units.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    flat, per = _encoded(*raw(coded.dictionary), path)
    begin = np.cumsum(per) - per
    return flat[spread(begin[codes], per[codes])], sums(per[codes], np.searchsorted(starts, at))


class Packer:
    """Fills sequences from pieces (key, start, ids, prompt): ``prompt`` of the example's tokens bear no loss."""

    def __init__(self, limits: Limits, emit):
        self.limits, self.emit, self.pool, self.sequence = limits, emit, [], 0

    def _loss(self, start: int, end: int, prompt: int) -> int:
        return max(0, end - max(start, prompt))

    def _most(self, piece, tokens: int, loss: int) -> int:
        """How long a prefix of the piece fits."""
        key, start, ids, prompt = piece
        free = max(0, min(prompt, start + len(ids)) - start)
        return min(tokens, len(ids), free + loss)

    def add(self, key, ids: np.ndarray, prompt: int) -> None:
        start, full = 0, self.limits.tokens
        while len(ids) - start >= full and self._most((key, start, ids[start:], prompt), full, self.limits.loss) == full:
            self._close([(key, start, ids[start : start + full], prompt)])
            start += full
        while len(ids) - start > full:  # the limit on loss cuts shorter
            n = self._most((key, start, ids[start:], prompt), full, self.limits.loss)
            self.pool.append((key, start, ids[start : start + n], prompt))
            start += n
        if start < len(ids):
            self.pool.append((key, start, ids[start:], prompt))
        if len(self.pool) >= POOL:
            self.flush(last=False)

    def _close(self, pieces: list) -> None:
        offset = 0
        for k, (key, start, ids, prompt) in enumerate(pieces):
            self.emit(key, start, ids, self.sequence, offset, k, self._loss(start, start + len(ids), prompt))
            offset += len(ids)
        self.sequence += 1

    def flush(self, last: bool = True) -> None:
        """Pack the pool; unless it is the last, the pieces of an unfinished sequence stay in it."""
        limits = self.limits
        pool, self.pool = self.pool, []
        groups: dict[tuple[int, int], list] = {}

        def put(piece):
            key, start, ids, prompt = piece
            groups.setdefault((len(ids), self._loss(start, start + len(ids), prompt)), []).append(piece)

        for piece in pool:
            put(piece)
        kinds = sorted(groups)
        tokens, loss = (np.array([k[i] for k in kinds], np.int64) for i in (0, 1))
        left = np.array([len(groups[k]) for k in kinds], np.int64)
        t_share, s_share, l_share = tokens / limits.tokens**2, 1 / limits.segments**2, loss / limits.loss**2
        at = {k: i for i, k in enumerate(kinds)}

        def back(piece):  # a cut leaves a piece of a kind that may be new
            nonlocal tokens, loss, left, t_share, l_share
            key, start, ids, prompt = piece
            kind = (len(ids), self._loss(start, start + len(ids), prompt))
            if kind not in at:
                at[kind] = len(kinds)
                kinds.append(kind)
                groups[kind] = []
                tokens, loss, left = np.append(tokens, kind[0]), np.append(loss, kind[1]), np.append(left, 0)
                t_share, l_share = tokens / limits.tokens**2, loss / limits.loss**2
            groups[kind].append(piece)
            left[at[kind]] += 1

        while left.any():
            r_t, r_s, r_l, pieces = limits.tokens, limits.segments, limits.loss, []
            while r_t and r_s:
                fits = (left > 0) & (tokens <= r_t) & (loss <= r_l)
                score = np.where(fits, t_share * r_t + s_share * r_s + l_share * r_l, -1.0)
                best = int(score.argmax()) if len(score) else 0
                if fits.any():
                    piece = groups[kinds[best]].pop()
                    left[best] -= 1
                elif r_t > PADDING and left.any():
                    # the kind of which most fits: a prompt bears no loss
                    able = np.where(left > 0, np.minimum(np.minimum(tokens, r_t), tokens - loss + r_l), -1)
                    long = int(able.argmax())
                    piece, n = groups[kinds[long]][-1], int(able[long])
                    if n < LEAST_CUT or n >= tokens[long]:
                        break
                    groups[kinds[long]].pop()
                    left[long] -= 1
                    key, start, ids, prompt = piece
                    back((key, start + n, ids[n:], prompt))
                    piece = (key, start, ids[:n], prompt)
                else:
                    break
                pieces.append(piece)
                key, start, ids, prompt = piece
                r_t, r_s, r_l = r_t - len(ids), r_s - 1, r_l - self._loss(start, start + len(ids), prompt)
            filled = limits.tokens - r_t
            if not last and not left.any() and r_t > PADDING:
                self.pool = pieces
                return
            if r_t > PADDING and filled & (filled - 1):
                keep, short = 1 << (filled.bit_length() - 1), []
                for key, start, ids, prompt in pieces:
                    n = min(keep, len(ids))
                    keep -= n
                    if n:
                        short.append((key, start, ids[:n], prompt))
                    if n < len(ids):
                        back((key, start + n, ids[n:], prompt))
                pieces = short
            self._close(pieces)


def pack(docs: DataFrame, limits: Limits = Limits(), prompt_share: int = 8, prompt_most: int = 64, vocabulary_path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text): SCHEMA, and ``ids`` if asked for.

    A document is its ids and ``end_id``; null texts are empty. The first ids, one in ``prompt_share`` and at most
    ``prompt_most``, are its prompt, which bears no loss. Repeated rows, and rows without a doc_id, are documents of
    their own. Very long texts give whole sequences as they are read. An empty table gives no pieces.
    """
    ship(docs.sparkSession)
    path = vocabulary_path or vocabulary()

    def run(batches):
        rows: list[tuple] = []
        first = TaskContext.get().partitionId() << 32

        def emit(key, start, ids, sequence, offset, segment, loss):
            kept = np.ascontiguousarray(ids, "<u4")
            rows.append((key[0], start, len(ids), zlib.crc32(kept), key[1], first + sequence, offset, segment, loss, kept))

        def full(least):
            if len(rows) > least:
                columns = list(zip(*rows, strict=True))
                rows.clear()
                arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.int32()), pa.array(columns[8], pa.int64())]
                if with_ids:
                    n = np.fromiter(map(len, columns[9]), np.int32, len(columns[9]))
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(columns[9]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

        packer = Packer(limits, emit)
        for part in chunks(batches, most=ENCODED_BYTES):
            flat, n = encode(part.column(1), path)
            at = np.cumsum(n) - n
            for doc, a, k in zip(part.column(0).to_pylist(), at.tolist(), n.tolist(), strict=True):
                ids = np.append(flat[a : a + k], np.int32(end_id))
                packer.add((doc, k + 1), ids, min(prompt_most, (k + 1) // prompt_share))
                yield from full(20_000)
        packer.flush()
        yield from full(0)

    schema = SCHEMA + ", ids array<int>" * with_ids
    names = [x.strip().split()[0] for x in schema.split(",")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
