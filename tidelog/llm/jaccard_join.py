"""N-gram Jaccard self-join: universe partition and pigeonhole, verified exactly.

A document's set holds its distinct word shingles, as 64-bit hashes. Sets of sizes a and c whose Jaccard similarity is
at least t differ in at most (1 - t) / (1 + t) * (a + c) shingles. For each band of sizes the universe of shingles is
cut by a hash into one segment more than sets of that band may differ in, so two linked sets have the same subset in at
least one of the first ``differ + 1`` segments. A set takes part in its own band and in those above that partners reach.

Which signatures stand for a segment is allocated by cost. The dear subsets are those without a rare shingle: the
empty one, which every set may have, and those of shingles that very many documents hold.

* 1 for an ordinary segment: its subset is indexed.
* 0 for a dear one: it isn't indexed.
* 2 for the first segments, as many as it takes to hold a segment of two rare shingles for each dear one: there the
  one-deletion neighbourhood is indexed as well, which two subsets share that differ in one shingle.

Nothing is lost by that: if all d segments that two linked sets have in common are dear, the others differ in one
shingle each but for at most d - 1, so among d segments with two rare shingles one differs in just one shingle. A set
that has no such segments within the reach of its smallest partner is poor: it has neighbourhoods in all segments, and
its dear subsets are indexed apart, where only poor sets meet.

Equal sets are one class from the start. Then every set is compared with that member of its groups that has most
company in all of its own; what is in one component afterwards needs no further pair. Pairs that would still join
components are made group by group, large groups in blocks, and dropped within the join where parity bitmaps (512 bits,
one flipped by each shingle) differ in more bits than linked sets can differ in shingles. What is left is verified with
whole sets. Texts are not shuffled: a bit table of the ids that are needed, of bounded size, picks the rows whose sets
are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm._common import Scratch, ship
from tidelog.llm._text import LOWER, U64, chunks, hashes, mix, raw, spans, spread, sums
from tidelog.llm.components import components

SHINGLE, PERCENT = 5, 80
#: A shingle is counted where this many different sets of a chunk hold it, and is common from this sum on.
LOCAL_COUNT, COMMON = 2, 256
#: At most so many shingles count as common, those with the largest sums. Further ones cost candidates, not links.
COMMON_MOST = 1 << 17
#: The sizes of a band reach 1.25 times as far as those of the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, BANDS[-1] * 5 // 4))
#: Longs of a parity bitmap; bits of the table of needed ids: sixteen for each id, from 2 ** 20 up to 2 ** 26.
BITMAP, LEAST_BITS, MOST_BITS = 8, 20, 26
#: Members of a group that are compared in one block; a larger group is cut, and each pair of blocks stands apart.
BLOCK = 256
#: Rows for which bitmaps are made at once; rows of a batch of signatures; sets that a task remembers as seen.
_ROWS, _BATCH, _SEEN = 2048, 100_000, 1 << 20
_A, _SEG, _NEAR, _POOR = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, one row after another, and where each row starts (and the end).

    Fewer than k words make one shingle, no words none; a null has no words.
    """
    data, at = raw(column)
    data = LOWER[data]
    _, starts, lengths, first = spans(data, at)
    words = hashes(data, starts, lengths)
    n = np.diff(first)
    rolled = np.zeros(max(0, len(words) - k + 1), U64)
    for i in range(k):
        rolled = rolled * _A + words[i : i + len(rolled)]
    rolled = mix(rolled)
    held = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    base = np.concatenate((np.zeros(1, np.int64), np.cumsum(held)))
    flat = np.empty(base[-1], U64)
    long, short = np.flatnonzero(n >= k), np.flatnonzero((n > 0) & (n < k))
    flat[spread(base[long], held[long])] = rolled[spread(first[long], held[long])]
    few = n[short].astype(U64)
    for i in range(k - 1):
        own = n[short] > i
        few[own] = few[own] * _A + words[first[short][own] + i] + U64(1)
    flat[base[short]] = mix(few)
    ends = base.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 1:
            flat[a:b].sort()
    kept = np.ones(len(flat), bool)
    kept[1:] = flat[1:] != flat[:-1]
    kept[base[:-1][held > 0]] = True
    return flat[kept], np.concatenate((np.zeros(1, np.int64), np.cumsum(sums(kept, base))))


def _totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of unsigned ``values`` by row, modulo 2 ** 64."""
    upto = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return upto[at[1:]] - upto[at[:-1]]


def differ(both: np.ndarray | int, percent: int):
    """In how many shingles two linked sets of ``both`` shingles together may differ."""
    return both * (100 - percent) // (100 + percent)


def signatures(flat: np.ndarray, at: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets; linked sets that aren't equal share one at least. ``common`` is sorted."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    mixed, place = mix(flat), mix(flat ^ _SEG) >> U64(32)
    rare = np.ones(len(flat), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] != flat
    lows = np.array(BANDS[: int(np.searchsorted(BANDS, max(1, n.max(initial=1)) * 100 // percent, side="right")) + 1])
    own, most = np.searchsorted(lows, n, side="right") - 1, n * 100 // percent
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for up in range(len(lows)):
        band = np.minimum(own + up, len(lows) - 2)
        low, high = lows[band], lows[band + 1] - 1
        segments = differ(2 * high, percent) + 1
        live = (n > 0) & (own + up <= len(lows) - 2) & (low <= most)
        if not live.any():
            break
        live &= segments > 1  # else only equal sets link
        # the segments that the largest and the smallest partner within the band ask for
        need = np.where(live, np.minimum(segments, differ(n + np.maximum(n, np.minimum(most, high)), percent) + 1), 0)
        sure = differ(n + (low if up else -(-percent * n // 100)), percent) + 1
        base = np.concatenate((np.zeros(1, np.int64), np.cumsum(need)))
        segment = ((place * segments[row].astype(U64)) >> U64(32)).astype(np.int64)
        inside = np.flatnonzero(segment < need[row])
        slot, token, seldom = base[row[inside]] + segment[inside], mixed[inside], rare[inside]
        total, n_rare = np.zeros(base[-1], U64), np.bincount(slot[seldom], minlength=base[-1])
        np.add.at(total, slot, token)
        of = np.repeat(np.arange(len(n)), need)
        nth = np.arange(base[-1]) - base[of]
        salt = mix((band[of].astype(U64) << U64(40)) + nth.astype(U64))
        dear = n_rare == 0
        found.append((mix(total ^ salt)[~dear], of[~dear]))
        n_dear = sums(dear, base)
        # the least number of first segments that hold a rich one for each dear one
        upto = np.cumsum(n_rare >= 2)
        upto -= np.concatenate((np.zeros(1, np.int64), upto))[base[of]]
        reach = np.minimum(sums(upto < n_dear[of], base) + 1, need)
        poor = (n_dear > 0) & ((reach > sure) | (sums((upto >= n_dear[of]), base) == 0))
        reach = np.where(n_dear == 0, 0, np.where(poor, need, reach))
        near = nth < reach[of]
        held = near & ~dear
        found.append((mix(total ^ salt ^ _NEAR)[held], of[held]))
        less = np.flatnonzero(near[slot] & (n_rare[slot] > seldom))
        found.append((mix((total[slot[less]] - token[less]) ^ salt[slot[less]] ^ _NEAR), of[slot[less]]))
        apart = dear & poor[of]
        found.append((mix(total ^ salt ^ _POOR)[apart], of[apart]))
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def bitmaps(flat: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The longs of each row's parity bitmap."""
    out = np.empty((len(at) - 1, BITMAP), np.int64)
    for a in range(0, len(out), _ROWS):
        b = min(a + _ROWS, len(out))
        row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        bit = (flat[at[a] : at[b]] & U64(64 * BITMAP - 1)).astype(np.int64)
        parity = (np.bincount(row * (64 * BITMAP) + bit, minlength=(b - a) * 64 * BITMAP) & 1).astype(np.uint8)
        out[a:b] = np.packbits(parity).view(np.int64).reshape(b - a, BITMAP)
    return list(out.T.copy())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


MAPS = [f"m{i}" for i in range(BITMAP)]
MEASURED = "doc_id long, n long, hi long, lo long, " + ", ".join(f"{m} long" for m in MAPS)


def measured(docs: DataFrame, k: int, least: int = LOCAL_COUNT) -> DataFrame:
    """A row of MEASURED for each row of ``docs``: size, hashes and bitmap of its set; and, for each chunk of texts, the
    shingles (``shingle``, ``count``) that ``least`` of its different sets or more hold."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches):
        seen: set[int] = set()
        for part in chunks(batches):
            flat, at = shingle_sets(part.column(1), k)
            hi, lo = _totals(mix(flat ^ _SEG), at), _totals(mix(flat), at)
            rows, none = part.num_rows, pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (np.diff(at), _signed(hi), _signed(lo), *bitmaps(flat, at))), none, none], [*names, "shingle", "count"])
            new = np.zeros(rows, bool)
            for i, own in enumerate(lo.tolist()):  # copies within the partition count once
                if own not in seen:
                    new[i] = True
                    seen.add(own)
            if len(seen) > _SEEN:
                seen.clear()
            every = np.sort(flat[np.repeat(new, np.diff(at))])
            starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(starts, len(every)))
            often = count >= least
            if often.any():
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([*[none] * len(names), pa.array(_signed(every[starts[often]])), pa.array(count[often])], [*names, "shingle", "count"])

    return docs.mapInArrow(run, f"{MEASURED}, shingle long, count long")


def common_shingles(counted: DataFrame, least: int = COMMON, most: int = COMMON_MOST) -> np.ndarray:
    """The most common shingles, sorted. Every document takes part; in a chunk of texts where a shingle stands in a
    single set it isn't counted, so what falls below the bound are shingles of less than one document in a chunk."""
    often = counted.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    top = often.orderBy(F.desc("count"), "shingle").limit(most).toPandas()  # at most ``most`` rows of 16 bytes
    return np.sort(np.ascontiguousarray(top["shingle"].to_numpy(np.int64)).view(U64))


def signed(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """(sig, doc_id): the signatures of the sets of ``docs``; of equal sets in a partition the first has them."""
    shared = docs.sparkSession.sparkContext.broadcast((percent, common))

    def run(batches):
        percent, common = shared.value
        seen: set[tuple[int, int]] = set()
        for part in chunks(batches):
            flat, at = shingle_sets(part.column(1), k)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            keep = np.zeros(part.num_rows, bool)
            for i, own in enumerate(zip(np.diff(at).tolist(), _totals(mix(flat), at).tolist(), strict=True)):
                if known[i] and own[0] and own not in seen:
                    keep[i] = True
                    seen.add(own)
            if len(seen) > _SEEN:
                seen.clear()
            doc = part.column(0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)
            n = np.diff(at)
            flat, at = flat[np.repeat(keep, n)], np.concatenate((np.zeros(1, np.int64), np.cumsum(n[keep])))
            # blocks of rows, so that memory follows the text and not the number of signatures
            sig, row = signatures(flat, at, percent, common)
            for a in range(0, len(sig), _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(sig[a : a + _BATCH])), pa.array(doc[row[a : a + _BATCH]])], ["sig", "doc_id"])

    return docs.mapInArrow(run, "sig long, doc_id long")


def jaccard_classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, common_least: int = COMMON, common_most: int = COMMON_MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; further columns are ignored).

    Null and empty texts, and texts without words, have empty sets, which link with nothing. Repeated rows each
    return a row. A null doc_id has no links and its own null component. Ids that occur with several texts are one
    document whose links are those of all its texts. Very long texts are sets like others; a chunk holds one at least.
    An empty table returns no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.table(measured(docs, k), "measured")
    rows = every.where("shingle is null").drop("shingle", "count")
    common = common_shingles(every, common_least, common_most)

    filled = rows.where("n > 0 and doc_id is not null")
    # an id with several sets is a node of its own, whose bitmap can't be used; other ids stand with their set's first
    nodes = filled.groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), ((F.min("hi") != F.max("hi")) | (F.min("lo") != F.max("lo"))).alias("several"), *[F.first(m).alias(m) for m in MAPS])
    nodes = scratch.table(nodes, "nodes")
    firsts = filled.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.count("*").alias("held")).where("held > 1").drop("held")
    copies = filled.select("doc_id", "hi", "lo").join(firsts, ["hi", "lo"]).where("doc_id <> node").select("doc_id", "node").distinct()
    copies = scratch.table(copies.join(nodes.select("doc_id", "several"), "doc_id"), "copies")

    w = W.partitionBy("sig")
    held = signed(docs, k, percent, common).withColumns({"least": F.min("doc_id").over(w), "most": F.max("doc_id").over(w)}).where("least <> most").select("sig", "doc_id")
    held = scratch.table(held, "held")
    members = held.join(copies.where("not several").select("doc_id", "node"), "doc_id", "left").select("sig", F.coalesce("node", "doc_id").alias("node"))
    members = members.repartition("sig").distinct().withColumns({"least": F.min("node").over(w), "most": F.max("node").over(w), "size": F.count("*").over(w)}).where("least <> most")
    members = scratch.table(members.select("sig", "node", "size"), "members")
    scratch.drop("held")

    # each set with one leader of its groups: the member that has most company over all of its signatures
    company = scratch.table(members.groupBy("node").agg(F.sum("size").alias("company")), "company")
    leaders = members.join(company, "node").groupBy("sig").agg(F.max(F.struct("company", "node")).alias("top")).select("sig", F.col("top.node").alias("leader"))
    pairs = members.join(leaders, "sig").where("node <> leader").groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("n"))
    info = F.struct("doc_id", "low", "high", "several", *MAPS)
    for side in "ba":
        pairs = pairs.join(nodes.select(F.col("doc_id").alias(f"{side}_id"), info.alias(f"{side}_info")), F.col(side) == F.col(f"{side}_id"))
    pairs = pairs.where(_close(F.col("a_info"), F.col("b_info"), percent)).join(company, F.col("b") == F.col("node"))
    pairs = pairs.groupBy("a").agg(F.max(F.struct("company", "n", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    tried = _verified(docs, pairs, k, percent, scratch, "led")
    links = tried.where("linked").select("a", "b").unionAll(copies.where("several").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    state = scratch.table(components(links, scratch, "c-led"), "state")

    # every other pair that would join two components
    open_ = members.join(state, F.col("node") == F.col("id"), "left").select("sig", "node", "size", F.coalesce("component", "node").alias("component"))
    open_ = open_.withColumns({"least": F.min("component").over(w), "most": F.max("component").over(w)}).where("least <> most").drop("least", "most")
    open_ = open_.join(nodes, F.col("node") == F.col("doc_id")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_ = open_.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    open_ = open_.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.struct("doc_id", "component", "own", "low", "high", "several", *MAPS).alias("a"))
    open_ = scratch.table(open_, "open")
    scratch.drop("members")
    two = open_.withColumnsRenamed({"sig": "sig_b", "x": "x_b", "y": "y_b", "a": "b"})
    # members of one block meet in that block's own pair only
    fresh = F.expr("a.doc_id < b.doc_id and a.component <> b.component and (x = y or a.own <> b.own)")
    pairs = open_.join(two, F.expr("sig = sig_b and x = x_b and y = y_b") & fresh & _close(F.col("a"), F.col("b"), percent))
    pairs = pairs.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    old = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = _verified(docs, pairs.join(old, ["a", "b"], "left_anti"), k, percent, scratch, "rest")
    scratch.drop("open")
    left, right = (state.select(F.col("id").alias(f"{s}_id"), F.col("component").alias(f"{s}_of")) for s in "ab")
    joins = found.where("linked").join(left, F.col("a") == F.col("a_id"), "left").join(right, F.col("b") == F.col("b_id"), "left")
    joined = components(joins.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")), scratch, "c-rest")
    joined = joined.select(F.col("id").alias("of"), F.col("component").alias("whole"))

    # a row's node is its own id or, for a copy, its set's first; components of nodes, and then of components
    of = rows.select("doc_id", F.col("n").alias("n_shingles"))
    of = of.join(copies.where("not several").select(F.col("doc_id").alias("copy"), "node"), F.col("doc_id") == F.col("copy"), "left").withColumn("node", F.coalesce("node", "doc_id"))
    of = of.join(state, F.col("node") == F.col("id"), "left").withColumn("component", F.coalesce("component", "node"))
    of = of.join(joined, F.col("component") == F.col("of"), "left")
    return of.select("doc_id", "n_shingles", F.coalesce("whole", "component").alias("component_id"))


def _close(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and bitmaps of two nodes allow a link."""
    sizes = (100 * a["high"] >= percent * b["low"]) & (100 * b["high"] >= percent * a["low"])
    flipped = sum((F.bit_count(a[m].bitwiseXOR(b[m])) for m in MAPS[1:]), F.bit_count(a[MAPS[0]].bitwiseXOR(b[MAPS[0]])))
    may = F.floor((a["high"] + b["high"]) * (100 - percent) / (100 + percent))
    return sizes & (a["several"] | b["several"] | (flipped <= may))


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, linked) of ``pairs`` (a, b), each with its whole sets."""
    pairs = scratch.table(pairs, f"{name}-pairs")
    texts = _needed(docs, pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))))

    def sets(batches):
        for part in chunks(batches):
            flat, at = shingle_sets(part.column(1), k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.LargeListArray.from_arrays(pa.array(at), pa.array(_signed(flat))).cast(pa.list_(pa.int64()))], ["doc_id", "set"])

    known = scratch.table(texts.mapInArrow(sets, "doc_id long, set array<long>"), f"{name}-sets")
    a, b = (known.select(F.col("doc_id").alias(f"{x}_id"), F.col("set").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(b, F.col("b") == F.col("b_id")).join(a, F.col("a") == F.col("a_id"))
    shared, total = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    judged = both.select("a", "b", shared.alias("shared"), total.alias("total")).select("a", "b", (F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).alias("linked"))
    out = scratch.table(judged, f"{name}-verified")
    scratch.drop(f"{name}-sets")
    return out


def _flagged(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``__in``: whether ``key`` is in ``ids`` (id), true for a few others as well; ``rows`` aren't shuffled.

    Each id sets one bit of a table of 2 ** bits; the table goes to the tasks in words of 64 bits, of which there are
    at most 2 ** (MOST_BITS - 6). A fuller table is true for more rows and false for none of the ids.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    at = place(F.col("id"))
    words = ids.select(at.alias("at")).selectExpr("cast(shiftright(at, 6) as int) __word", "shiftleft(1L, cast(at & 63 as int)) bit")
    words = words.groupBy("__word").agg(F.bit_or("bit").alias("__held"))
    marked = rows.withColumn("__at", place(F.col(key)))
    marked = marked.join(F.broadcast(words), F.shiftright("__at", 6).cast("int") == F.col("__word"), "left")
    return marked.withColumn("__in", F.coalesce(F.expr("(__held & shiftleft(1L, cast(__at & 63 as int))) <> 0"), F.lit(False)) & F.col(key).isNotNull())


def parted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` is surely not in ``ids`` (id), and those where it may be."""
    marked = _flagged(rows, key, ids)
    return marked.where("not __in"), marked.where("__in")


def _needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose doc_id is in ``ids`` (id), and a few more."""
    return _flagged(docs, "doc_id", ids).where("__in").select("doc_id", "text")
