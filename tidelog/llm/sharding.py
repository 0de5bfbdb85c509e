"""Sharding: histogram sort.

Rows are ordered by a key made of a hash of the text and a hash of the id, so equal texts stand together, and cut
into shards of near equal bytes: the shard of a row is the number of splitters at or below its key. A splitter is the
least key below which there are at least its share of all bytes. It is found by counting exact bytes below candidate
boundaries over all partitions: first 4096 even ones, then, within each interval that still holds a splitter (or too
many rows to be numbered in one task), 256 more, until every splitter is exact or its interval weighs no more than
the tolerance. Then rows are exchanged once, by interval, which also numbers them within their shard.

Only DataFrame functions run here. The driver sees counts of intervals: 4096, and 256 for each one that is refined,
which are at most the splitters and the total of rows over ROWS, capped by ``MOST_REFINED`` per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm._common import Scratch

SHARDS, OVERHEAD = 40, 16
#: Bits of a key: of the text's hash, and of the id's. The first round cuts by the top FIRST bits, later ones by STEP.
TEXT_BITS, ID_BITS, FIRST, STEP = 40, 23, 12, 8
BITS = TEXT_BITS + ID_BITS
#: Rows that one task may number, at least; the share of all rows that makes it more.
ROWS, MOST_REFINED = 2000, 1024


def key_of(text: Column, doc: Column) -> Column:
    """A key of 63 bits: equal texts share the upper 40, whatever their ids."""
    upper = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, TEXT_BITS // 4), 16, 10).cast("long")
    lower = F.xxhash64(doc).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return F.shiftleft(upper, ID_BITS).bitwiseOR(lower)


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and text_crc32 of each row; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        key_of(F.col("text"), F.col("doc_id").cast("long")).alias("key"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def _counted(rows: DataFrame, bits: int) -> list[tuple[int, int, int]]:
    """(prefix, bytes, rows) of the intervals of keys with the same upper ``bits``."""
    prefix = F.shiftright("key", BITS - bits)
    found = rows.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return [tuple(r) for r in found.collect()]


def intervals(rows: DataFrame, shards: int = SHARDS, tolerance: int = 0, most_rows: int = ROWS) -> list[dict]:
    """The intervals of keys, in order: ``start``, bits, bytes, n, and the ``shard`` that all of its rows go to."""
    first = [{"start": p << (BITS - FIRST), "bits": FIRST, "bytes": b, "n": n} for p, b, n in _counted(rows, FIRST)]
    found, total = sorted(first, key=lambda x: x["start"]), sum(x["bytes"] for x in first)
    most_rows = max(most_rows, sum(x["n"] for x in first) // MOST_REFINED)
    while True:
        below, todo = 0, []
        for x in found:
            x["below"] = below
            # rows of an interval get one shard only if no splitter lies inside: that of the bytes before its first
            # key and that of the bytes before its last differ otherwise
            ahead = below + x["bytes"] - 1
            cut = min(shards - 1, below * shards // total) != min(shards - 1, ahead * shards // total) if total else False
            if x["bits"] < BITS and (cut and x["bytes"] > max(1, tolerance) and x["n"] > 1 or x["n"] > most_rows):
                todo.append(x)
            below += x["bytes"]
        if not todo:
            break
        finer: dict[int, list] = {}
        for bits in {x["bits"] for x in todo}:
            own = [x for x in todo if x["bits"] == bits]
            step = min(bits + STEP, BITS)
            held = rows.where(F.shiftright("key", BITS - bits).isin([x["start"] >> (BITS - bits) for x in own]))
            for p, b, n in _counted(held, step):
                finer.setdefault((p >> (step - bits)) << (BITS - bits), []).append({"start": p << (BITS - step), "bits": step, "bytes": b, "n": n})
        kept = {x["start"] for x in todo}
        found = sorted([x for x in found if x["start"] not in kept] + [y for ys in finer.values() for y in ys], key=lambda x: x["start"])
    for x in found:
        # within the tolerance a whole interval goes where the larger part of it belongs
        x["shard"] = min(shards - 1, (x["below"] + (x["bytes"] // 2 if tolerance else 0)) * shards // total) if total else 0
    return found


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs`` (doc_id, text), sizes near equal.

    Null texts count as empty; null ids take part like others; repeated rows and rows with equal keys are never put
    apart by a splitter. An empty table returns no rows. With fewer rows than shards some stay empty.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.table(slim(docs), "slim")
    found = intervals(rows, shards, tolerance)
    spark = docs.sparkSession
    offset: dict[int, int] = {}
    by: dict[int, list] = {}
    for i, x in enumerate(found):
        by.setdefault(x["start"] >> (BITS - FIRST), []).append((x["start"], i, x["shard"], offset.get(x["shard"], 0)))
        offset[x["shard"]] = offset.get(x["shard"], 0) + x["n"]
    parts = "array<struct<start:long,interval:int,shard:int,before:long>>"
    table = spark.createDataFrame(list(by.items()), f"top int, parts {parts}")  # 4096 rows at most
    placed = rows.withColumn("top", F.shiftright("key", BITS - FIRST).cast("int")).join(F.broadcast(table), "top")
    # the last interval of its cell that starts at or below the key
    own = F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.element_at(F.filter("parts", lambda p: p["start"] <= F.col("key")), -1))
    placed = placed.withColumn("at", own).select("doc_id", "key", "size", "text_crc32", "at.interval", "at.shard", "at.before")
    order = W.partitionBy("interval").orderBy("key", F.asc_nulls_first("doc_id"), "text_crc32", "size")
    return placed.withColumn("slot", (F.col("before") + F.row_number().over(order) - 1).cast("long")).select("doc_id", "size", "text_crc32", "shard", "slot")
