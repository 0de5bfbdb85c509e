"""Document fingerprints: SpotSigs.

Wherever one or more common words stand, the next CHAIN words that aren't common form a chain; the set of a text's
chains, hashed, is its fingerprint. Boilerplate made of bare names and links has few common words, so prose decides.
A text without a chain has one signature, that of all its words.

Fingerprints are partitioned by their number of signatures, each partition reaching 1 / LEAST times as far as the one
before. Two that aren't in the same or in neighbouring partitions have a Jaccard similarity below LEAST and aren't
compared; in the rest the ratio of the numbers bounds the similarity before the sets are intersected.

Only DataFrame functions run here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHAIN = 2
#: Similarities below it count as 0.
LEAST = 0.05
#: Common words of English, French, German and Spanish, which are the anchors.
COMMON = (
    "the a an of and to in is are was be been it that this for with as on by at from or not he she they we you his her have has had will would there which their "
    "le la les un une des du de et en est dans que qui pour pas sur au aux avec ce se son sa par plus ne "
    "der die das den dem des ein eine einen und zu mit von auf ist im nicht sich auch als wie bei nach für aus dass wird "
    "el los las una del y que en por con para se su al lo como más o pero sus es"
).split()
#: Rows that are put in order at a time, and cells of the histogram of ids.
BUCKET_ROWS, CELLS = 2000, 65536

_BITS = (1 << 40) - 1


def _marked(text: Column) -> Column:
    """The words of a text in lower case, a space before and behind each, runs of common words as one #."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.regexp_replace(words, f"(?: (?:{'|'.join(sorted(set(COMMON)))})(?= ))++", " #")


def signatures(text: Column) -> Column:
    """array<bigint>: the sorted distinct signatures of a text, 40 bits each; null counts as empty."""
    marked = _marked(F.coalesce(text, F.lit("")))
    chain = "#(?= (" + "(?: #)? ".join([r"[^ #]+"] * CHAIN) + r")(?= |$))"
    found = F.transform(F.regexp_extract_all(marked, F.lit(chain), F.lit(1)), lambda c: F.xxhash64(F.replace(c, F.lit(" #"), F.lit(""))).bitwiseAND(F.lit(_BITS)))
    whole = F.array(F.xxhash64(marked).bitwiseAND(F.lit(_BITS)))
    return F.array_sort(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(whole)))


def fingerprint(found: Column) -> Column:
    """The signatures as text: ten hex digits each."""
    return F.array_join(F.transform(found, lambda s: F.lpad(F.hex(s), 10, "0")), "")


def partition(found: Column) -> Column:
    """The length partition of a set of signatures."""
    return F.floor(F.log(F.size(found).cast("double")) / math.log(1 / LEAST)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures, 0 below LEAST; pruned by partition, then by the sizes' ratio."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    jaccard = both / (n + m - both)
    apart = (F.abs(partition(a) - partition(b)) > 1) | (F.least(n, m) < F.greatest(n, m) * LEAST)
    return F.when(apart, F.lit(0.0)).when(jaccard < LEAST, F.lit(0.0)).otherwise(jaccard)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Column]:
    """``docs`` (doc_id, text) dealt so that neighbours by descending doc_id meet, and the window that orders them.

    A histogram of ids over CELLS cells cuts them into buckets of about ``bucket_rows`` rows. The first document of
    each bucket goes to the bucket before as well (the very first to the last), marked as a ``guest``. Null ids come
    last; documents of one id are ordered by a hash of their text.
    """
    span = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = (span.low or 0), (span.high or 0)
    place = (F.lit(float(high)) - F.col("doc_id").cast("double")) / F.lit(float(high) - float(low) + 1.0) * CELLS
    cell = F.when(F.col("doc_id").isNull(), F.lit(CELLS)).otherwise(F.least(place.cast("int"), F.lit(CELLS - 1)))
    # at most CELLS + 1 rows from here to the broadcast
    held = docs.select(cell.alias("cell"), "doc_id").groupBy("cell").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    before = F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    cells = held.withColumn("bucket", F.floor(before / bucket_rows).cast("int"))
    own = W.partitionBy("bucket").orderBy("cell")
    tops = cells.withColumn("nth", F.row_number().over(own)).where("nth = 1").select(F.col("bucket").alias("b"), "top")
    around = W.orderBy("b")
    tops = tops.withColumn("guest_of", F.coalesce(F.lag("b").over(around), F.max("b").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    table = cells.drop("top", "n").join(tops, F.col("bucket") == F.col("b")).select(F.col("cell").alias("c"), "bucket", "top", "guest_of")
    dealt = docs.withColumn("cell", cell).join(F.broadcast(table), F.col("cell") == F.col("c"))
    stay = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    goes = F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(stay, goes)).otherwise(F.array(stay))))
    dealt = dealt.select("doc_id", "text", F.col("to.bucket").alias("bucket"), F.col("to.guest").alias("guest")).repartition("bucket")
    return dealt, W.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the edited text and both fingerprints with their likeness, for each row of ``docs``.

    The last half of a text (rounded down) is replaced by the first characters of the next document's. Null texts
    are empty. Texts move once; their signatures are made after that. A table of one row is its own next document;
    an empty table returns no rows. Repeated rows are documents of their own, next to each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt, order = with_next(rows)
    dealt = dealt.withColumn("found", signatures(F.col("text")))
    paired = dealt.withColumns({"next_text": F.lead("text").over(order), "next_found": F.lead("found").over(order)}).where("guest = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "found", "next_found", edited.alias("edited")).withColumn("edited_found", signatures(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
        partition(F.col("found")).alias("length_partition"),
    )
