"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

The stages, in order: quality rules, n-gram Jaccard join, secret scans, mixing to target weights, packing. Each works
on all rows that its predecessor kept, in its own operator of ``tidelog.llm``; all but the last return the columns
that they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import fertility, jaccard_join, mixing, packing, secret_scan
from tidelog.llm._common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rule or their language's fertility bands reject."""
    return fertility.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row with the smallest id; of equal rows with one id, one.

    Rows are compared, not ids: each row gets a key, written beside it so that every later read sees the same one. A
    null id comes after all others. Texts without words have no near duplicates, only equal rows. Texts aren't
    shuffled, but for those whose key may be among the dropped ones by a bit table.
    """
    row = "__row" + "_" * sum(c.startswith("__row") for c in docs.columns)
    scratch = Scratch(spark, "rows")
    keyed = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    found = jaccard_join.jaccard_classes(keyed.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("of"), F.col("component_id").alias("component"))
    # what tells rows without words apart; for other rows the component does
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    bare = F.when(~worded, F.struct("doc_id", F.sha2("text", 256).alias("text")))
    rows = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"), bare.alias("bare")).join(found, F.col("row") == F.col("of"))
    rows = scratch.table(rows.select("row", "id", "bare", F.when(F.col("bare").isNull(), F.col("component")).alias("component")), "groups")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    keep = rows.groupBy("component", "bare").agg(first.alias("first")).select(F.col("first.row").alias("keep"))
    dropped = scratch.table(rows.join(keep, F.col("row") == F.col("keep"), "left_anti").select(F.col("row").alias("id")), "dropped")
    sure, maybe = jaccard_join.parted(keyed, row, dropped)
    maybe = maybe.join(dropped.withColumnRenamed("id", "__dropped"), F.col(row) == F.col("__dropped"), "left_anti")
    return sure.select(*_all(docs)).unionAll(maybe.select(*_all(docs)))


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Overwrites every secret's characters with asterisks; the texts keep their length, and all documents stay."""
    return secret_scan.cleaned(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it: the budget is all tokens, two epochs at most."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources", mixing_sources),
    ("packing", packed),
]
#: The stages tokenise with public vocabularies, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; what the stages write stays in the shared folder until the session ends."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
