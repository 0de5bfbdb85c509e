"""Helpers that the operators of this subpackage share: written tables and checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Rows up to which a lookup table is broadcast; beyond it the large side is salted and both are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 64
#: Bytes of an Arrow batch, where the session has Spark's own bound.
BATCH_BYTES, _BATCH_BYTES, _UNSET = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, once per Spark context, through Spark's own distribution of files.

    Arrow batches are bounded by bytes from then on, so that rows of long texts don't fill a worker.
    """
    if spark.conf.get(_BATCH_BYTES) == _UNSET:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tidelog_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidelog-code-"), "tidelog_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    context._tidelog_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and Spark runs
    on this machine alone (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives lost executors: a later stage reads files instead of recomputing its ancestors.
    ``drop`` removes tables that nothing reads any more; what a returned DataFrame still reads goes at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
        atexit.register(self._forget)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _forget(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended first; the cluster's own clean-up takes the folder
            pass


def sampled(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Those of ``ids`` (sampled, further columns), in the order of a hash, whose rows in ``docs`` (doc_id) are ``rows``
    at most together. ``ids`` has at most ``rows`` rows; an id with more than what is left of ``rows`` ends the sample,
    but one that has more than ``rows`` alone is passed over."""
    held = docs.select("doc_id").join(F.broadcast(ids), F.col("doc_id") == F.col("sampled")).groupBy(*ids.columns).agg(F.count("*").alias("__n"))
    order = W.orderBy(F.xxhash64("sampled"), *ids.columns).rowsBetween(W.unboundedPreceding, 0)
    return held.where(F.col("__n") <= rows).withColumn("__sum", F.sum("__n").over(order)).where(F.col("__sum") <= rows).drop("__n", "__sum")


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` with a small ``table`` that has one row per key, null-safely.

    The table's rows are counted first. Up to ``limit`` it is broadcast; beyond, ``rows`` are salted and the table
    is repeated per salt, so that a key with a third of all rows is spread over many tasks. The salt is a hash of the
    row's plain columns: a task that is run again after a loss sends each row where it went before.
    """
    named = {k: f"__key_{i}" for i, k in enumerate(keys)}
    table = table.withColumnsRenamed(named)
    same = [rows[k].eqNullSafe(table[v]) for k, v in named.items()]
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), same, how).drop(*named.values())
    plain = [f"`{f.name}`" for f in rows.schema if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    spread = table.withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [salted[k].eqNullSafe(spread[v]) for k, v in named.items()]
    return salted.join(spread, [salted["__salt"] == spread["__salt_of"], *same], how).drop("__salt", "__salt_of", *named.values())
