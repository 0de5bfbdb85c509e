"""Connected components of a graph given as an edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b); component is the smallest id that links reach.

    Each round every vertex points to its smallest neighbour (itself, if that is smaller), chains of pointers are
    shortened by doubling, and edges are redrawn between the vertices pointed to. The number of vertices that are
    left at least halves in each round, so rounds grow with the logarithm of the input. Every round's tables are
    written to the shared folder; nothing but emptiness tests reaches the driver. Null ids have no links.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    left = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    labels: DataFrame | None = None
    k = 0
    while not left.isEmpty():
        points = left.select(F.col("b").alias("id"), F.col("a").alias("to")).unionAll(left.select(F.col("a").alias("id"), F.col("a").alias("to")))
        flat = scratch.table(points.groupBy("id").agg(F.min("to").alias("to")), f"{name}-flat-{k}-0")
        jump = 0
        while True:
            up = flat.where("id <> to").select(F.col("id").alias("up_id"), F.col("to").alias("up_to"))
            moved = flat.join(up, F.col("to") == F.col("up_id"), "left").select("id", F.coalesce("up_to", "to").alias("to"), F.col("up_to").isNotNull().alias("moved"))
            jump += 1
            moved = scratch.table(moved, f"{name}-flat-{k}-{jump}")
            scratch.drop(f"{name}-flat-{k}-{jump - 1}")
            flat = moved.select("id", "to")
            if moved.where("moved").isEmpty():
                break
        a, b = (flat.select(F.col("id").alias(f"{x}_id"), F.col("to").alias(f"{x}_to")) for x in "ab")
        redrawn = left.join(a, F.col("a") == F.col("a_id")).join(b, F.col("b") == F.col("b_id")).where("a_to <> b_to")
        redrawn = redrawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        if labels is None:
            labels = flat
        else:
            step = flat.select(F.col("id").alias("step_id"), F.col("to").alias("step_to"))
            labels = labels.join(step, F.col("to") == F.col("step_id"), "left").select("id", F.coalesce("step_to", "to").alias("to"))
            labels = scratch.table(labels, f"{name}-labels-{k}")
        k += 1
        left = scratch.table(redrawn, f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}")
    if labels is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select("id", F.col("to").alias("component"))
