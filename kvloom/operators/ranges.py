"""Ranges of integers (both ends inclusive) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.operators.prefix_sum import scan

#: Width of the cells that make containment an equality join.
CELL = 1024


def merge(ranges: DataFrame, start: str = "s", end: str = "e") -> DataFrame:
    """(s, e): overlapping and touching ranges made one.

    A range begins an island where it lies beyond the reach of all before it; an
    island is known by its start. Reach and start are prefix scans, islands an
    aggregation with map-side combining: no step has all ranges, or a long
    island, in one task.
    """
    r = ranges.select(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).filter("s <= e")
    r = r.groupBy("s").agg(F.max("e").alias("e"))
    span = int(r.agg(F.max(F.abs("s"))).first()[0] or 0)
    r = scan(r, [], "s", {"reach": ("max", F.col("e"))}, exclusive=True, span=span)
    begins = F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1)
    r = scan(r.withColumn("begins", F.when(begins, F.col("s"))), [], "s", {"island": ("max", F.col("begins"))}, span=span)
    return r.groupBy("island").agg(F.max("e").alias("e")).select(F.col("island").alias("s"), "e")


def coverage(ranges: DataFrame) -> DataFrame:
    """(n_ranges, covered) of merged ranges."""
    return ranges.agg(F.count("*").alias("n_ranges"), F.coalesce(F.sum(F.col("e") - F.col("s") + 1), F.lit(0)).alias("covered"))


def contained(points: DataFrame, ranges: DataFrame, point: str) -> DataFrame:
    """points with a column inside: whether a merged range holds the point. Ranges meet points by cell, never in a nested loop."""
    cells = F.explode(F.sequence(F.floor(F.col("s") / CELL), F.floor(F.col("e") / CELL)))
    r = ranges.select("s", "e", cells.alias("__cell"))
    p = points.withColumn("__cell", F.floor(F.col(point) / CELL))
    met = p.join(r, (p["__cell"] == r["__cell"]) & F.col(point).between(F.col("s"), F.col("e")), "left")
    return met.withColumn("inside", F.col("s").isNotNull()).drop("__cell", "s", "e")
