"""The segment catalogue: names, lookup by offset, sizes, garbage collection, rotation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.functions.constants import LOG_SIZE
from kvloom.operators.prefix_sum import scan
from kvloom.sources.shared import written

SNAPSHOT, LOG = "rdb", "aof"


def segment_name(kind: Column, offset: Column, size: Column) -> Column:
    return F.when(kind == SNAPSHOT, F.concat_ws("", offset.cast("string"), F.lit("_"), size.cast("string"), F.lit(".rdb"))).otherwise(
        F.concat(offset.cast("string"), F.lit(".aof"))
    )


def parse_name(name: Column) -> tuple[Column, Column, Column]:
    """(kind, offset, size) of a file name; all null for other names."""
    rdb, aof = name.rlike(r"^\d+_\d+\.rdb$"), name.rlike(r"^\d+\.aof$")
    number = lambda i: F.regexp_extract(name, r"^(\d+)(?:_(\d+))?\.", i).try_cast("long")
    kind = F.when(rdb, SNAPSHOT).when(aof, LOG)
    return kind, F.when(rdb | aof, number(1)), F.when(rdb, number(2))


def catalogue(files: DataFrame) -> DataFrame:
    """(run_id, kind, offset, size, created_at, path) of files (path, length, modificationTime) under base/{run_id}/; other names are skipped."""
    name = F.element_at(F.split("path", "/"), -1)
    kind, offset, size = parse_name(name)
    rows = files.select(
        F.element_at(F.split("path", "/"), -2).alias("run_id"), kind.alias("kind"), offset.alias("offset"),
        F.coalesce(size, F.col("length")).alias("size"), F.col("modificationTime").alias("created_at"), "path",
    )
    return rows.filter(F.col("kind").isNotNull() & F.col("offset").isNotNull()).orderBy("run_id", "offset")


def read_catalogue(spark, base: str) -> DataFrame:
    return catalogue(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).drop("content"))


def _holding(points: DataFrame, ranges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """points (by, o) joined with all ranges (by, lo, hi, more columns) that hold o: lo <= o < hi.

    A range goes to the cells of its own level, the least power of two that is
    not smaller: two cells at most, however long it is. Points look at each
    level that occurs, of which there are 64 at most.
    """
    # The digits of size - 1 in base two: integers only, so that any offset is exact.
    size = F.col("hi") - F.col("lo")
    level = F.when(size == 1, 0).otherwise(F.length(F.bin(size - 1)))
    r = ranges.filter("hi > lo").withColumn("level", level)
    levels = [x["level"] for x in r.select("level").distinct().collect()]  # 64 at most
    cell = lambda o: F.call_function("shiftright", o, F.col("level"))
    r = r.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("lo")), cell(F.col("hi") - 1)))))
    p = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("cell", cell(F.col("o")))
    return p.join(r, [*by, "level", "cell"]).filter((F.col("lo") <= F.col("o")) & (F.col("o") < F.col("hi"))).drop("level", "cell")


def _last_start(points: DataFrame, starts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """points (by, o) with start: the greatest of starts (by, at) that is not above o; points below all of them are left out.

    As-of join without a nested loop: points and starts are merged in order, and
    the last start is carried along by a prefix scan.
    """
    none = F.lit(None).cast("long")
    s = starts.select(*by, "at", F.col("at").alias("given"), none.alias("o")).distinct()
    p = points.select(*by, F.col("o").alias("at"), none.alias("given"), "o").distinct()
    span = int(s.select("at").union(p.select("at")).agg(F.max(F.abs("at"))).first()[0] or 0)
    filled = scan(s.unionByName(p), list(by), "at", {"start": ("max", F.col("given"))}, tie=(F.col("given").asc_nulls_last(),), span=span)
    return filled.filter("o IS NOT NULL AND start IS NOT NULL").select(*by, "o", "start")


def _snapshot_ranges(segments: DataFrame) -> DataFrame:
    rows = segments.filter(F.col("kind") == SNAPSHOT)
    return rows.select("run_id", "offset", "size", F.col("offset").alias("lo"), (F.col("offset") + F.col("size")).alias("hi"))


def _logs(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("kind") == LOG).groupBy("run_id", "offset").agg(F.max("size").alias("size"))


def find_snapshot(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """(run_id, o, offset, size): for each probe the snapshot with offset <= o < offset + size, the lowest if several."""
    met = _holding(probes.select("run_id", "o"), _snapshot_ranges(segments), ("run_id",))
    first = met.groupBy("run_id", "o").agg(F.min_by(F.struct("offset", "size"), "offset").alias("s"))
    return first.select("run_id", "o", "s.offset", "s.size")


def find_log(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """(run_id, o, offset): for each probe the log segment with the greatest offset <= o."""
    starts = segments.filter(F.col("kind") == LOG).select("run_id", F.col("offset").alias("at"))
    return _last_start(probes, starts, ("run_id",)).withColumnRenamed("start", "offset")


def resolve_reader(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """(o, run_id, kind, offset, size): by run ids in order, a snapshot that holds o, else the log segment before it; the first run that has one.

    A run's logs answer for every o from its first log on. The first run that
    answers for o is thus the last step before o of a staircase: runs whose
    first log lies below those of all runs before them.
    """
    # Both are used several times, and may be dear to make.
    segments, points = written(segments, "catalogue"), written(probes.select("o").distinct(), "points")
    snap = _holding(points, _snapshot_ranges(segments)).select("o", "run_id", F.lit(SNAPSHOT).alias("kind"), "offset", "size", F.lit(0).alias("rank"))
    logs = _logs(segments)
    # One row for each run; a step ends where that of an earlier run begins.
    begins = logs.groupBy("run_id").agg(F.min("offset").alias("lo"))
    lower = F.min("lo").over(Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1))
    steps = begins.withColumn("hi", F.coalesce(lower, F.lit((1 << 63) - 1))).filter("lo < hi")
    at = _holding(points, steps).select("run_id", "o")
    log = find_log(at, segments).join(logs, ["run_id", "offset"]).select("o", "run_id", F.lit(LOG).alias("kind"), "offset", "size", F.lit(1).alias("rank"))
    best = snap.union(log).groupBy("o").agg(F.min(F.struct("run_id", "rank", "kind", "offset", "size")).alias("b"))
    return best.select("o", "b.run_id", "b.kind", "b.offset", "b.size")


def available(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """(o, run_id, kind, n_available): bytes that can be read from o on, in the first run that has any; 0 and no run where none has.

    A run has bytes at o if a snapshot holds o, or if the last log segment that
    begins at o or before it also ends after o.
    """
    points = probes.select("o").distinct()
    following = F.lead("offset").over(Window.partitionBy("run_id").orderBy("offset"))
    logs = _logs(segments).withColumn("end", F.col("offset") + F.col("size"))
    logs = logs.withColumn("hi", F.coalesce(F.least("end", following), "end"))
    snaps = _snapshot_ranges(segments)
    ranges = snaps.select("run_id", F.lit(0).alias("rank"), F.lit(SNAPSHOT).alias("kind"), "lo", "hi", F.col("hi").alias("end")).union(
        logs.select("run_id", F.lit(1), F.lit(LOG), "offset", "hi", "end")
    )
    best = _holding(points, ranges).groupBy("o").agg(F.min(F.struct("run_id", "rank", "lo", "kind", "end")).alias("b"))
    found = best.select("o", "b.run_id", "b.kind", (F.col("b.end") - F.col("o")).alias("n_available"))
    return points.join(found, "o", "left").select("o", "run_id", "kind", F.coalesce("n_available", F.lit(0)).alias("n_available"))


def latest(segments: DataFrame) -> DataFrame:
    """(run_id, kind, offset, size) of the last segment of each run and kind."""
    return segments.groupBy("run_id", "kind").agg(F.max_by(F.struct("offset", "size"), "offset").alias("s")).select("run_id", "kind", "s.offset", "s.size")


def run_ids(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("kind") == SNAPSHOT).select("run_id").union(segments.filter(F.col("kind") == LOG).select("run_id")).distinct()


def sizes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


def victims(segments: DataFrame, limit: int) -> DataFrame:
    """Segments to delete so that the store fits: oldest first, never the newest log of a run, until the excess is gone.

    The running sum goes over the catalogue, one row for each file.
    """
    newest = F.row_number().over(Window.partitionBy("run_id", "kind").orderBy(F.desc("offset"))) == 1
    excess = F.sum("size").over(Window.partitionBy(F.lit(0))) - F.lit(limit)
    s = segments.withColumn("newest", newest).withColumn("excess", excess)
    s = s.filter(~(F.col("newest") & (F.col("kind") == LOG)))
    before = Window.orderBy("created_at", "run_id", "kind", "offset").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return s.filter((F.col("excess") > 0) & (F.col("before") < F.col("excess"))).drop("newest", "excess", "before")


def rotate(writes: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """(run_id, seq, seg): start offset of the segment that each write goes to.

    A write that finds log_size bytes or more in the current segment begins a
    new one. The cut depends on all cuts before it, so each run is one stream;
    rows pass in order through a generator that holds one batch, not the run.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, start, at = None, 0, 0
        for b in batches:
            segs = []
            for r, size in zip(b["run_id"], b["size"], strict=True):
                if r != run:
                    run, start, at = r, 0, 0
                elif at - start >= log_size:
                    start = at
                segs.append(start)
                at += int(size)
            yield pd.DataFrame({"run_id": b["run_id"], "seq": b["seq"], "seg": segs})

    rows = writes.select("run_id", "seq", "size").repartition("run_id").sortWithinPartitions("run_id", "seq")
    return rows.mapInPandas(cut, "run_id string, seq long, seg long")


def cadence(events: DataFrame, every_ms: int) -> DataFrame:
    """(run_id, seq, at_ms): events at which a periodic save happens: the first, then each that comes every_ms or more after the last save."""
    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, None
        for b in batches:
            keep = []
            for r, ms in zip(b["run_id"], b["at_ms"], strict=True):
                due = r != run or ms - last >= every_ms
                if due:
                    run, last = r, ms
                keep.append(due)
            yield b[keep]

    rows = events.select("run_id", "seq", "at_ms").repartition("run_id").sortWithinPartitions("run_id", "at_ms", "seq")
    return rows.mapInPandas(save, "run_id string, seq long, at_ms long")
