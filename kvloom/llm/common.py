"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.sources.shared import shared_folder

#: ASCII white space, the separators of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The C library's way to return free memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_folder(spark, kind)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, kind)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: 128 bits, so that equal pairs mean equal strings at any corpus size."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and what one task held should not count against the next stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, then give_back()."""

    def then_give_back(batches):
        yield from run(batches)
        give_back()

    return then_give_back


def each_batch(fn: Callable) -> Callable[[Iterator], Iterator]:
    """fn maps one Arrow batch to one Arrow batch."""
    return tidy(lambda batches: map(fn, batches))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows evenly before a step that costs much more CPU than reading: input files need not be cut evenly."""
    return df.repartition(shuffle_partitions(df.sparkSession), *cols)
