"""Vectors as rows and matrices, and the choice of the best of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.common import quoted


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector array<double>, dim): rows with an id and a non-empty vector of finite components."""
    inf = F.lit(float("inf"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    rows = df.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad).withColumn("dim", F.size("vector"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def distinct_rows(ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Places of the rows that can be among the first keep - 1 results of any query other than themselves.

    Rows that repeat id and vector count once. Of equal vectors only the keep
    smallest ids can rank, as ties go to the smaller id.
    """
    _, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.lexsort((ids, of))
    new_vector = np.append(True, of[order][1:] != of[order][:-1])
    new_row = new_vector | np.append(True, ids[order][1:] != ids[order][:-1])
    order, new_vector = order[new_row], new_vector[new_row]
    starts = np.flatnonzero(new_vector)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[rank < keep])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), score: str = "score") -> DataFrame:
    """found with rank: the k highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
