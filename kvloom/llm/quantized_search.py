"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are scaled to length 1. What they differ by from the nearest of some
hundred cell centres is turned by a fixed rotation, scaled to length 1 and cut
into pairs of components; each pair is coded by one of 16 centroids, four bits.
What the codes leave is scaled and coded again, STAGES times in all, so codes
are as fine inside a tight cluster as in a wide one, on any rows. Codes and
centroids minimise a loss that weighs the residual parallel to the coded vector
``eta`` times as much as the rest, since that part moves the largest inner
products. A query makes a table of 16 partial products for each pair and adds
table entries over the codes of all rows, in blocks, each stage times its
scale, to its product with the row's centre and the centre's with what no code
holds: what is missing is of the order of the distance from query to centre
times that rest. The RERANK rows of the highest sums, over all blocks together
(more in large tables), are scored exactly, from the original vectors in double precision.

Codes stay where they are: queries come to them by broadcast, QUERY_ROWS at a
time. A block first gives each query its share of the highest sums, twice what
it would hold on average. Blocks whose last one given still stands above the
bound that follows from all of them are searched again, for what is above that
bound: rows out of blocks are a small multiple of the reranked ones, and none of
those is missed.

The codebook is fitted on a bounded sample (``MAX_TRAIN`` rows, the smallest by
a hash of their id). Every row is coded and scanned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.llm.blocks import best, matrix, ranked, usable
from kvloom.llm.common import materialize, scratch_dir, shuffle_partitions, table, tidy

MAX_TRAIN = 10_000
CENTROIDS = 16
PAIR = 2
#: Products above this cosine matter; sets eta.
THRESHOLD = 0.2
ROUNDS, PASSES = 8, 2
#: Times that what is left of a vector is coded; cells at most, and rows of the sample for each; rounds that move their centres.
STAGES, CELLS, CELL_ROWS, CELL_ROUNDS = 2, 512, 16, 4
#: Rows of the sample that codebooks are fitted on; cells take all of it.
BOOK_ROWS = 4000
#: Components that are turned together.
TURNED = 256
K = 5
#: Candidates of a query that are scored exactly, of the whole table: this many, or the square root of the rows where that is more.
RERANK = 64
#: Codes of a block, and those up to which blocks are made smaller so that all tasks have some; queries of a broadcast.
BLOCK_ROWS, LEAST_ROWS, QUERY_ROWS = 65_536, 4096, 8192


class Codebook:
    def __init__(self, dim: int, sample: np.ndarray):
        self.dim = dim
        self.parts = -(-dim // PAIR)
        self.eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        x = self._cut(sample)
        rng = np.random.default_rng(7)
        pick = rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
        self.centers = x[pick].transpose(1, 0, 2).copy()  # part, centroid, component
        codes = self._nearest(x)
        for _ in range(ROUNDS):
            codes = self._assign(x, codes, 1)
            self._update(x, codes)

    def _cut(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        padded = np.zeros((len(unit), self.parts * PAIR))
        padded[:, : self.dim] = unit
        return padded.reshape(len(unit), self.parts, PAIR)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((x[:, p, None] - self.centers[p]) ** 2).sum(axis=2).argmin(axis=1) for p in range(self.parts)], axis=1)

    def _parallel(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each part's share of residual . vector."""
        chosen = self.centers[np.arange(self.parts), codes]
        return ((x - chosen) * x).sum(axis=2)

    def _assign(self, x: np.ndarray, codes: np.ndarray, passes: int) -> np.ndarray:
        """Coordinate descent: the best centroid of each part, given the other parts."""
        codes = codes.copy()
        share = self._parallel(x, codes)
        total = share.sum(axis=1)
        for _ in range(passes):
            for p in range(self.parts):
                r = x[:, p, None] - self.centers[p]
                along = (r * x[:, p, None]).sum(axis=2)
                rest = (total - share[:, p])[:, None]
                loss = (r**2).sum(axis=2) + (self.eta - 1) * (rest + along) ** 2
                codes[:, p] = loss.argmin(axis=1)
                new = along[np.arange(len(x)), codes[:, p]]
                total += new - share[:, p]
                share[:, p] = new
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centroids of least loss for the codes, part after part."""
        share = self._parallel(x, codes)
        total = share.sum(axis=1)
        for p in range(self.parts):
            for c in range(CENTROIDS):
                own = np.flatnonzero(codes[:, p] == c)
                if not len(own):
                    continue
                v = x[own, p]
                rest = total[own] - share[own, p]
                left = len(own) * np.eye(PAIR) + (self.eta - 1) * v.T @ v
                right = v.sum(axis=0) + (self.eta - 1) * (v * (rest + (v**2).sum(axis=1))[:, None]).sum(axis=0)
                self.centers[p, c] = np.linalg.solve(left, right)
            new = ((x[:, p] - self.centers[p, codes[:, p]]) * x[:, p]).sum(axis=1)
            total += new - share[:, p]
            share[:, p] = new

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of two parts in each byte."""
        x = self._cut(vectors)
        codes = self._assign(x, self._nearest(x), PASSES).astype(np.uint8)
        if self.parts % 2:
            codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, query: np.ndarray) -> np.ndarray:
        """(byte, 256): partial products of the query with both parts of a byte."""
        q = np.zeros(self.parts * PAIR)
        q[: self.dim] = query
        each = np.einsum("pcj,pj->pc", self.centers, q.reshape(self.parts, PAIR))
        if self.parts % 2:
            each = np.vstack([each, np.zeros((1, CENTROIDS))])
        return (each[1::2, :, None] + each[::2, None, :]).reshape(-1, 256)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of codes as encode gives them."""
        each = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, : self.parts]
        return self.centers[np.arange(self.parts), each].reshape(len(codes), -1)[:, : self.dim]


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, lengths); a zero vector gives the first axis, of length 0."""
    top = np.abs(vectors).max(axis=1, initial=0)
    v = vectors / np.where(top > 0, top, 1)[:, None]
    size = np.sqrt((v * v).sum(axis=1))
    v = v / np.where(top > 0, size, 1)[:, None]
    v[top == 0, :1] = 1
    return v, size * top


class Coder:
    """Cells, and a codebook for each stage of what is left of a vector."""

    def __init__(self, dim: int, sample: np.ndarray):
        self.dim, rng = dim, np.random.default_rng(11)
        self.order = rng.permutation(dim)
        self.turns = [np.linalg.qr(rng.normal(size=(n, n)))[0] for n in (min(TURNED, dim - at) for at in range(0, dim, TURNED))]
        unit = _units(sample)[0]
        self.cells = self._spread(unit, max(1, min(CELLS, len(unit) // CELL_ROWS)), rng)
        for _ in range(CELL_ROUNDS):
            # Medians: a tight group keeps its centre, whatever else falls into its cell.
            of = self._cell(unit)
            for i in np.unique(of):
                self.cells[i] = np.median(unit[of == i], axis=0)
        self.turned = self.turn(self.cells)
        self.books: list[Codebook] = []
        unit = unit[:BOOK_ROWS]
        left = self.turn(unit) - self.turned[self._cell(unit)]
        for _ in range(STAGES):
            x, size = _units(left)
            self.books.append(Codebook(dim, x[size > 0] if (size > 0).any() else x))
            left = left - size[:, None] * self.books[-1].decode(self.books[-1].encode(x))

    @staticmethod
    def _spread(unit: np.ndarray, n: int, rng) -> np.ndarray:
        """Rows far from one another: each is drawn by its squared distance to those before."""
        picked = [int(rng.integers(len(unit)))]
        far = ((unit - unit[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < n and (total := far.sum()) > 0:
            picked.append(int(np.searchsorted(np.cumsum(far), rng.random() * total).clip(0, len(unit) - 1)))
            far = np.minimum(far, ((unit - unit[picked[-1]]) ** 2).sum(axis=1))
        return unit[picked].copy()

    def _cell(self, unit: np.ndarray) -> np.ndarray:
        half = (self.cells**2).sum(axis=1) / 2
        return np.concatenate([np.zeros(0, np.int64), *[(unit[i : i + 4096] @ self.cells.T - half).argmax(axis=1) for i in range(0, len(unit), 4096)]])

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors[:, self.order]
        return np.hstack([v[:, i * TURNED : i * TURNED + len(t)] @ t for i, t in enumerate(self.turns)])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of all stages; the cell; the scale of each stage, and behind them the product of the centre with what no code holds)."""
        unit = _units(vectors)[0]
        cell = self._cell(unit)
        left, codes, numbers = self.turn(unit) - self.turned[cell], [], []
        for book in self.books:
            x, size = _units(left)
            codes.append(book.encode(x))
            numbers.append(size)
            left = left - size[:, None] * book.decode(codes[-1])
        numbers.append((left * self.turned[cell]).sum(axis=1))
        return np.hstack(codes), cell.astype(np.int32), np.stack(numbers, axis=1)

    def products(self, query: np.ndarray, lanes: np.ndarray, cell: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Approximate products of a query with all rows of a block: codes byte by byte, numbers by stage."""
        query = _units(query[None])[0]
        turned, each = self.turn(query)[0], len(lanes) // len(self.books)
        total = (self.cells @ query[0])[cell] + numbers[-1]
        for i, book in enumerate(self.books):
            total += numbers[i] * scan(lanes[i * each : (i + 1) * each], book.tables(turned))
        return total


def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate products of all coded rows; codes are stored by byte, so each table is read in one sweep."""
    total = tables[0][codes[0]]
    for byte in range(1, len(codes)):
        total += tables[byte][codes[byte]]
    return total


def train(rows: DataFrame) -> dict[int, Coder]:
    """A coder for each vector length; they share the sample."""
    lengths = rows.select("dim").distinct().count()
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(1, MAX_TRAIN // max(1, lengths)))
    by_dim: dict[int, list] = {}
    for r in sample.select("dim", "vector", "place").orderBy("dim", "place").collect():  # bounded
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    return {d: Coder(d, np.array(v)) for d, v in by_dim.items()}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, rerank: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): about each query's k largest cosines, with exact scores.

    Defined cases: rows with a null id, and null, empty or zero vectors or such
    with null or non-finite components, take no part; vectors of different
    length don't meet; a query doesn't meet its own id; rows that repeat id and
    vector count once; equal scores go to the smaller id; fewer candidates give
    fewer rows.
    """
    books = train(vectors)
    n = vectors.count()
    rerank = max(k, rerank or max(RERANK, math.isqrt(n)))
    spark = vectors.sparkSession
    n_blocks = max(1, -(-n // BLOCK_ROWS), min(shuffle_partitions(spark), n // LEAST_ROWS))
    share = min(rerank, 2 * -(-rerank // n_blocks) + 2)
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", "dim").distinct().withColumn("hash", F.xxhash64("query_id", "vector"))
    pieces = max(1, -(-asked.count() // QUERY_ROWS))
    columns = ("ids", "codes", "cells", "numbers")
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    asked = materialize(asked.withColumn("piece", place("hash", pieces)), "ann-queries")

    def code(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            codes, cells, numbers = [None] * len(dims), np.zeros(len(dims), np.int32), [None] * len(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c, cells[at], x = books[int(d)].encode(matrix(b.column(1).take(pa.array(at)), int(d)))
                for j, i in enumerate(at):
                    codes[i], numbers[i] = c[j].tobytes(), x[j].tobytes()
            cols = [b.column(0), b.column(2), pa.array(codes, pa.binary()), pa.array(cells), pa.array(numbers, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "dim", "code", "cell", "numbers"])

    def pack(t: pa.Table) -> pa.Table:
        """A block as one row: ids, codes byte by byte, cells, numbers by stage."""
        ids = t.column("vec_id").to_numpy()
        by_row = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(ids), -1).T
        row = {"ids": ids, "codes": by_row("code", np.uint8), "cells": t.column("cell").to_numpy(), "numbers": by_row("numbers", np.float64)}
        return pa.table({"block": t.column("block")[:1], "dim": t.column("dim")[:1], **{c: pa.array([x.tobytes()], pa.binary()) for c, x in row.items()}})

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_()]
    found = "query_id long, hash long, vec_id long, near double, block int, last boolean"

    def given(block: int, packed: tuple[bytes, ...], asked: list[tuple], dim: int) -> list[np.ndarray]:
        """Columns of found: of each query (id, hash, vector, bound, rows given before) its highest sums in a block (ids, codes, cells, numbers), ties to the smaller id."""
        ids, codes, cells, numbers = (np.frombuffer(x, k) for x, k in zip(packed, (np.int64, np.uint8, np.int32, np.float64), strict=True))
        lanes, numbers, out = codes.reshape(-1, len(ids)), numbers.reshape(-1, len(ids)), [[np.zeros(0, k.to_pandas_dtype())] for k in kinds]
        for i, h, v, bound, most in asked:
            sums = books[dim].products(v, lanes, cells, numbers)
            sums[ids == i] = -np.inf
            rows = best(sums, ids, most)
            rows = rows[(ids[rows] != i) & (sums[rows] >= bound)]
            last = np.zeros(len(rows), bool)
            last[-1:] = len(rows) == most < len(ids)
            for c, y in zip(out, (np.full(len(rows), i), np.full(len(rows), h), ids[rows], sums[rows], np.full(len(rows), block, np.int32), last), strict=True):
                c.append(y)
        return [np.concatenate(c) for c in out]

    def first(piece: int):
        """A pass over all blocks with one broadcast of queries."""
        own = asked.filter(F.col("piece") == piece).select("query_id", "hash", "vector", "dim").toArrow()  # QUERY_ROWS, about
        shared = spark.sparkContext.broadcast({
            d: (t.column("query_id").to_pylist(), t.column("hash").to_pylist(), matrix(t.column("vector"), d))
            for d in books if len(t := own.filter(pc.equal(own.column("dim"), d)))
        })

        def run(batches):
            for b in batches:
                for block, dim, *packed in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if dim in shared.value:
                        queries = [(i, h, v, -np.inf, share) for i, h, v in zip(*shared.value[dim], strict=True)]
                        cols = given(block, packed, queries, dim)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in found.split(", ")])

        return packed.select("block", "dim", *columns).mapInArrow(tidy(run), found)

    def again(a: pa.Table, b: pa.Table) -> pa.Table:
        """Queries that a block may hold more for, over it."""
        cols = [np.zeros(0, k.to_pandas_dtype()) for k in kinds]
        if len(a) and len(b):
            dim = a.column("dim")[0].as_py()
            queries = zip(a.column("query_id").to_pylist(), a.column("hash").to_pylist(), matrix(a.column("vector"), dim), a.column("bound").to_pylist(), strict=True)
            row = lambda c: b.column(c)[0].as_py()
            cols = given(row("block"), [row(c) for c in columns], [(*q, rerank) for q in queries], dim)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in found.split(", ")])

    def exact(batches):
        for b in batches:
            dims, score = b.column("dim").to_numpy(), np.zeros(len(b))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, v = (matrix(b.column(c).take(pa.array(at)), int(d)) for c in ("vector", "asked"))
                score[at] = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    # Rows that repeat id and vector are one candidate; those of one id with other vectors are told apart when scored.
    coded = vectors.select("vec_id", "vector", "dim").mapInArrow(tidy(code), "vec_id long, dim int, code binary, cell int, numbers binary").distinct()
    packed = coded.withColumn("block", place("vec_id", n_blocks)).groupBy("block", "dim").applyInArrow(pack, "block int, dim int, " + ", ".join(f"{c} binary" for c in columns))
    packed = materialize(packed, "ann-blocks")
    path = scratch_dir(spark, "ann-shares")
    for piece in range(pieces):
        first(piece).write.mode("overwrite").parquet(f"{path}/piece={piece}")
    shares = spark.read.schema(found).parquet(*[f"{path}/piece={i}" for i in range(pieces)])
    key = ["query_id", "hash"]
    bound = ranked(shares, rerank, tuple(key), "near").groupBy(*key).agg(F.min("near").alias("bound"), F.count("*").alias("n"))
    bound = bound.withColumn("bound", F.when(F.col("n") < rerank, F.lit(float("-inf"))).otherwise(F.col("bound").cast("double"))).drop("n")
    open_ = shares.filter("last").join(bound, key).filter("near >= bound").select(*key, "block", "bound")
    open_ = materialize(open_.join(asked.drop("piece"), key), "ann-open")
    chunks = max(1, -(-open_.count() // (n_blocks * QUERY_ROWS)))
    open_ = open_.withColumn("chunk", place("hash", chunks))
    by = ["block", "dim", "chunk"]
    blocks = packed.join(open_.select(*[F.col(c).alias(c) for c in by]).distinct(), ["block", "dim"])
    more = open_.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInArrow(again, found)
    candidates = shares.select("query_id", "hash", "vec_id", "near").unionByName(more.select("query_id", "hash", "vec_id", "near")).distinct()
    pairs = materialize(ranked(candidates, rerank, tuple(key), "near").select("query_id", "hash", "vec_id").distinct(), "ann-candidates")
    pairs = pairs.join(asked.select("hash", F.col("query_id").alias("q"), F.col("vector").alias("asked"), "dim"), ["hash"]).filter("q = query_id")
    rows = pairs.join(vectors.select("vec_id", "vector", F.col("dim").alias("d")), "vec_id").filter("d = dim")
    scored = rows.select("query_id", "vec_id", "dim", "vector", "asked").mapInArrow(tidy(exact), "query_id long, vec_id long, score double")
    return ranked(scored.distinct(), k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))
