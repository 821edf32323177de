"""Exact top-k inner-product search with M-trees.

Inner products become distances: with M the largest norm of all vectors, a
vector x gets the extra component sqrt(M^2 - |x|^2), a query the component 0.
Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest points are the highest
products and the triangle inequality prunes.

Routing objects, at most MAX_ROUTING of a bounded sample and far from one
another, cut all vectors into cells: the top of the tree. A cell of more than
TREE_ROWS vectors is dealt to several trees. Every tree is built once, of paged
nodes: routing objects with covering radii and their distance to the parent's
routing object, leaves with the objects' distances to theirs.

A query first searches a tree of its nearest cell. The k-th score found there is
its bound; it goes on only to cells whose ball leaves room for a better one, and
takes the bound along. Search in a tree is best first, and a distance is
computed only if |d(query, parent) - d(object, parent)| - radius leaves room;
queries that meet a tree search it side by side.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.blocks import best, distinct_rows, matrix, ranked, usable
from kvloom.llm.common import materialize, table, tidy

PAGE = 64
FANOUT = 16
#: Vectors of a tree, queries that meet it in one task.
TREE_ROWS, QUERY_ROWS = 4096, 512
#: Routing objects at the top, and vectors that they are chosen from.
MAX_ROUTING, SAMPLE = 1024, 4096
SCALE = 64
K = 20
#: Relative slack of bounds for rounding of distances; scores are integers and exact.
SLACK = 1e-9

NODE = np.dtype([("leaf", "?"), ("first", "<i4"), ("last", "<i4"), ("routing", "<i4"), ("radius", "<f8"), ("parent", "<f8")])


def lifted(vectors: np.ndarray, m2: float) -> np.ndarray:
    """The points whose distances stand for the products."""
    x = vectors.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0.0, m2 - np.einsum("ij,ij->i", x, x)))[:, None]])


def far_apart(points: np.ndarray, n: int) -> list[int]:
    """Places of at most n distinct points, each the farthest from those before; the first is the farthest from the mean."""
    if not len(points):
        return []
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return chosen


class MTree:
    """ids, whole (integer vectors), member_distance in the order of the leaves; nodes in breadth-first order, children side by side."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, member_distance: np.ndarray, nodes: np.ndarray, m2: float):
        self.ids, self.whole, self.member_distance, self.nodes, self.m2 = ids, whole, member_distance, nodes, m2
        self.points = lifted(whole, m2)
        self.computed = self.opened = 0

    @classmethod
    def build(cls, ids: np.ndarray, whole: np.ndarray, m2: float | None = None) -> MTree:
        x = whole.astype(np.float64)
        m2 = float(np.einsum("ij,ij->i", x, x).max(initial=0.0)) if m2 is None else m2
        points = lifted(whole, m2)
        nodes: list[tuple] = []
        order: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        n_rows = 0
        waiting = [(np.arange(len(ids)), 0.0, cls._middle(points, np.arange(len(ids))))]
        at = 0
        while at < len(waiting):
            members, parent, routing = waiting[at]
            at += 1
            d = np.sqrt(((points[members] - points[routing]) ** 2).sum(axis=1)) if len(members) else np.zeros(0)
            radius = float(d.max(initial=0.0))
            if len(members) <= PAGE:
                nodes.append((True, n_rows, n_rows + len(members), routing, radius, parent))
                order.append(members)
                distances.append(d)
                n_rows += len(members)
                continue
            groups = cls._split(points, members)
            first = len(waiting)
            for g in groups:
                r = cls._middle(points, g)
                waiting.append((g, float(np.sqrt(((points[r] - points[routing]) ** 2).sum())), r))
            nodes.append((False, first, len(waiting), routing, radius, parent))
        rows = np.concatenate(order) if order else np.zeros(0, np.int64)
        made = np.array(nodes, NODE)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        if len(rows):
            made["routing"] = place[made["routing"]]
        return cls(ids[rows], whole[rows], np.concatenate(distances) if distances else np.zeros(0), made, m2)

    @staticmethod
    def _middle(points: np.ndarray, members: np.ndarray) -> int:
        """The member nearest to the mean: routing objects are objects."""
        if not len(members):
            return 0
        own = points[members]
        return int(members[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()])

    @staticmethod
    def _split(points: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
        fanout = max(2, min(FANOUT, -(-len(members) // (PAGE // 2))))
        pool = members[:: max(1, len(members) // 1024)]
        chosen = pool[far_apart(points[pool], fanout)]
        own = points[members]
        nearest = np.argmin(np.stack([((own - points[c]) ** 2).sum(axis=1) for c in chosen]), axis=0)
        groups = [g for i in range(len(chosen)) if len(g := members[nearest == i])]
        if len(groups) < 2:
            # All alike: cut by place, so that the depth stays bounded.
            return np.array_split(members, fanout)
        if max(map(len, groups)) > 0.95 * len(members):
            groups = [part for g in groups for part in (np.array_split(g, 2) if len(g) > 0.95 * len(members) else [g])]
        return groups

    def search(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, highest first, ties to the smaller id; without query_id itself."""
        _, ids, scores = self.search_all(query[None], np.array([query_id]), k)
        return ids, scores

    def search_all(self, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of each query's k best of score least or more (nan: any), as search gives them.

        Queries go through the tree together, best first by the least bound among
        them; each takes part only in nodes and rows that its own bound leaves
        room for.
        """
        m, nodes, points = len(queries), self.nodes, self.points
        lowest = np.iinfo(np.int64).min + 1 if self.whole.dtype == np.int64 else -np.inf
        top, top_ids = np.full((m, k), lowest, self.whole.dtype), np.full((m, k), np.iinfo(np.int64).max)
        least = np.full(m, np.nan) if least is None else least
        at = np.hstack([queries.astype(np.float64), np.zeros((m, 1))])
        total = (at * at).sum(axis=1) + self.m2
        slack = SLACK * (total + 1.0)
        # Squared distance of the k-th best, and the score that has it.
        limit = np.where(np.isnan(least), np.inf, np.maximum(0.0, total - 2.0 * np.nan_to_num(least)))
        heap: list[tuple] = []
        n = 0

        def push(node: int, who: np.ndarray, d: np.ndarray) -> None:
            nonlocal n
            bound = np.maximum(0.0, d - nodes["radius"][node])
            n += 1
            heapq.heappush(heap, (float(bound.min()), n, node, who, d, bound))

        if len(self.ids):
            self.computed += m
            push(0, np.arange(m), np.sqrt(((points[nodes["routing"][0]] - at) ** 2).sum(axis=1)))
        while heap:
            _, _, node, who, d, bound = heapq.heappop(heap)
            room = limit[who] + slack[who]
            open_ = bound * bound <= room
            if not open_.any():
                continue
            who, d, reach = who[open_], d[open_], np.sqrt(room[open_])
            self.opened += len(who)
            a, z = int(nodes["first"][node]), int(nodes["last"][node])
            if nodes["leaf"][node]:
                # Stored distances say which rows can be near enough.
                near = np.abs(d[:, None] - self.member_distance[a:z]) <= reach[:, None]
                rows, some = near.any(axis=0), near.any(axis=1)
                who, near, rows = who[some], near[np.ix_(some, rows)], a + np.flatnonzero(rows)
                self.computed += near.size
                scores, ids = queries[who] @ self.whole[rows].T, self.ids[rows]
                near &= (ids != query_ids[who, None]) & (2.0 * scores >= (total[who] - limit[who] - slack[who])[:, None])
                better = near.any(axis=1)
                if not better.any():
                    continue
                who = who[better]
                both = np.hstack([top[who], np.where(near[better], scores[better], lowest)])
                both_ids = np.hstack([top_ids[who], np.where(near[better], ids, np.iinfo(np.int64).max)])
                order = np.lexsort((both_ids, -both), axis=1)[:, :k]
                top[who], top_ids[who] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
                kth = top[who, k - 1]
                full = who[kth != lowest]
                limit[full] = np.minimum(limit[full], np.maximum(0.0, total[full] - 2.0 * top[full, k - 1]))
                continue
            children = np.arange(a, z)
            near = np.abs(d[:, None] - nodes["parent"][a:z]) - nodes["radius"][a:z] <= reach[:, None]
            some, children = near.any(axis=1), children[near.any(axis=0)]
            near, who, reach = near[np.ix_(some, children - a)], who[some], reach[some]
            self.computed += near.size
            to = np.sqrt(((points[nodes["routing"][children]] - at[who][:, None]) ** 2).sum(axis=2))
            near &= to - nodes["radius"][children] <= reach[:, None]
            for i in np.flatnonzero(near.any(axis=0)).tolist():
                push(int(children[i]), who[near[:, i]], to[near[:, i], i])
        found = (top != lowest) & ~(top < np.where(np.isnan(least), -np.inf, least)[:, None])
        return np.nonzero(found)[0], top_ids[found], top[found]


class Top:
    """The routing objects of each vector length, as points; vectors of lengths that the sample lacks make one cell."""

    def __init__(self, sample: list, sizes: dict[int, int], m2: dict[int, float]):
        self.m2, self.points = m2, {}
        for dim, n in sizes.items():
            own = lifted(np.array([r for r in sample if len(r) == dim]).reshape(-1, dim), m2[dim])
            some = own[far_apart(own, min(MAX_ROUTING, -(-n // TREE_ROWS)))]
            self.points[dim] = some if len(some) else np.zeros((1, dim + 1))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """(point, routing object)."""
        routing = self.points[points.shape[1] - 1]
        square = (points**2).sum(axis=1)[:, None] - 2 * points @ routing.T + (routing**2).sum(axis=1)
        return np.sqrt(np.maximum(square, 0))


def _by_dim(batches, one):
    """one(dim, rows of that length as a record batch) for each batch and length."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            got = one(int(dim), b.take(pa.array(np.flatnonzero(dims == dim))))
            if got is not None:
                yield got


def _integers(column, dim: int) -> np.ndarray:
    return np.floor(SCALE * matrix(column, dim))


def _exact(q: np.ndarray, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """As float64 where all products are exact there, else as int64."""
    if dim * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0)) >= 2.0**53:
        return q.astype(np.int64), x.astype(np.int64)
    return q, x


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    """Integers in the narrowest type that holds them."""
    for kind in ("<i1", "<i2", "<i4"):
        if np.abs(x).max(initial=0) <= np.iinfo(kind).max:
            return x.astype(kind).tobytes(), kind
    return x.astype("<i8").tobytes(), "<i8"


def top_products(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over floor(SCALE * x).

    Defined cases: rows with a null id, and null or empty vectors or such with
    null or non-finite components, take no part; vectors of different length
    don't meet; a query doesn't meet its own id; rows that repeat id and vector
    count once; ties go to the smaller id; fewer candidates give fewer rows.
    Products must stay below 2^63.
    """
    spark = vectors.sparkSession
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    sizes = {r["dim"]: (r["n"], r["m2"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("m2")).collect()}  # a row for each length
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(SAMPLE).collect()  # bounded
    top = spark.sparkContext.broadcast(Top([np.floor(SCALE * np.array(r["vector"])) for r in sample], {d: n for d, (n, _) in sizes.items()}, {d: m for d, (_, m) in sizes.items()}))

    def assign(batches):
        def one(dim: int, b: pa.RecordBatch) -> pa.RecordBatch:
            d = top.value.distances(lifted(_integers(b.column("vector"), dim), top.value.m2[dim]))
            cell = d.argmin(axis=1)
            return pa.RecordBatch.from_arrays([b.column("dim"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), b.column("vec_id"), b.column("vector")], names=["dim", "cell", "distance", "vec_id", "vector"])

        yield from _by_dim(batches, one)

    placed = materialize(vectors.select("vec_id", "vector", "dim").mapInArrow(tidy(assign), "dim int, cell int, distance double, vec_id long, vector array<double>"), "mtree-placed")
    # At most MAX_ROUTING rows for each vector length.
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TREE_ROWS).cast("int").alias("trees"), F.min("distance").alias("near"), F.max("distance").alias("far"))
    known = cells.collect()
    cells = spark.createDataFrame(known, cells.schema)
    keys = ["dim", "cell", "tree"]
    placed = placed.join(F.broadcast(cells), ["dim", "cell"]).withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.col("trees")).cast("int"))

    def plant(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x, ids = _integers(t.column("vector"), dim), t.column("vec_id").to_numpy()
        keep = distinct_rows(ids, x, k + 1)
        tree = MTree.build(ids[keep], x[keep], top.value.m2[dim])
        packed, kind = _pack(tree.whole)
        values = [tree.ids.astype("<i8").tobytes(), packed, kind, tree.member_distance.tobytes(), tree.nodes.tobytes()]
        return pa.table([t.column(c)[:1] for c in keys] + [pa.array([v]) for v in values], names=[*keys, "ids", "whole", "kind", "members", "nodes"])

    trees = placed.groupBy(*keys).applyInArrow(plant, "dim int, cell int, tree int, ids binary, whole binary, kind string, members binary, nodes binary")
    trees = materialize(trees, "mtree-trees")

    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", "dim").distinct().withColumn("hash", F.xxhash64("query_id", "vector"))
    chunks = max(1, -(-queries.count() // QUERY_ROWS))
    asked = asked.withColumn("chunk", F.pmod(F.col("hash"), F.lit(chunks)).cast("int"))
    trees_of = {(r["dim"], r["cell"]): (r["trees"], r["near"], r["far"]) for r in known}

    def visits(first: bool):
        """(query, cell, tree): the first visit, or all others that the bound leaves room for."""
        def one(dim: int, b: pa.RecordBatch):
            if dim not in top.value.points:
                return None
            q = _integers(b.column("vector"), dim)
            d = top.value.distances(np.hstack([q, np.zeros((len(q), 1))]))
            n = np.array([trees_of.get((dim, c), (0, 0, 0)) for c in range(d.shape[1])], float)
            d[:, n[:, 0] == 0] = np.inf
            hashes = b.column("hash").to_numpy()
            nearest = d.argmin(axis=1)
            tree = hashes % n[nearest, 0].astype(np.int64)
            if first:
                who, cell = np.arange(len(q)), nearest
                least = pa.nulls(len(q), pa.float64())
            else:
                least = b.column("least")
                low = np.nan_to_num(least.to_numpy(zero_copy_only=False), nan=-np.inf)
                total = (q * q).sum(axis=1) + top.value.m2[dim]
                room = total - 2 * low + SLACK * (total + 1)
                gap = np.maximum(0, np.maximum(d - n[:, 2], n[:, 1] - d))
                # Distances to routing objects come from products: rounding is relative to the squares.
                gap = np.maximum(0, gap - 1e-6 * np.sqrt(total)[:, None])
                who, cell = np.nonzero((gap**2 <= room[:, None]) & (n[:, 0] > 0))
                times = n[cell, 0].astype(np.int64)
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                who, cell = np.repeat(who, times), np.repeat(cell, times)
                other = (cell != nearest[who]) | (at != tree[who])
                who, cell, tree = who[other], cell[other], at[other]
                least = least.take(pa.array(who))
            take = pa.array(who)
            return pa.RecordBatch.from_arrays([b.column("dim").take(take), pa.array(cell, pa.int32()), pa.array(tree, pa.int32()), b.column("chunk").take(take), b.column("query_id").take(take), b.column("vector").take(take), least], names=["dim", "cell", "tree", "chunk", "query_id", "vector", "least"])

        return tidy(lambda batches: _by_dim(batches, one))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(a) and len(b):
            dim = a.column("dim")[0].as_py()
            raw = lambda c: b.column(c)[0].as_py()
            whole = np.frombuffer(raw("whole"), raw("kind")).reshape(-1, dim).astype(np.float64 if raw("kind") != "<i8" else np.int64)
            q, whole = _exact(_integers(a.column("vector"), dim), whole, dim)
            tree = MTree(np.frombuffer(raw("ids"), "<i8"), whole, np.frombuffer(raw("members"), "<f8"), np.frombuffer(raw("nodes"), NODE), top.value.m2[dim])
            asked_ids = a.column("query_id").to_numpy()
            # Some at a time: what a node holds for them stays small.
            for i in range(0, len(q), 128):
                of, ids, scores = tree.search_all(q[i : i + 128], asked_ids[i : i + 128], k, a.column("least").to_numpy()[i : i + 128])
                out[0].append(asked_ids[i : i + 128][of])
                out[1].append(ids)
                out[2].append(scores.astype(np.int64))
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    def met(pairs: DataFrame) -> DataFrame:
        by = [*keys, "chunk"]
        right = trees.join(pairs.select(*[F.col(c).alias(c) for c in by]).distinct(), keys)  # aliases: a side of its own
        return pairs.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "query_id long, vec_id long, score long")

    schema = "dim int, cell int, tree int, chunk int, query_id long, vector array<double>, least double"
    columns = ["query_id", "vector", "dim", "hash", "chunk"]
    start = materialize(met(materialize(asked.select(*columns).mapInArrow(visits(True), schema), "mtree-visits")), "mtree-first")
    bound = ranked(start, k).filter(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").cast("double").alias("least"))
    asked = asked.join(bound, F.col("query_id") == F.col("q"), "left")
    rest = met(materialize(asked.select(*columns, "least").mapInArrow(visits(False), schema), "mtree-visits"))
    return ranked(start.union(rest), k).select("query_id", "rank", "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_products(rows, rows.filter(F.col("vec_id") % 20 == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
