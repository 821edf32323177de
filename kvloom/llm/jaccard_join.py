"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Sets are the distinct 5-word shingles of whole texts; two sets link when
100 * intersection >= 75 * union. Documents with equal sets form one class,
found while shingles are made, and only classes are compared.

1. Shingle counts. Every class sends its shingles to hash ranges, packed as
   blobs; each range counts the classes of every shingle and returns those that
   occur in two classes or more. All other shingles are unique.
2. Prefixes. Each class orders its shingles by (class count, hash), unique ones
   first. Sets of n that link share l of their first n - ceil(0.75 n) + l
   shingles, for any l. A class takes the l of least estimated cost: rows that
   its longer prefix meets, and candidates that would have to be verified. A
   pair must then share the smaller of its two l. A class whose prefix holds
   unique shingles only can link with nothing and sends no row.
3. Stars. For each prefix shingle, its classes meet the one with the fewest
   unique shingles. Verified links are contracted to components; this settles
   groups of near copies in linear work, without the pairs inside them.
4. Pairs. Shingles that still touch several components are joined with
   themselves across components, with size and position bounds, and the
   candidates verified. Nothing is capped: a link between two components is
   found here whatever the stars did.

A pair is verified by the exact size of the intersection of its non-unique
shingles. Shingles are 48 bits and their hash range (64 bits before packing).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import columns_of, give_back, materialize, quoted, table, tidy, unused
from kvloom.llm.components import components

WIDTH = 5
#: Similarity PERCENT / 100.
PERCENT = 75
#: Shingles packed at a time in a worker.
FLUSH = 1_000_000
#: Hash ranges: this many, or more so that each counts about RANGE_SHINGLES.
LEAST_RANGES, RANGE_SHINGLES = 64, 4_000_000
LONGEST_MATCH = 8
#: Cost of verifying a candidate against that of meeting one row of a prefix shingle.
VERIFY_COST = 8.0
STAR_ROUNDS = 2
#: Pairs of a class from which on they are dealt to several tasks; or one pair in so many, where that is more.
HOT_PAIRS, HOT_SHARE = 256, 10_000
#: A round that finds less than one link for this many linked classes is the last.
FEW_LINKS = 100
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW48 = np.uint64((1 << 48) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M1
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles; with one to four words, of the whole sequence."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = _mix(h + w[j : j + n] * M2)
    return np.unique(h)


def class_of(h: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set as signed integers: the class, and what tells sets of one class apart."""
    total = np.array([_mix(h ^ M2).sum(), np.uint64(len(h)), _mix(h + M1).sum()], np.uint64)
    x = _mix(total)
    return tuple(_mix(x[[0, 2]] * M2 + x[1]).view(np.int64).tolist())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, class, other); class and its second hash are null for empty sets."""
    def batch(batches):
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            n = pa.array([len(h) for h in sets], pa.int64())
            of = [class_of(h) if len(h) else (None, None) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), n, *[pa.array([o[i] for o in of], pa.int64()) for i in (0, 1)]], names=["id", "n", "class", "other"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("binary").alias("t")).mapInArrow(tidy(batch), f"id {kind}, n long, class long, other long")


def collided(members: DataFrame) -> list[int]:
    """Classes that hold different sets: about one in 10^10 documents. There the second hash becomes the class."""
    pairs = members.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return [r["class"] for r in pairs.filter("lo < hi").select("class").collect()]


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _blobs(docs: DataFrame, parts: int, text_col: str, rehash: list[int]) -> DataFrame:
    """(part, sets, n, counts, tokens): for each hash range, the shingles of many classes, packed."""
    schema = "part int, sets binary, n binary, counts binary, tokens binary"
    apart = frozenset(rehash)

    def run(batches):
        seen: set[int] = set()  # classes that this task has sent
        held: list[np.ndarray] = []
        own: list[int] = []
        size = 0

        def flush():
            token = np.concatenate(held)
            lengths = np.array([len(h) for h in held])
            doc = np.repeat(np.arange(len(held)), lengths)
            part = ((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            token, doc, part = token[order], doc[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            sets = np.array(own, np.int64)
            cols: list[list] = [[], [], [], [], []]
            for p in range(parts):
                a, z = cuts[p], cuts[p + 1]
                if a == z:
                    continue
                d = doc[a:z]
                first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
                counts = np.diff(np.append(first, z - a))
                for c, x in zip(cols, (p, sets[d[first]].tobytes(), lengths[d[first]].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), _pack(token[a:z])), strict=True):
                    c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["part", "sets", "n", "counts", "tokens"])

        for b in batches:
            for t in b.column(0):
                h = shingles(t.as_py())
                if not len(h):
                    continue
                c, other = class_of(h)
                c = other if c in apart else c
                if c in seen:
                    continue
                seen.add(c)
                held.append(h)
                own.append(c)
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    held, own, size = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col(quoted(text_col)).cast("binary").alias("t")).mapInArrow(tidy(run), schema)


def _shared(blobs: DataFrame) -> DataFrame:
    """(class, n, part, tokens, counts): each class's shingles in a range that occur in two classes or more."""
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        join = lambda c: b"".join(t.column(c).to_pylist())
        sets = np.frombuffer(join("sets"), np.int64)
        n = np.frombuffer(join("n"), "<u4")
        rows = np.repeat(np.arange(len(sets)), np.frombuffer(join("counts"), "<u4"))
        token = _unpack(join("tokens"))
        # Classes that several tasks sent: keep the first copy of each.
        _, first, same = np.unique(sets, return_index=True, return_inverse=True)
        keep = first[same[rows]] == rows
        token, rows = token[keep], rows[keep]
        order = np.argsort(token, kind="stable")
        token, rows = token[order], rows[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, int)
        count = np.diff(np.append(start, len(token)))
        each = np.repeat(count, count)
        more = each > 1
        token, rows, each = token[more], rows[more], np.minimum(each[more], 65535)
        order = np.argsort(rows, kind="stable")
        token, rows, each = token[order], rows[order], each[order]
        cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, int)
        ends = np.append(cut[1:], len(rows))[: len(cut)]
        packed, counts = _pack(token), each.astype("<u2").tobytes()
        return pa.table({
            "class": pa.array(sets[rows[cut]], pa.int64()),
            "n": pa.array(n[rows[cut]].astype(np.int64), pa.int64()),
            "part": pa.array(np.full(len(cut), part), pa.int32()),
            "tokens": pa.array([packed[6 * a : 6 * z] for a, z in zip(cut, ends, strict=True)], pa.binary()),
            "counts": pa.array([counts[2 * a : 2 * z] for a, z in zip(cut, ends, strict=True)], pa.binary()),
        })

    def then_give_back(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return blobs.groupBy("part").applyInArrow(then_give_back, "class long, n long, part int, tokens binary, counts binary")


def choose_prefix(n: int, unique: int, counts: np.ndarray) -> tuple[int, int]:
    """(l, number of non-unique shingles in the prefix) of least estimated cost; counts ascend. (0, 0): no link is possible."""
    least = n - (-(-PERCENT * n // 100))  # prefix of l less l
    if unique >= least + 1:
        return 0, 0
    met = np.cumsum(counts)
    best = (0.0, 0, 0)
    for match in range(1, LONGEST_MATCH + 1):
        k = min(least + match - unique, len(counts))
        # Rows met, and of them the candidates that reach l matches at most.
        cost = met[k - 1] + VERIFY_COST * met[k - 1] / match
        if not best[1] or cost < best[0]:
            best = (cost, match, k)
        if k == len(counts):
            break
    return best[1], best[2]


def prefixes(docs: DataFrame, n_shingles: int, text_col: str = "text", rehash: list[int] | None = None) -> DataFrame:
    """(class, n, l, unique, prefix array<long>, tokens) of every class that may link with another; n_shingles sizes the hash ranges, rehash names the collided classes."""
    parts = max(LEAST_RANGES, -(-n_shingles // RANGE_SHINGLES))
    found = _shared(_blobs(docs, parts, text_col, rehash or []))
    gathered = found.groupBy("class").agg(F.first("n").alias("n"), F.collect_list(F.struct("part", "tokens", "counts")).alias("got"))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for c, n, got in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                low = _unpack(b"".join([g["tokens"] for g in got]))
                unique = n - len(low)
                if 100 * len(low) < PERCENT * n:
                    continue
                counts = np.frombuffer(b"".join([g["counts"] for g in got]), "<u2").astype(np.int64)
                full = low ^ _mix(np.repeat(np.array([g["part"] for g in got], np.uint64), [len(g["tokens"]) // 6 for g in got]) * M2)
                order = np.lexsort((full, counts))
                match, k = choose_prefix(n, unique, counts[order])
                if match:
                    for x, y in zip(cols, (c, n, match, unique, full[order[:k]].astype(np.int64), _pack(np.sort(low))), strict=True):
                        x.append(y)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["class", "n", "l", "unique", "prefix", "tokens"])

    return gathered.mapInArrow(tidy(run), "class long, n long, l int, unique long, prefix array<long>, tokens binary")


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, n_pairs: int) -> DataFrame:
    """rows of pairs with n and tokens of the classes on one side, as n{side} and t{side}.

    The centre of a star can be in a third of all pairs: classes in more than
    HOT_PAIRS pairs, and in more than a HOT_SHARE-th of all, of which there are
    HOT_SHARE at most, meet their pairs in several parts.
    """
    least = max(HOT_PAIRS, n_pairs // HOT_SHARE)
    hot = pairs.groupBy(F.col(side).alias("hot")).agg(F.count("*").alias("n")).filter(F.col("n") > least)
    hot = F.broadcast(hot.select("hot", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    other = "b" if side == "a" else "a"
    p = rows.join(hot, F.col(side) == F.col("hot"), "left").drop("hot")
    p = p.withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    s = sets.join(hot, F.col("class") == F.col("hot"), "left").select(
        F.col("class").alias("of"), F.col("n").alias(f"n{side}"), F.col("tokens").alias(f"t{side}"),
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part_of"),
    )
    return p.join(s, (F.col(side) == F.col("of")) & (F.col("part") == F.col("part_of"))).drop("of", "part", "part_of")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    # Written first, so that Spark knows their size: sets that no pair names don't travel.
    pairs = materialize(pairs, "jj-pairs")
    n_pairs = pairs.count()
    named = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    s = sets.select("class", "n", "tokens").join(named, "class", "left_semi")
    both = pairs
    for side in ("b", "a"):
        both = _with_set(both, pairs, s, side, n_pairs)

    def run(batches):
        for b in batches:
            ok = []
            for ta, tb, na, nb in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                x, y = _unpack(ta.as_py()), _unpack(tb.as_py())
                common = len(np.intersect1d(x, y))
                ok.append(100 * common >= PERCENT * (na + nb - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb", "na", "nb").mapInArrow(tidy(run), "a long, b long")


def _postings(sets: DataFrame) -> DataFrame:
    rows = sets.select("class", "n", "l", "unique", F.posexplode("prefix").alias("i", "token"))
    return rows.select("token", "class", "n", "l", "unique", (F.col("unique") + F.col("i")).alias("at"))


def _bounded(x: str, y: str, first: bool = False):
    """Sizes, non-unique shingles and positions of rows x and y leave room for a link that has l matches; first: theirs is the first match."""
    f = lambda a, name: F.col(f"{a}.{name}")
    n1, n2 = f(x, "n"), f(y, "n")
    need = F.floor((F.lit(PERCENT) * (n1 + n2) + F.lit(99 + PERCENT)) / F.lit(100 + PERCENT))  # least intersection
    shared = F.least(n1 - f(x, "unique"), n2 - f(y, "unique"))
    rest = F.least(n1 - f(x, "at"), n2 - f(y, "at"))
    sizes = 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)
    return sizes & (shared >= need) & (rest >= (need if first else need - F.least(f(x, "l"), f(y, "l")) + 1))


def _candidates(met: DataFrame, x: str, y: str) -> DataFrame:
    """(a, b): pairs that share as many prefix shingles as the smaller of their l."""
    f = lambda a, name: F.col(f"{a}.{name}")
    pairs = met.groupBy(f(x, "class").alias("a"), f(y, "class").alias("b")).agg(F.count("*").alias("m"), F.min(F.least(f(x, "l"), f(y, "l"))).alias("need"))
    return pairs.filter("m >= need").select("a", "b")


def _open_rows(posts: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the prefix shingles that touch several components. Hot shingles of one component are dropped after a partial aggregation."""
    rows = posts.join(label, posts["class"] == label["node"], "left").withColumn("comp", F.coalesce("component", "class")).drop("node", "component")
    tokens = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return materialize(rows.join(materialize(tokens, "jj-open"), "token"), "jj-rows")


def components_of(sets: DataFrame) -> DataFrame:
    """(node, component) of all classes that link with another."""
    posts = _postings(sets)
    label = late = None
    rows = posts.withColumn("comp", F.col("class"))
    for turn in range(STAR_ROUNDS):
        if turn:
            rows = _open_rows(posts, label)
        # First the class with the fewest unique shingles, the likely original; then others by chance.
        first = F.col("unique") if turn == 0 else F.xxhash64(F.lit(turn), "class")
        pivot = F.min(F.struct(first.alias("first"), "class", "comp", "n", "l", "unique", "at"))
        pivots = rows.groupBy("token").agg(pivot.alias("p"), F.count("*").alias("rows")).filter("rows > 1").select("token", "p.*").drop("first")
        pivots = materialize(pivots, "jj-pivots")
        x, y = pivots.alias("x"), rows.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & _bounded("x", "y"))
        got = materialize(verify(_candidates(met, "x", "y"), sets), "jj-links")
        if turn and got.count() * FEW_LINKS < label.count():
            # Few links contract little: the rows stay open as they are, the links join at the end.
            late = got
            break
        label = _joined_components(label, got)
    else:
        rows = _open_rows(posts, label)
    rows = materialize(rows.join(sets.select("class", "prefix"), "class"), "jj-rows")
    x, y = rows.alias("x"), rows.alias("y")
    # Each pair meets once, at its first common shingle: there the position bound needs no slack, and all matches are counted.
    common = F.array_intersect("x.prefix", "y.prefix")
    once = (F.get(common, F.lit(0)) == F.col("x.token")) & (F.size(common) >= F.least("x.l", "y.l"))
    other = (F.col("x.class") < F.col("y.class")) & (F.col("x.comp") != F.col("y.comp"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & other & _bounded("x", "y", first=True) & once)
    got = verify(met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")), sets)
    return _joined_components(label, got if late is None else got.union(late))


def _joined_components(label: DataFrame | None, got: DataFrame) -> DataFrame:
    """(node, component) after new links (a, b): components of the links and of what was joined before."""
    got = materialize(got, "jj-links")
    if label is not None:
        if got.isEmpty():
            return label
        got = got.union(label.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return materialize(components(got), "jj-components")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component): set size, and the smallest id that links reach.

    Defined cases: null, empty and blank texts have n 0 and are their own
    component; rows that repeat an id are compared by their texts and each give
    a row; rows with a null id take part in links, their component is the
    smallest id that is not null (null if there is none).
    """
    members = materialize(classes(docs, id_col, text_col), "jj-classes")
    total = members.agg(F.sum("n")).first()[0] or 0
    rehash = collided(members)
    members = members.withColumn("class", F.when(F.col("class").isin(rehash), F.col("other")).otherwise(F.col("class"))) if rehash else members
    sets = materialize(prefixes(docs, total, text_col, rehash), "jj-sets")
    label = components_of(sets)
    least = members.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("first"))
    joined = least.join(label, least["class"] == label["node"], "left").select("class", "first", F.coalesce("component", "class").alias("comp"))
    joined = materialize(joined, "jj-labels")
    by_comp = joined.groupBy("comp").agg(F.min("first").alias("component"))
    of_class = materialize(joined.join(by_comp, "comp").select(F.col("class").alias("c"), "component"), "jj-of-class")
    out = members.filter(F.col("class").isNotNull()).join(of_class, F.col("class") == F.col("c")).select("id", "n", "component")
    return out.union(members.filter(F.col("class").isNull()).select("id", "n", F.col("id").alias("component")))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows whose id is not the smallest of its component; columns unchanged. Null ids stay."""
    found = similar_components(docs, id_col, text_col)
    name = unused(docs, "__gone")
    gone = materialize(found.filter(F.col("id") != F.col("component")).select(F.col("id").alias(name)).distinct(), "jj-gone")
    return docs.join(gone.hint("shuffle_hash"), F.col(quoted(id_col)) == F.col(name), "left_anti").select(*columns_of(docs))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
  WHERE 100 * common >= 75 * (na.n + nb.n - common)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.y FROM r JOIN both_ways e ON r.reach = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
