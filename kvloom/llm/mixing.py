"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time t in [0, 1]. Its
integral, scaled to the source's target, is the cumulative token demand; a
source's documents follow one another in a fixed shuffled order (md5 of the
id), for as many epochs as the target needs, and the document that begins at
cumulative offset c is trained at the time where the demand reaches c. The
mix is the corpus range-sorted by that time.

Offsets are prefix sums in md5 order. md5 prefixes cut each source into
buckets of about ``BUCKET_ROWS`` rows and the buckets into at most 4,096
groups, so even a source with a third of all rows is summed in small windows:
inside buckets, over the buckets of a group, over the groups of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.llm.common import columns_of, materialize, quoted, shuffle_partitions, table

BUCKET_ROWS = 4096
#: Hex digits that make a group of buckets.
GROUP_DIGITS = 3
#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Slope of the schedules by the sources' order, repeating: the weight at time t is in proportion to 1 + slope * (2 t - 1).
SLOPES = (-0.5, 0.0, 0.5)
#: Key of the null source; all others begin with "s".
NO_SOURCE = "n"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size) to (skey, source_size, target, slope): water-filling in closed form.

    All targets are min(MAX_EPOCHS * size, level * weight) for one level. Sources
    fill up in order of size / weight; with the sources in that order, the level
    is the first one that leaves the source at hand below its limit.
    """
    def by_order(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("place") % len(values) + 1).cast("int"))

    # One row for each source; these windows run over sources, never over documents.
    place = F.row_number().over(Window.orderBy(F.col("skey") == NO_SOURCE, "skey")) - 1
    s = sizes.withColumn("place", place).withColumn("weight", by_order(WEIGHTS)).withColumn("slope", by_order(SLOPES))
    fill = F.col("source_size") / F.col("weight")
    order = Window.orderBy(fill, "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("full", F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(earlier), F.lit(0)))
        .withColumn("w_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(SHARE))
        .withColumn("level_here", (F.col("total") - F.col("full")) / F.col("w_left"))
        .withColumn("fits", F.col("level_here") * F.col("weight") <= F.col("source_size") * MAX_EPOCHS)
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(fill.alias("fill"), "place", "level_here"))).over(whole)["level_here"])
    )
    limit = (F.col("source_size") * MAX_EPOCHS).cast("double")
    target = F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit)
    return s.select("skey", "source_size", target.alias("target"), "slope")


def _order_key(id_col: str, text_col: str) -> Column:
    by_text = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")))
    return F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), by_text).cast("binary"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(quoted(source_col))), F.lit(NO_SOURCE)).alias("skey"),
        word_count(F.col(quoted(text_col))).alias("size"),
        _order_key(id_col, text_col).alias("key"),
        *more,
    )


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, key, size, source_size, target, taken, positions) for each document.

    ``taken`` counts the words that the mix takes of the document over all
    epochs; the words taken of a source add up to its target, rounded down.
    ``positions`` are the training times of the document's first word in each
    epoch that takes it.

    Defined cases: null or empty text has size 0, takes 0 and has no position;
    a null source is a source, last in order; null ids are ordered by a hash of
    the text; rows that repeat an id follow one another and count each; an empty
    table gives no rows; sources without words have target 0.
    """
    # Written once: the texts are read and counted once for all that follows.
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    return _planned(sized, sized).select("id", "key", "size", "source_size", "target", "taken", "positions")


def _planned(narrow: DataFrame, rows: DataFrame, *tie: str) -> DataFrame:
    """rows with their plan; rows are those of narrow, with more columns to carry along. tie: columns that order rows of one id and size."""
    n = narrow.count()
    digits = GROUP_DIGITS
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    narrow, rows = (d.withColumn("bucket", F.substring("key", 1, digits)) for d in (narrow, rows))
    buckets = narrow.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = buckets.withColumn("grp", F.substring("bucket", 1, GROUP_DIGITS))
    groups = buckets.groupBy("skey", "grp").agg(F.sum("bucket_size").alias("grp_size"))
    targets = source_targets(groups.groupBy("skey").agg(F.sum("grp_size").alias("source_size")))

    def sum_before(value: str, by: list[str], order: list[str]) -> Column:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")

    groups = groups.withColumn("grp_at", sum_before("grp_size", ["skey"], ["grp"])).join(targets, "skey")
    buckets = buckets.withColumn("in_grp", sum_before("bucket_size", ["skey", "grp"], ["bucket"]))
    offsets = buckets.join(groups, ["skey", "grp"]).select(
        "skey", "bucket", (F.col("grp_at") + F.col("in_grp")).alias("bucket_at"), "source_size", "target", "slope"
    )
    placed = rows.withColumn("in_bucket", sum_before("size", ["skey", "bucket"], ["key", "id", "size", *tie])).join(
        offsets, ["skey", "bucket"]
    )
    demand = F.floor("target").cast("long")
    at = F.col("bucket_at") + F.col("in_bucket")

    def part(epoch: int) -> Column:
        """Words of the document that lie before the demand's end in this epoch."""
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), demand - F.col("source_size") * epoch - at))

    def position(epoch: int) -> Column:
        """demand(t) = target * (t + slope * (t * t - t)), solved for the document's offset."""
        u, k = (at + F.col("source_size") * epoch) / F.col("target"), F.col("slope")
        root = F.sqrt((1 - k) * (1 - k) + 4 * k * u)
        return F.when(part(epoch) > 0, F.when(k == 0, u).otherwise((k - 1 + root) / (2 * k)))

    taken = part(0)
    for epoch in range(1, MAX_EPOCHS):
        taken = taken + part(epoch)
    positions = F.array_compact(F.array(*[position(e) for e in range(MAX_EPOCHS)]))
    return placed.withColumn("taken", taken).withColumn("positions", positions)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: docs' columns, one row for each time a document is read, range-sorted by training time.

    A document is read once for each epoch that takes it; only the document on
    which a source's demand ends is taken in part, and it is read whole if the
    mix takes half of it or more, else not. Texts are never cut. Documents
    without words are not read.
    """
    reads = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    whole = F.struct(*columns_of(docs))
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    rows = _planned(sized, _sized(docs, id_col, text_col, source_col, whole.alias("doc"), F.xxhash64(whole).alias("tie")), "tie")
    out = rows.select("doc", "key", "tie", F.explode(F.slice("positions", F.lit(1), reads)).alias("at"))
    n = shuffle_partitions(docs.sparkSession)
    out = out.repartitionByRange(n, "at", "key").sortWithinPartitions("at", "key", "tie")
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = plan_mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position")
    )
    # Documents that nothing is taken of have no position; the id keeps them from meeting in one range.
    return out.repartitionByRange(shuffle_partitions(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE place % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope FROM s),
f AS (
  SELECT *,
    coalesce(sum(source_size * 2) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
    (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM w),
l AS (SELECT *, (total - full_before::DOUBLE) / w_left::DOUBLE AS level_here FROM f),
lev AS (
  SELECT level_here AS level FROM l WHERE level_here * weight <= source_size * 2
  ORDER BY source_size::DOUBLE / weight, place LIMIT 1),
t AS (
  SELECT source, source_size, slope,
         least((source_size * 2)::DOUBLE, (SELECT level FROM lev) * weight) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - pos))
       + greatest(0, least(size, floor(target)::BIGINT - source_size - pos)) AS taken FROM c)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN pos / target
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (pos / target))) / (2 * slope) END END AS position
FROM k
"""
