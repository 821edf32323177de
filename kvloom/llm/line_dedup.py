"""Line dedup over a whole corpus, in DataFrame operations only.

Method: hash every long line, range-partition the hashes with a secondary sort
by document and position, stream each hash's occurrences in that order, keep
the first, and return run-length-compressed keep bitmaps for each document
instead of text.

A hash shared by a third of all rows would make one range huge, so the range
key is (hash, block of ``BLOCK`` consecutive ids): a stream never holds more
than one block of a hash. Each block gives one summary row; the summaries of a
hash are added up (with map-side partial sums) and joined back on
(hash, block), so no step brings all rows of a hash together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.llm.common import columns_of, hash_pair, lower_ascii, materialize, quoted, shuffle_partitions, table, trim_space

#: Ids in one block of a hash's stream.
BLOCK = 4096
MIN_CHARS = 40
MIN_DOCS = 5


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line whose key has at least min_chars code points."""
    key = lower_ascii(trim_space(F.col("line")))
    rows = (
        docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
        .filter(F.col("doc").isNotNull() & (F.length("text") >= min_chars))
        .select("doc", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("doc", "row", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    h1, h2 = hash_pair(F.col("key"))
    return rows.select("doc", "row", "pos", h1.alias("h1"), h2.alias("h2"), F.floor(F.col("doc") / BLOCK).alias("block"))


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc, row, n_dropped, keep_runs) for each document that loses lines.

    ``keep_runs`` is the keep bitmap over the document's lines, run-length
    coded as (start, len) of each run of kept lines, the last one open-ended.
    ``row`` is xxhash64 of the text, so rows that repeat an id stay apart.

    Defined cases: null or empty text has one empty line, which stays; rows
    with a null id keep all lines and count for no key; rows that repeat an id
    count as one document for min_docs; of a repeated line inside the largest
    document all copies stay.
    """
    n = shuffle_partitions(docs.sparkSession)
    # Hashes only, no text: range sampling and both uses of the stream then read this table and not the corpus again.
    stream = (
        materialize(_lines(docs, id_col, text_col, min_chars), "lines")
        .repartitionByRange(n, "h1", "h2", "block")
        .sortWithinPartitions("h1", "h2", "block", F.desc("doc"), "pos")
    )
    w = Window.partitionBy("h1", "h2", "block").orderBy(F.desc("doc"), "pos")
    before = F.lag("doc").over(w)
    stream = stream.withColumn("new_doc", (before.isNull() | (before != F.col("doc"))).cast("long"))
    blocks = stream.groupBy("h1", "h2", "block").agg(F.sum("new_doc").alias("n"), F.max("doc").alias("last"))
    hot = (
        blocks.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.max("last").alias("owner"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "owner")
    )
    owners = blocks.select("h1", "h2", "block").join(hot, ["h1", "h2"])
    dropped = stream.join(owners, ["h1", "h2", "block"]).filter(F.col("doc") < F.col("owner")).select("doc", "row", "pos").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "row").orderBy("pos"))
    runs = (
        dropped.withColumn("island", island)
        .groupBy("doc", "row", "island")
        .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("len"))
        .groupBy("doc", "row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs"), F.sum("len").alias("n_dropped"))
    )
    last_end = "(element_at(runs, {0}).start + element_at(runs, {0}).len)"
    kept = F.expr(
        "transform(runs, (r, i) -> named_struct('start', if(i = 0, 0, " + last_end.format("greatest(i, 1)") + "),"
        " 'len', r.start - if(i = 0, 0, " + last_end.format("greatest(i, 1)") + ")))"
        " || array(named_struct('start', " + last_end.format("-1") + ", 'len', 2147483647))"
    )
    return runs.select("doc", "row", "n_dropped", kept.alias("keep_runs"))


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, kept, n_dropped): each row of docs as a struct, the text of its kept lines, the number of its dropped lines."""
    text = F.col(quoted(text_col))
    rows = docs.select(F.struct(*columns_of(docs)).alias("doc"), F.col(quoted(id_col)).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    runs = bitmaps.select(F.col("doc").alias("id_of"), F.col("row").alias("hash_of"), "n_dropped", "keep_runs")
    joined = rows.join(runs.hint("shuffle_hash"), (F.col("id") == F.col("id_of")) & (F.col("hash") == F.col("hash_of")), "left")
    # array(split(..)) binds the lines once for all runs.
    kept = F.expr(
        "transform(array(split(text, '\n', -1)), ls -> array_join(flatten("
        "transform(keep_runs, k -> slice(ls, k.start + 1, least(k.len, size(ls))))), '\n'))[0]"
    )
    return joined.select(
        "doc", F.when(F.col("keep_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with repeated lines removed from the text; all other columns and rows unchanged (null text: empty)."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **limits), id_col, text_col)
    return out.select(*[(F.col("kept") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs)).withColumn("t", F.coalesce("doc.text", F.lit("")))
    n_lines = F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) + 1
    return out.select("doc.doc_id", n_lines.cast("long").alias("n_lines"), "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id < h.owner) AS dropped
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
