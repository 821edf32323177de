"""Audit of how filters interact: what each removes, alone and in every order.

Method: a relational word pipeline. Words are exploded and aggregated by
(document, word), then by document, for totals and distinct words; the other
flags are joined, and per part 32 conditional counts, one for each set of
failing filters, hold all that any order of the filters can say.

Nothing is collected by text or part: the first document of each text is found
by an aggregation with map-side combining and met by its own id, so that a text
or part with a third of all rows makes no large group.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import UPPER, materialize, quoted, shuffle_partitions, table

FILTERS = "ABCDE"
MIN_WORDS = 200
SETS = range(1 << len(FILTERS))
MARKS = "[#$%&*|]"
#: What stands between words.
WHITE = r"[\x20\x09-\x0D]+"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, n_words, n_distinct) of each id and text that has words; row is xxhash64 of the text, so that rows that repeat an id stay apart.

    Texts are dealt before they are exploded: all words of a text are then
    aggregated where they arise, and no word is shuffled. Rows that repeat id
    and text count together, n_words is the sum over all of them.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "doc", "row")
    each = rows.select("doc", "row", F.explode(F.split("text", WHITE)).alias("word")).filter("word <> ''")
    by_word = each.groupBy("doc", "row", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc", "row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc, part, fails): for each row its part and the set of filters that it fails, A as 1 to E as 16.

    Defined cases: null text counts as empty, a null part as the empty string; a
    row with a null id is never E, and no other row is E because of it; rows that
    repeat an id and text are not E for each other.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc"), F.coalesce(F.col(quoted(part_col)), F.lit("")).alias("part"), text.alias("text"))
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    flags = materialize(rows.select(
        "doc", "part", F.xxhash64("text").alias("row"), F.unhex(F.sha2("text", 256)).alias("sha"),
        (capitals * 100 > F.length("text") * 3).alias("c"), F.col("text").rlike(MARKS).alias("d"),
    ), "audit-flags")
    first = flags.filter("doc IS NOT NULL").groupBy("sha").agg(F.min(F.struct("doc", "row")).alias("f")).select("sha", "f.doc", "f.row", F.lit(True).alias("first"))
    same = lambda other: F.col("x.doc").eqNullSafe(F.col(f"{other}.doc")) & (F.col("x.row") == F.col(f"{other}.row"))
    met = flags.join(first, ["doc", "row", "sha"], "left").alias("x")
    met = met.join(word_counts(docs, id_col, text_col).alias("w"), same("w"), "left")
    met = met.join(flags.groupBy("doc", "row").agg(F.count("*").alias("copies")).filter("copies > 1").alias("y"), same("y"), "left")
    n_words = F.coalesce(F.col("n_words"), F.lit(0)) / F.coalesce(F.col("copies"), F.lit(1))
    bits = [
        n_words < MIN_WORDS, F.coalesce("n_distinct", F.lit(0)) * 100 < n_words * 50, F.col("c"), F.col("d"),
        F.col("x.doc").isNotNull() & F.col("first").isNull(),
    ]
    fails = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return met.select("x.doc", "part", fails.alias("fails"))


def set_counts(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, n, good, toxic): for each part three arrays of counts by set of failing filters: rows, those of quality 1, those toxic. Several labels of an id: any counts; labels of a null id count for no row."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    sums = rows.join(known, "doc", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    each = [F.sum(F.when(F.col("fails") == s, F.col(c)).otherwise(0)).alias(f"{c}{s}") for c in ("n", "good", "toxic") for s in SETS]
    return sums.groupBy("part").agg(*each).select("part", *[F.array(*[f"{c}{s}" for s in SETS]).alias(c) for c in ("n", "good", "toxic")])


def report(counts: DataFrame) -> DataFrame:
    """The audit's rows from set_counts: for each part, order of filters and step."""
    steps = []
    for order in itertools.permutations(FILTERS):
        for i, name in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": i + 1, "own": 1 << FILTERS.index(name), "before": sum(1 << FILTERS.index(x) for x in order[:i])})
    rows = counts.select("part", "n", "good", "toxic", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, own int, before int>>")).alias("s"))
    rows = rows.select("part", "n", "good", "toxic", "s.*")

    def total(counted: str, where: str, times: str = "1") -> Column:
        terms = f"transform({counted}, (x, s) -> if({where}, x * {times}, 0L))"
        return F.expr(f"aggregate({terms}, 0L, (a, x) -> a + x)")

    here, orders = "(s & own) != 0 AND (s & before) = 0", len(steps) // len(FILTERS)
    return rows.select(
        "part", "filter_order", "step", total("n", "(s & (own | before)) = 0").alias("kept"), total("n", here).alias("removed"),
        total("n", "(s & own) != 0 AND (s & before) != 0").alias("redundant"), total("n", "s = own").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # Of all orders, a document that fails k filters goes by each of them in one of k.
        total("n", "(s & own) != 0", f"({orders} div bit_count(s))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley); no rows for an empty table."""
    return report(set_counts(failing(docs, id_col, text_col, part_col), labels))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {
    'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, fails[filter_order[step]] AS own,
        len(list_filter(string_split(filter_order[:step - 1], ''), lambda y: y <> '' AND fails[y])) > 0 AS earlier,
        len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: fails[y])) AS n_fails FROM k, s),
g AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN own AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g
"""
