"""Filter rules compiled to Catalyst columns.

Rules are checked in a fixed order: database, command, never-forwarded commands,
then, for commands with a key, prefix white list, prefix black list, slot white
list, slot black list. The slot is the only costly part; it is left out of the
expression when no slot rule is given.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.functions.constants import NO_ROUTE, NO_ROUTE_STRICT
from kvloom.functions.hashing import key_slot
from kvloom.sources.shared import written


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with touching and overlapping ranges made one (for rule lists; tables use operators.ranges)."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def in_ranges(c: Column, ranges: list[tuple[int, int]]) -> Column:
    return _any([c.between(a, z) for a, z in merge_ranges(ranges)])


def has_prefix(key: Column, prefixes: list[str]) -> Column:
    """Key begins with one of the prefixes; an empty prefix fits every key. Pushed down to Parquet as StringStartsWith."""
    return _any([key.startswith(p) if p else F.lit(True) for p in dict.fromkeys(prefixes)])


def prefix_join(keys: DataFrame, prefixes: DataFrame, key_col: str = "key", prefix_col: str = "prefix") -> DataFrame:
    """Keys that begin with a prefix of a table of any size: an equality join on (length, start), not a nested loop."""
    p = prefixes.select(F.col(prefix_col).alias("__p")).filter(F.col("__p").isNotNull()).distinct()
    sizes = [r[0] for r in p.select(F.length("__p").alias("n")).distinct().orderBy("n").collect()]
    starts = keys.withColumn("__s", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring(F.col(key_col), F.lit(1), n))))) if sizes else keys.withColumn("__s", F.lit(None).cast("string"))
    return starts.join(p, F.col("__s") == F.col("__p"), "left_semi").drop("__s").distinct()


def any_starts_with(keys: DataFrame, probes: DataFrame, key_col: str = "key", probe_col: str = "probe") -> DataFrame:
    """(probe, found): whether a stored key begins with the probe."""
    q = probes.select(F.col(probe_col).alias("probe")).distinct()
    sizes = [r[0] for r in q.select(F.length("probe").alias("n")).filter("n IS NOT NULL").distinct().orderBy("n").collect()]
    places = F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")
    starts = keys.select(F.explode(F.transform(F.filter(places, lambda n: n <= F.length(key_col)), lambda n: F.substring(F.col(key_col), F.lit(1), n))).alias("__s")).distinct()
    return q.join(starts, F.col("probe") == F.col("__s"), "left").select("probe", F.col("__s").isNotNull().alias("found"))


@dataclass(frozen=True)
class RuleSet:
    db_black: tuple[int, ...] = ()
    cmd_black: tuple[str, ...] = ()
    prefix_white: tuple[str, ...] = ()
    prefix_black: tuple[str, ...] = ()
    slot_white: tuple[tuple[int, int], ...] = ()
    slot_black: tuple[tuple[int, int], ...] = ()
    strict: bool = False
    empty_tag_is_tag: bool = field(default=True)

    @classmethod
    def from_config(cls, config: str | dict) -> RuleSet:
        """From the filter section of a configuration (snake_case keys)."""
        c = json.loads(config) if isinstance(config, str) else config
        spans = lambda k: tuple((x["start"], x["end"]) if isinstance(x, dict) else tuple(x) for x in c.get(k) or ())
        return cls(
            tuple(c.get("db_black_list") or ()), tuple(c.get("cmd_black_list") or ()),
            tuple(c.get("key_prefix_white_list") or ()), tuple(c.get("key_prefix_black_list") or ()),
            spans("slot_white_list"), spans("slot_black_list"),
        )

    def _steps(self, cmd: Column, key: Column, db: Column) -> list[tuple[str, Column]]:
        has_key = key.isNotNull()
        steps = [("db", db.isin(*self.db_black)) if self.db_black else None]
        steps.append(("cmd", cmd.isin(*self.cmd_black)) if self.cmd_black else None)
        steps.append(("no_route", cmd.isin(*(NO_ROUTE_STRICT if self.strict else NO_ROUTE))))
        if self.prefix_white:
            steps.append(("prefix_white", has_key & ~has_prefix(key, list(self.prefix_white))))
        if self.prefix_black:
            steps.append(("prefix_black", has_key & has_prefix(key, list(self.prefix_black))))
        return [x for x in steps if x]

    def _slot_reason(self, key: Column) -> Column:
        """The slot rule that drops the key; the slot is bound once for both lists."""
        def rule(slot: Column) -> Column:
            out = F
            if self.slot_white:
                out = out.when(~in_ranges(slot, list(self.slot_white)), F.lit("slot_white"))
            if self.slot_black:
                out = out.when(in_ranges(slot, list(self.slot_black)), F.lit("slot_black"))
            return out

        return F.get(F.transform(F.array(key_slot(key, self.empty_tag_is_tag)), rule), F.lit(0))

    def reason(self, cmd: Column, key: Column, db: Column) -> Column:
        """Name of the first rule that drops the command; null if it is kept. Later rules are not evaluated."""
        out = F
        for name, hit in self._steps(cmd, key, db):
            out = out.when(F.coalesce(hit, F.lit(False)), F.lit(name))
        return out.when(key.isNotNull(), self._slot_reason(key)) if self.slot_white or self.slot_black else out

    def drops(self, cmd: Column, key: Column, db: Column) -> Column:
        return self.reason(cmd, key, db).isNotNull()

    def keeps_all_keys(self, cmd: Column, keys: Column, db: Column) -> Column:
        """For commands of several keys: kept only if no key is dropped."""
        none = ~self.drops(cmd, F.lit(None).cast("string"), db)
        return none & ~F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: self.drops(cmd, k, db))


def longest_prefix(keys: DataFrame, prefixes: DataFrame, key: str = "key", prefix: str = "prefix") -> DataFrame:
    """(key, prefix): each distinct key with the longest of prefixes that it begins with, null if there is none. Null keys and prefixes take no part.

    Keys and prefixes are sorted together by ranges, and one sweep over each
    range holds a stack of the prefixes that are open. Those that begin in an
    earlier range are prefixes of the range's first string, and shorter than any
    that begins later: they are looked up for one string of each range, and
    settle the keys that the sweep left open. The rule table may be of any size
    and its prefixes of any lengths; keys and prefixes are shuffled once.
    """
    def sweep(batches):
        part, first, stack = TaskContext.get().partitionId(), True, []
        for b in batches:
            out: list[tuple] = []
            for text, is_key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if first:
                    out.append((part, text, None, True))
                    first = False
                while stack and not text.startswith(stack[-1]):
                    stack.pop()
                if is_key:
                    out.append((part, text, stack[-1] if stack else None, False))
                else:
                    stack.append(text)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "text", "found", "first"])

    rules = prefixes.select(F.col(prefix).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    both = rules.withColumn("is_key", F.lit(False)).unionByName(keys.select(F.col(key).cast("string").alias("text")).filter("text IS NOT NULL").distinct().withColumn("is_key", F.lit(True)))
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = written(both.repartitionByRange(n, "text", "is_key").sortWithinPartitions("text", "is_key").mapInArrow(sweep, "part int, text string, found string, first boolean"), "prefix-sweep")
    # A string for each range, and a row for each of its lengths.
    starts = swept.filter("first").select("part", F.explode(F.transform(F.sequence(F.lit(0), F.length("text")), lambda i: F.substring(F.col("text"), F.lit(1), i))).alias("text"))
    carried = F.broadcast(starts).join(rules, "text").groupBy("part").agg(F.collect_list("text").alias("open"))
    met = swept.filter("NOT first").join(F.broadcast(carried), "part", "left")
    fits = F.filter("open", lambda p: F.col("text").startswith(p))
    longest = F.get(F.reverse(F.sort_array(F.transform(fits, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))), F.lit(0))["p"]
    return met.select(F.col("text").alias(key), F.coalesce("found", longest).alias(prefix))
