"""Parallel prefix scans along long ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of a level holds up to two to this power blocks of the level below.
BITS = 12
#: How totals of blocks are made, how rows run inside a block, and how what came before meets what is here.
TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}
MEET = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)), "max": F.greatest, "min": F.least,
    "last": lambda before, here: F.coalesce(here, before),
}


def _running(kind: str, c: Column) -> Column:
    return F.last(c, ignorenulls=True) if kind == "last" else TOTAL[kind](c)


def scan(
    df: DataFrame, by: list[str], order: str, values: dict[str, tuple[str, Column]], tie: tuple[Column, ...] = (), exclusive: bool = False, span: int | None = None
) -> DataFrame:
    """df with running values along order, an integer column, for each by: {name: (sum, max, min or last, column)}.

    last is the last value that is not null. Rows of equal order follow tie. An
    exclusive value leaves its own row out. Any associative operation would do:
    rows run inside blocks of order, the blocks' totals inside blocks of blocks,
    and so on, until what is left of a by are some thousand totals. No window
    but that last one has a by, and no by at all, to itself: a log with all
    rows, or a table without by, is spread like any other. span bounds the
    absolute values of order; without it one aggregation finds it.
    """
    if span is None:
        found = df.agg(F.max(F.abs(F.col(order)))).first()[0]
        span = int(found or 0)
    d = df.withColumn("__block", F.shiftright(F.col(order).cast("long"), BITS))
    place = F.struct(F.col(order), *tie)
    rows = Window.partitionBy(*by, "__block").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    total = lambda kind, c: F.max_by(c, F.when(c.isNotNull(), place)) if kind == "last" else TOTAL[kind](c)
    blocks = d.groupBy(*by, "__block").agg(*[total(kind, c).alias(f"__{n}") for n, (kind, c) in values.items()])
    before = _before(blocks, by, "__block", {f"__{n}": kind for n, (kind, _) in values.items()}, span >> BITS)
    d = d.withColumns({n: _running(kind, c).over(rows) for n, (kind, c) in values.items()})
    d = d.join(before, [*by, "__block"], "left")
    return d.withColumns({n: MEET[kind](F.col(f"__{n}"), F.col(n)) for n, (kind, _) in values.items()}).drop("__block", *[f"__{n}" for n in values])


def _before(blocks: DataFrame, by: list[str], key: str, kinds: dict[str, str], span: int) -> DataFrame:
    """blocks (by, key, totals) with each total replaced by that of all blocks before it."""
    if span < 1 << BITS:
        w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumns({n: _running(kind, F.col(n)).over(w) for n, kind in kinds.items()})
    upper = f"{key}_"
    d = blocks.withColumn(upper, F.shiftright(key, BITS))
    total = lambda n, kind: F.max_by(n, F.when(F.col(n).isNotNull(), F.col(key))) if kind == "last" else TOTAL[kind](n)
    above = d.groupBy(*by, upper).agg(*[total(n, kind).alias(n) for n, kind in kinds.items()])
    above = _before(above, by, upper, kinds, span >> BITS).withColumnsRenamed({n: f"{n}_" for n in kinds})
    w = Window.partitionBy(*by, upper).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({n: _running(kind, F.col(n)).over(w) for n, kind in kinds.items()}).join(above, [*by, upper], "left")
    return d.withColumns({n: MEET[kind](F.col(f"{n}_"), F.col(n)) for n, kind in kinds.items()}).drop(upper, *[f"{n}_" for n in kinds])


def running_total(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """df with the running sum of value along order (a unique integer) for each by."""
    return scan(df, [by], order, {name: ("sum", F.col(value))})


#: Lengths of the leading parts of keys that make blocks inside blocks.
LEADING = (9, 12)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the place (from 1) of each row in the order of a unique string key.

    Keys are counted by their first characters, which are in key order too: rows
    are numbered inside their block, blocks inside the block of a shorter part,
    and one window goes over the blocks of the shortest part only.
    """
    parts = [f"__part{n}" for n in LEADING]
    d = df.withColumns({p: F.substring(key, 1, n) for p, n in zip(parts, LEADING, strict=True)})
    out = d.withColumn(name, F.row_number().over(Window.partitionBy(*parts).orderBy(key)).cast("long"))
    for i in range(len(parts)):
        blocks = d.groupBy(*parts[: i + 1]).agg(F.count("*").alias("__size"))
        before = Window.partitionBy(*parts[:i]).orderBy(parts[i]).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
        out = out.join(blocks, parts[: i + 1]).withColumn(name, F.col(name) + F.col("__before")).drop("__before")
    return out.drop(*parts)
