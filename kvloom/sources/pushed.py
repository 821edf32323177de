"""Filters that Spark hands to the library's data sources, as tests of one value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

SETTING = "spark.sql.python.filterPushdown.enabled"
COMPARE = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b,
    D.LessThanOrEqual: lambda a, b: a <= b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a,
}


def enable(spark: SparkSession) -> None:
    """Sources that take filters are an error in Spark while this setting is off."""
    spark.conf.set(SETTING, "true")


def test_of(f: D.Filter) -> tuple[str, Callable] | None:
    """(column, test of a value) of a filter on one column; None for others. A null value passes no test but those of nulls, as in SQL."""
    if isinstance(f, D.Not):
        inner = test_of(f.child)
        if inner is None or isinstance(f.child, (D.IsNull, D.IsNotNull, D.EqualNullSafe)):
            return None
        return inner[0], lambda v: v is not None and not inner[1](v)
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = f.attribute[0]
    if isinstance(f, D.IsNotNull):
        return column, lambda v: v is not None
    if isinstance(f, D.IsNull):
        return column, lambda v: v is None
    if isinstance(f, D.In):
        known = {v for v in f.value if v is not None}
        return column, lambda v: v in known
    compare = next((c for kind, c in COMPARE.items() if type(f) is kind), None)
    return None if compare is None or f.value is None else (column, lambda v: v is not None and compare(v, f.value))


class Pushed:
    """Filters on some columns; take() keeps those it can answer and gives the others back."""

    def __init__(self, columns: tuple[str, ...]):
        self.columns, self.filters = columns, []

    def take(self, filters):
        for f in filters:
            found = test_of(f)
            if found and found[0] in self.columns:
                self.filters.append(f)
            else:
                yield f

    def tests(self) -> dict[str, Callable]:
        """By column, whether a value passes all of its filters."""
        by: dict[str, list] = {}
        for column, test in map(test_of, self.filters):
            by.setdefault(column, []).append(test)
        return {c: (lambda v, ts=ts: all(t(v) for t in ts)) for c, ts in by.items()}
