"""Prefix scans over several levels of blocks against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvloom.operators import prefix_sum, ranges


@pytest.mark.parametrize("bits", [1, 3, 12])
@pytest.mark.parametrize("exclusive", [False, True])
def test_scan(spark, monkeypatch, bits, exclusive):
    monkeypatch.setattr(prefix_sum, "BITS", bits)
    rnd = random.Random(bits)
    places = rnd.sample(range(-40, 900), 160)
    rows = [(rnd.choice("ab"), p, j, rnd.choice([None, rnd.randint(-9, 9)])) for p in places for j in range(rnd.choice([1, 1, 2]))]
    d = spark.createDataFrame(rows, "by string, at long, tie int, v long")
    values = {"total": ("sum", F.col("v")), "most": ("max", F.col("v")), "least": ("min", F.col("v")), "last": ("last", F.col("v"))}
    got = {(r.by, r.at, r.tie): (r.total, r.most, r.least, r.last) for r in prefix_sum.scan(d, ["by"], "at", values, (F.col("tie"),), exclusive).collect()}
    assert len(got) == len(rows)
    for key in "ab":
        seen: list = []
        for _, at, tie, v in sorted(r for r in rows if r[0] == key):
            before = [x for x in seen if x is not None]
            seen.append(v)
            now = before if exclusive else [x for x in seen if x is not None]
            want = (sum(now), max(now, default=None), min(now, default=None), now[-1] if now else None)
            assert got[key, at, tie] == want


def test_merge_over_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix_sum, "BITS", 2)
    rnd = random.Random(8)
    rows = [(a, a + rnd.choice([-1, 0, 1, 5, 90])) for a in rnd.sample(range(0, 3000), 150)] + [(1 << 60, (1 << 60) + 3), ((1 << 60) + 4, (1 << 60) + 9)]
    inside = set()
    for a, z in rows[:-2]:
        inside |= set(range(a, z + 1))
    want = sorted((a, next(z for z in range(a, 4000) if z + 1 not in inside)) for a in inside if a - 1 not in inside)
    monkeypatch.setattr(prefix_sum, "BITS", 9)
    assert sorted(map(tuple, ranges.merge(spark.createDataFrame(rows, "s long, e long")).collect())) == [*want, (1 << 60, (1 << 60) + 9)]
