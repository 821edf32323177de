"""Filters inside the data sources: same rows, fewer bytes."""

from __future__ import annotations

from pyspark.sql import datasource as D

from kvloom.sources import rdb, resp, store
from kvloom.sources import segments as seg
from test_sources import command


def files(base):
    for run in ("run_0", "run_1"):
        rows = [(db, b"%d:%d" % (db, i), rdb.encode_string(b"x" * 90_000) if i % 2 else b"\x01" + rdb.encode_string(b"y" * 300), 7000 if i == 3 else None, 0 if i % 2 else 2) for db in (0, 1, 3) for i in range(6)]
        seg.write_snapshot_segment(base, run, 0, rdb.write_snapshot(rows))
        seg.LogWriter(base, run).write_all([command(n, f"k{i}", "v") for i in range(5) for n in ("SET", "SETEX", "DEL")] + [b"!bad\r\n"])


def test_filters_give_the_rows_that_spark_would_keep(spark, tmp_path):
    base = str(tmp_path)
    files(base)
    rdb.register(spark), resp.register(spark)
    snap, log = (lambda: spark.read.format("rdbSnapshot").option("path", base).load()), (lambda: spark.read.format("respLog").option("path", base).load())
    columns = ["run_id", "pos", "db", "key", "rdb_type", "expire"]
    # Rows that no filter of the source has seen.
    known = spark.createDataFrame(snap().collect(), snap().schema)
    cases = ["db = 1", "db in (0, 3)", "not db in (0, 3)", "db <> 1", "db > 0 and db < 3", "rdb_type = 2", "run_id = 'run_1' and db >= 1 and rdb_type <> 2", "db is null", "db = 1 or rdb_type = 2", "db = 1 and pos % 2 = 0", "run_id like 'run%'"]
    for c in cases:
        assert sorted(map(repr, snap().filter(c).select(columns).collect())) == sorted(map(repr, known.filter(c).select(columns).collect())), c
    assert spark.read.format("rdbSnapshot").option("path", base).option("checkCrc", "true").load().filter("db = 1").count() == 12
    for c, n in (("name = 'SET'", 10), ("name like 'SET%'", 20), ("name <> 'DEL'", 20), ("name is null", 2), ("run_id = 'run_0'", 16), ("name in ('DEL') and run_id <> 'run_0'", 5)):
        assert log().filter(c).count() == n, c
    assert log().count() == 32


def test_passed_entries_are_not_read(tmp_path):
    base = str(tmp_path)
    files(base)
    reader = rdb._SnapshotFiles({"path": base})
    kept = D.EqualTo(("db",), 3), D.EqualTo(("rdb_type",), 2), D.EqualTo(("run_id",), "run_1")
    other = D.EqualTo(("key",), b"x")
    assert list(reader.pushFilters([*kept, other])) == [other]
    [part] = reader.partitions()
    with store.Ranged(part.path) as f:
        rows = list(reader.rows(part.run_id, f))
        assert [(r[1], r[2], r[7]) for r in rows] == [(12, 3, 2), (14, 3, 2), (16, 3, 2)]
        assert f.n_read < f.size * 0.8
    with store.Ranged(part.path) as f:
        assert len(list(rdb._SnapshotFiles({"path": base}).rows("r", f))) == 18 and f.n_read >= f.size
