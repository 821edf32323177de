"""Segments that many tasks write and read: the same bytes as one stream writes, in bounded batches."""

from __future__ import annotations

import pathlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvloom.sources import rdb, resp, store
from kvloom.sources import segments as seg

ROWS = "run_id string, pos long, db int, key string, raw_value binary, expire_ms long, rdb_type int, lead binary"


def entries(n=3000):
    pick = random.Random(3)
    return [(f"r{i % 2}", i, pick.randrange(3), f"k{i}" + "x" * (i % 90), bytearray(rdb.encode_string(b"v" * (i % 100))), 10**12 + i if i % 3 == 0 else None, 0, bytearray(b"\xf9\x03") if i % 5 == 0 else None) for i in range(n)]


def test_snapshots_written_in_parts(spark, tmp_path):
    rows = entries()
    d = spark.createDataFrame(rows, ROWS)
    found = seg.write_snapshots(d, str(tmp_path), 7, {"ctime": "1"}).collect()
    assert len(found) == 2
    for r in found:
        own = [(db, k.encode(), bytes(raw), e, t, bytes(lead or b"")) for run, _, db, k, raw, e, t, lead in rows if run == r.run_id]
        assert pathlib.Path(r.path).read_bytes() == rdb.write_snapshot(own, [(b"ctime", b"1"), (b"repl-id", r.run_id.encode())])
    parts = seg._parts(d.select("run_id", "pos", "db", F.col("raw_value").alias("piece")), "pos", True)
    assert parts.filter("run_id = 'r0'").count() > 1


@pytest.mark.parametrize("size", [1, 900, 1 << 30])
def test_logs_written_in_parts(spark, tmp_path, size):
    rows = [("r0", i, b"*1\r\n$%d\r\n" % (i % 70) + b"x" * (i % 70) + b"\r\n") for i in range(2000)]
    seg.write_logs(spark.createDataFrame([(r, i, bytearray(x)) for r, i, x in rows], "run_id string, seq long, raw binary"), f"{tmp_path}/new", size).collect()
    seg.LogWriter(f"{tmp_path}/old", "r0", log_size=size).write_all(x for _, _, x in rows)
    new, old = ({p.name: p.read_bytes() for p in (tmp_path / k / "r0").iterdir()} for k in ("new", "old"))
    assert new == old


def test_aux_pairs_anywhere_and_damaged_checksums(spark, tmp_path):
    data = rdb.write_snapshot([(0, b"k%d" % i, rdb.encode_string(b"v" * 300), None, 0) for i in range(500)], [(b"a", b"b" * 100)])
    late = data[:-9] + b"\xfa" + rdb.encode_string(b"late") + rdb.encode_string(b"c" * 200) + b"\xff" + bytes(8)
    seg.write_snapshot_segment(f"{tmp_path}/a", "r", 0, late)
    assert {(bytes(r.key), bytes(r.value)) for r in rdb.read_aux(spark, f"{tmp_path}/a").collect()} == {(b"a", b"b" * 100), (b"late", b"c" * 200)}
    seg.write_snapshot_segment(f"{tmp_path}/b", "r", 0, data)
    index = rdb.snapshot_index(spark, f"{tmp_path}/b", 1000)
    assert index.count() > 50 and rdb.read_snapshots(spark, f"{tmp_path}/b", check_crc=True, index=index).count() == 500
    at = data.index(b"vvv")
    seg.write_snapshot_segment(f"{tmp_path}/c", "r", 0, data[:at] + b"w" + data[at + 1 :])
    with pytest.raises(Exception, match="checksum differs"):
        rdb.read_snapshots(spark, f"{tmp_path}/c", check_crc=True).collect()


def test_batches_of_long_values_are_bounded():
    rows = ((b"k", b"v" * (1 << 20)) for _ in range(40))
    sizes = [b.num_rows for b in rdb.batched(rows, [pa.binary(), pa.binary()], ["key", "value"])]
    assert sum(sizes) == 40 and max(sizes) <= 9


def test_short_splits_read_little(tmp_path):
    one = b"*2\r\n$3\r\nGET\r\n$3\r\nkey\r\n"
    path = seg.write_segment(str(tmp_path), "r", "0.aof", one * 100_000)
    with store.Ranged(path) as f:
        assert resp._follow(f, 0, 4096, 1 << 20) == -(-4096 // len(one)) * len(one) and f.n_read < 20_000
