"""Ranged reads, splits of logs and snapshots, and stores."""

from __future__ import annotations

import io
import random

import pytest

from kvloom.sources import rdb, resp, store
from kvloom.sources import segments as seg
from test_sources import command


def log_rows(df):
    return sorted((r.run_id, r.start_offset, r.end_offset if r.end_offset is not None else -1, r.name or "", [bytes(a) for a in r.args or []], (r._error or "").split(":")[0]) for r in df.collect())


def one_log(spark, tmp_path, data, split, offset=0):
    seg.write_segment(str(tmp_path), "run_0", f"{offset}.aof", data)
    whole = sorted(
        (run, a, z if z is not None else -1, n or "", args or [], (e or "").split(":")[0]) for run, a, z, n, args, e in resp.decode_log("run_0", offset, iter([data]))
    )
    for s in split:
        assert log_rows(resp.read_logs(spark, str(tmp_path), split=s)) == whole, s
    return whole


def test_splits_of_a_log_with_commands_inside_values(spark, tmp_path):
    rnd = random.Random(4)
    fakes = [command("SET", "x", "y").decode(), "\r\n*3\r\n$3\r\nSET\r\n$1\r\n", "*1\r\n$4\r\nPING\r\n" * 3, "\r\n*2\r\n$3\r\nGET\r\n$900\r\n", "\r\n"]
    data = b""
    for i in range(150):
        data += command("SET", f"k{i}", "".join(rnd.choices(fakes, k=rnd.randint(0, 6))) + "v" * rnd.choice([0, 3, 700]))
        if i % 40 == 7:
            data += b"+OK\r\n:12\r\n$-1\r\n*0\r\n*-1\r\n"
    assert len(one_log(spark, tmp_path, data, [64, 333, 5000], offset=1000)) > 150


def test_a_value_over_many_splits_and_a_guess_that_goes_wrong(spark, tmp_path):
    # Inside the long value stands a command whose own value reaches to the end of the outer one and into the next command's value.
    inner = b"\r\n*2\r\n$3\r\nGET\r\n$%d\r\n"
    tail = command("SET", "z", "w" * 40)
    for n in (30, 31, 57):
        data = command("A", "b" * 90) + command("SET", "k", "q" * 100 + (inner % n).decode()) + command("X" * 30, "y") + tail * 5
        one_log(spark, tmp_path / str(n), data, [40, 64, 100])
    one_log(spark, tmp_path / "long", command("SET", "k", "*1\r\n$1\r\n" * 2000) + tail * 9, [128])


def test_cut_and_malformed_logs_end_where_they_do_without_splits(spark, tmp_path):
    good = command("SET", "k", "v" * 30) * 20
    for i, data in enumerate([good + b"*2\r\n$3\r\nGE", good + b"!bad\r\n" + good, good + b"*1\r\n$x\r\n" + good, good + b"*1\r\n:5\r\n" + good, b"", b"\r\n"]):
        if data:
            one_log(spark, tmp_path / str(i), data, [50, 400])


def snapshot(n: int) -> bytes:
    s = rdb.encode_string
    rows = [(i * 3 // n, b"k%d" % i, s(b"v" * (i * 31 % 400)) if i % 3 else b"\x02" + s(b"f") + s(b"x" * 90) + s(b"g") + b"\xc0\x05", 5000 + i if i % 4 == 0 else None, 0 if i % 3 else 4) for i in range(n)]
    rows += [(2, b"lzf", b"\xc3\x05\x0a\x00a\xe0\x00\x00", 77, 0), (2, b"big", s(b"y" * 200_000), None, 0), (2, b"long", b"\x80" + (20000).to_bytes(4, "big") + b"z" * 20000, None, 0), (2, b"longer", b"\x81" + (70).to_bytes(8, "big") + b"w" * 70, None, 0)]
    return rdb.write_snapshot(rows, [(b"ctime", b"1")])


@pytest.mark.parametrize("split", [1, 700, 50_000])
def test_parts_of_a_snapshot(spark, tmp_path, split):
    data = snapshot(300)
    seg.write_snapshot_segment(str(tmp_path), "run_0", 5, data)
    want = [(i, db, k, v, raw, e, t) for i, (db, k, v, raw, e, t) in enumerate(rdb.SnapshotReader(io.BytesIO(data)))]
    index = rdb.snapshot_index(spark, str(tmp_path), split)
    got = rdb.read_snapshots(spark, str(tmp_path), index=index).collect()
    assert sorted((r.pos, r.db, bytes(r.key), r.value and bytes(r.value), bytes(r.raw_value), r.expire and round(r.expire.timestamp() * 1000), r.rdb_type) for r in got) == want
    assert index.count() > (300 if split == 1 else 10 if split == 700 else 2)
    assert len(want) == 304


def test_the_index_is_made_without_reading_long_values(tmp_path):
    data = rdb.write_snapshot([(0, b"k%d" % i, rdb.encode_string(b"x" * 500_000), None, 0) for i in range(8)])
    path = seg.write_snapshot_segment(str(tmp_path), "r", 0, data)
    with store.Ranged(path) as f:
        marks = rdb.Skimmer(store.Cursor(f, piece=1 << 14)).marks(1)
        assert len(marks) >= 9 and f.n_read < len(data) / 20
    for cut in (9, 100, 400_000, len(data) - 9):
        path = seg.write_segment(str(tmp_path), "c", f"{cut}.rdb", data[:cut])
        with store.Ranged(path) as f, pytest.raises((rdb.CorruptSnapshot, IndexError)):
            rdb.Skimmer(store.Cursor(f)).marks(1)


def test_spans_and_cursors(tmp_path):
    data = random.Random(1).randbytes(100_000)
    path = seg.write_segment(str(tmp_path), "r", "x", data)
    with store.Ranged("file:" + path) as f:
        spans = sorted((random.Random(i).randrange(100_000), random.Random(i).randrange(300)) for i in range(200))
        assert store.read_spans(f, spans, most=5000, gap=100) == [data[a : a + n] for a, n in spans]
        c = store.Cursor(f, 10, piece=7)
        assert c.read(20) == data[10:30] and c.peek(3) == data[30:33] and c.skip(1000) and c.read(5) == data[1030:1035] and not c.skip(1 << 20)


def test_other_stores_are_an_error_and_no_local_folder(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rows = spark.createDataFrame([("r", 0, "x")], "run_id string, seq long, raw string")
    with pytest.raises(Exception, match="(?i)filesystem|file system|hdfs|scheme|nosuch"):
        seg.write_logs(rows, "nosuch://nn/ck/x").collect()
    for make in (lambda: seg.LogWriter("hdfs://nn/x", "r"), lambda: seg.write_segment("hdfs://nn/x", "r", "n", b"")):
        with pytest.raises(ValueError, match="no folder"):
            make()
    assert not list(tmp_path.iterdir())
