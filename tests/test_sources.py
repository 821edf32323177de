from __future__ import annotations

import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from kvloom.functions.hashing import crc64_of
from kvloom.operators import replay, segments
from kvloom.sources import rdb, resp
from kvloom.sources import segments as seg


def command(*args: str) -> bytes:
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a.encode()), a.encode()) for a in args)


def read(data: bytes, **kw):
    r = rdb.SnapshotReader(io.BytesIO(data), **kw)
    return list(r), r


def test_snapshot_vectors():
    rows, r = read(b"REDIS0006\xff")
    assert rows == [] and r.version == 6
    with pytest.raises(rdb.CorruptSnapshot):
        read(b"XXXXX0006\xff")
    assert crc64_of(b"123456789") == 0xE9C6D914C4B8D9CA


def test_snapshot_values():
    s = rdb.encode_string
    body = (
        b"REDIS0009" + b"\xfa" + s(b"repl-id") + s(b"abc") + b"\xfe\x02\xfb\x05\x01" + b"\xfd" + (100).to_bytes(4, "little")
        + b"\x00" + s(b"a") + s(b"hello") + b"\x00" + s(b"n") + b"\xc0\xfe" + b"\x00" + s(b"m") + b"\xc1\x00\x80" + b"\x00" + s(b"l") + b"\xc2" + (7).to_bytes(4, "little")
        + b"\x01" + s(b"list") + b"\x02" + s(b"x") + s(b"y" * 70) + b"\x04" + s(b"hash") + b"\x01" + s(b"f") + s(b"v") + b"\x05" + s(b"z") + b"\x01" + s(b"m") + b"8bytes!!"
        + b"\x00" + s(b"lzf") + b"\xc3\x05\x0a" + b"\x00a\xe0\x00\x00"
        + b"\x0f" + s(b"stream") + b"\x00\x00\x00\x00" + b"\x06" + s(b"mod") + b"\x05\x05" + s(b"q") + b"\x00" + b"\xf8\x01\xf9\x07\xfc" + (1234567890).to_bytes(8, "little") + b"\x0a" + s(b"zl") + s(b"raw") + b"\xff"
    )
    rows, r = read(body)
    by_key = {k: (db, v, raw, ex, t) for db, k, v, raw, ex, t in rows}
    assert r.aux == [(b"repl-id", b"abc")]
    assert by_key[b"a"] == (2, b"hello", b"\x05hello", 100_000, 0)
    assert by_key[b"n"][1:] == (b"-2", b"\xc0\xfe", None, 0) and by_key[b"m"][1] == b"-32768" and by_key[b"l"][1] == b"7"
    assert by_key[b"list"][2] == b"\x02\x01x\x40\x46" + b"y" * 70 and by_key[b"z"][2].endswith(b"8bytes!!")
    assert by_key[b"lzf"][1] == b"a" * 10
    assert by_key[b"stream"][2] is None and b"mod" not in by_key
    assert by_key[b"zl"] == (2, b"raw", b"\x03raw", 1234567890, 10)
    for cut in range(10, len(body) - 1, 7):
        with pytest.raises((rdb.CorruptSnapshot, IndexError)):
            read(body[:cut])


def test_snapshot_crc():
    good = rdb.write_snapshot([(0, b"k", rdb.encode_string(b"v"), None, 0)])
    assert len(read(good, check_crc=True)[0]) == 1
    with pytest.raises(rdb.CorruptSnapshot):
        read(good[:-9] + b"\xff" + b"\x01" * 8, check_crc=True)


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("store"))
    rows = [(i % 3, b"key:%d" % i, rdb.encode_string(b"v%d" % i), 1_000_000 + i if i % 2 else None, 0) for i in range(300)]
    seg.write_snapshot_segment(base, "run_0", 0, rdb.write_snapshot(rows, [(b"repl-id", b"r0")]))
    w = seg.LogWriter(base, "run_0", 1000, log_size=500)
    for i in range(100):
        w.write(command("SET", f"key:{i}", f"new{i}"))
    w.write(command("DEL", "key:7"))
    seg.write_segment(base, "run_0", "junk.txt", b"x")
    return base


def test_batch_sources(spark, store):
    rdb.register(spark)
    resp.register(spark)
    a = rdb.read_snapshots(spark, store)
    b = spark.read.format("rdbSnapshot").option("path", store).load()
    assert a.count() == 300 and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    first = a.filter("pos = 1").first()
    assert (first.db, bytes(first.key), first.expire) == (1, b"key:1", dt.datetime(1970, 1, 1, 0, 16, 40, 1000))
    assert rdb.read_aux(spark, store).first().value == b"r0"
    x, y = resp.read_logs(spark, store), spark.read.format("respLog").option("path", store).load()
    assert x.count() == 101 and sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert x.filter("_error is not null").count() == 0
    ends = x.agg(F.max("end_offset")).first()[0]
    assert ends == 1000 + sum(len(command("SET", f"key:{i}", f"new{i}")) for i in range(100)) + len(command("DEL", "key:7"))


def test_malformed_log_gives_an_error_row(spark, tmp_path):
    seg.write_segment(str(tmp_path), "run_1", "0.aof", command("SET", "a", "b") + b"?bad\r\n")
    rows = resp.read_logs(spark, str(tmp_path)).collect()
    assert [r.name for r in rows] == ["SET", None] and rows[1]._error.startswith("InvalidType")
    with pytest.raises(Exception, match="InvalidType"):
        resp.read_logs(spark, str(tmp_path), mode="FAILFAST").collect()


def test_catalogue_and_bytes(spark, store):
    c = segments.read_catalogue(spark, store)
    assert c.filter("kind = 'rdb'").count() == 1 and c.filter("kind = 'aof'").count() > 3
    path = c.filter("kind = 'aof'").orderBy("offset").first().path
    assert bytes(seg.read_bytes(spark, path, 1000, 1000, 3).first().content) == b"*3\r"
    assert bytes(seg.read_bytes(spark, path, 1000, 10).first().content) == b""


def test_dump_payload(spark):
    d = spark.createDataFrame([(0, b"\x05hello"), (0, b""), (0, None)], "t int, raw binary")
    got = [r[0] for r in d.select(F.lower(F.hex(replay.dump_payload(F.col("t"), F.col("raw"))))).collect()]
    assert got == ["000568656c6c6f0900b3808eba31b243bb", None, None]


def test_written_commands_decode(spark, tmp_path):
    d = spark.createDataFrame([(i, ["SET", f"k{i}", "line\nbreak" if i % 2 else "é"]) for i in range(40)], "pos long, args array<string>")
    out = str(tmp_path / "run_0")
    seg.write_commands(d, out)
    import glob

    from kvloom.functions.wire import Decoder

    got = []
    for f in sorted(glob.glob(out + "/part-*")):
        x = Decoder()
        x.feed(open(f, "rb").read())
        got += [v.command()[1][0] for _, v in x]
    assert got == [b"k%d" % i for i in range(40)]
