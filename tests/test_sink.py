"""Log segments as a sink: offsets, aborts, exactly one copy of a batch; CRC-64 of long values; longest prefixes."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from kvloom.functions import hashing
from kvloom.operators import rules
from kvloom.sources import resp, sink


def frame(spark, rows):
    return spark.createDataFrame([(r, s, [a.encode() for a in args], "more") for r, s, args in rows], "run_id string, seq long, args array<binary>, name string")


def commands(n, runs=2, first=0):
    return [(f"r{i % runs}", i, ["SET", f"k{i}", "v" * (i % 50)]) for i in range(first, first + n)]


def read(spark, base):
    rows = resp.read_logs(spark, base).orderBy("run_id", "start_offset").collect()
    at = {}
    for r in rows:  # offsets without gaps
        assert r.start_offset == at.get(r.run_id, 0) and r._error is None
        at[r.run_id] = r.end_offset
    return [(r.run_id, [r.name, *(bytes(a).decode() for a in r.args)]) for r in rows]


def test_batches_append_behind_one_another(spark, tmp_path):
    base = str(tmp_path)
    resp.register(spark)
    rows = commands(300)
    for part in (rows[:200], rows[200:]):
        frame(spark, part).repartitionByRange(3, "run_id", "seq").sortWithinPartitions("run_id", "seq").write.format("respLog").mode("append").save(base)
    assert read(spark, base) == [(r, a) for r, _, a in sorted(rows)]
    assert len(os.listdir(f"{base}/r0")) >= 2 and not [n for n in os.listdir(f"{base}/.parts") if not n.endswith(".json")]


def test_failed_writes_leave_nothing(spark, tmp_path):
    base = str(tmp_path)
    resp.register(spark)
    save = lambda d: d.write.format("respLog").mode("append").save(base)
    rows = commands(100, 1)
    broken = frame(spark, rows).withColumn("args", F.when(F.col("seq") == 77, F.lit(None)).otherwise(F.col("args")))
    for bad in (broken.repartitionByRange(4, "seq").sortWithinPartitions("seq"), frame(spark, rows).repartition(3, "seq"), frame(spark, rows).drop("args"), frame(spark, [*rows, *rows]).coalesce(1)):
        with pytest.raises(Exception, match="(?i)null|overlap|ascend|missing"):
            save(bad)
    assert read(spark, base) == []
    assert not [n for d, _, names in os.walk(base) for n in names if not n.endswith(".json")]
    save(frame(spark, rows).coalesce(1))
    assert len(read(spark, base)) == 100
    with pytest.raises(Exception, match="append"):
        frame(spark, rows).write.format("respLog").mode("overwrite").save(base)


def test_a_stream_batch_that_runs_again_adds_nothing(spark, tmp_path):
    base, schema = str(tmp_path / "store"), frame(spark, []).schema
    s = sink.LogStreamSink({"path": base}, schema, False)
    row = lambda r, i, a: {"run_id": r, "seq": i, "args": [x.encode() for x in a]}
    rows = [row(*x) for x in commands(20, 1)]
    s.commit([s.write(iter(rows[:10])), s.write(iter(rows[10:]))], 0)
    s.commit([s.write(iter(rows))], 0)
    s.abort([s.write(iter(rows))], 1)
    assert len(read(spark, base)) == 20
    # Broken off between its note and its renames: the next run ends it.
    message = s.write(iter([row(*x) for x in commands(5, 1, 20)]))
    was = os.replace
    try:
        os.replace = lambda a, z: was(a, z) if z.endswith(".json") else (_ for _ in ()).throw(OSError("stopped"))
        with pytest.raises(OSError, match="stopped"):
            s.commit([message], 1)
    finally:
        os.replace = was
    assert len(read(spark, base)) == 20
    s.commit([s.write(iter([row(*x) for x in commands(5, 1, 20)]))], 1)
    assert [a[1] for _, a in read(spark, base)] == [f"k{i}" for i in range(25)]


def test_stream_to_segments(spark, tmp_path):
    resp.register(spark)
    rows = commands(120)
    for k in range(3):
        frame(spark, rows[k * 40 : k * 40 + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("respLog").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(read(spark, str(tmp_path / "out"))) == sorted((r, a) for r, _, a in rows)


def test_crc64_of_long_values():
    loop = lambda data, crc=0: [crc := crc >> 8 ^ hashing._CRC64[(crc ^ b) & 255] for b in data][-1] if data else crc
    rnd = random.Random(2)
    for n in (0, 1, 4095, 4096, 4097, 70_001):
        data, start = rnd.randbytes(n), rnd.getrandbits(64)
        assert hashing.crc64_of(data, start) == loop(data, start) and hashing.crc64_of(data) == loop(data)
        cut = n // 3
        assert hashing.crc64_joined(hashing.crc64_of(data[:cut], start), hashing.crc64_of(data[cut:]), n - cut) == loop(data, start)
    data = bytes(1) + rnd.randbytes(1 << 20) * 20
    begin = time.perf_counter()
    hashing.crc64_of(data)
    assert time.perf_counter() - begin < 4


def test_longest_prefix(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abé", k=rnd.randint(0, n)))
    prefixes, keys = {word(6) for _ in range(60)} | {"zz", "ab" * 90}, {word(12) for _ in range(400)} | {"", "ab" * 100, "zzz"}
    got = rules.longest_prefix(spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "key string").repartition(5), spark.createDataFrame([(p,) for p in [*prefixes, None]], "prefix string"))
    want = {k: max((p for p in prefixes if k.startswith(p)), key=len, default=None) for k in keys}
    assert {r.key: r.prefix for r in got.collect()} == want and got.count() == len(keys)
    assert rules.longest_prefix(spark.createDataFrame([], "key string"), spark.createDataFrame([("a",)], "prefix string")).count() == 0
    assert {r.prefix for r in rules.longest_prefix(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "prefix string")).collect()} == {None}
