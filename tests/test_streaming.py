from __future__ import annotations

from kvloom.sources import rdb
from kvloom.sources import segments as seg
from kvloom.streaming import transactions
from kvloom.streaming.job import SyncJob
from test_sources import command


def test_job_applies_snapshot_then_growing_log(spark, tmp_path):
    base, out = str(tmp_path / "store"), str(tmp_path / "out")
    rows = [(0, b"key:%d" % i, rdb.encode_string(b"old%d" % i), None, 0) for i in range(10)]
    seg.write_snapshot_segment(base, "run_0", 0, rdb.write_snapshot(rows))
    w = seg.LogWriter(base, "run_0", 0, log_size=60)
    w.write_all([command("SET", "key:1", "new"), command("DEL", "key:2"), command("SET", "temp", "x"), command("CONFIG", "GET", "a")])
    job = SyncJob(spark, base, out)
    assert job.run()["code"] == 0
    job.wait()
    got = {bytes(r.key).decode(): bytes(r.value).decode() for r in job.keyspace(0).collect()}
    assert got["key:1"] == "new" and "key:2" not in got and got["key:3"] == "old3" and got["temp"] == "x"
    assert job.run()["code"] == 1  # already running
    whole = command("SET", "key:3", "later")
    w.write(whole[:10])
    assert job.restart()["code"] == 0
    job.wait()
    assert {bytes(r.key).decode(): bytes(r.value).decode() for r in job.keyspace(0).collect()}["key:3"] == "old3"
    with open(w.path, "ab") as f:
        f.write(whole[10:])
    assert job.pause()["code"] == 0 and job.pause()["code"] == 1 and job.resume()["code"] == 0
    job.wait()
    assert {bytes(r.key).decode(): bytes(r.value).decode() for r in job.keyspace(0).collect()}["key:3"] == "later"
    assert job.checkpoints().first().offset == w.at - 10 + len(whole)
    assert job.metrics()["data"]["aof_commands_total"] == 4
    assert job.status()["data"]["phase"] == "IncrSynced" and job.health()["code"] == 0 and job.log_level("nope")["code"] == 1
    assert job.gc(1).count() >= 1
    assert job.stop()["code"] == 0 and job.run()["code"] == 1


def test_streaming_transactions_equal_batch(spark, tmp_path):
    import random

    from kvloom.operators.state import transaction_status

    rnd = random.Random(2)
    rows = [(f"r{i % 3}", i, rnd.choice(["MULTI", "EXEC", "DISCARD", "SET"])) for i in range(300)]
    d = spark.createDataFrame(rows, "run_id string, seq long, cmd string")
    for k in range(3):
        d.filter(f"seq >= {k * 100} and seq < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, seq long, cmd string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = transactions.track(stream).writeStream.format("memory").queryName("txn_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.run_id, r.seq): (r.txn, r.in_txn) for r in spark.table("txn_out").collect()}
    want = {(r.run_id, r.seq): (r.txn, r.in_txn) for r in transaction_status(d).collect()}
    assert got == want


def test_stream_plans_by_size_and_keeps_cut_commands(spark, tmp_path, monkeypatch):
    """A command cut across three batches comes with the last; planning opens no file; what is malformed comes once and ends its log."""
    from kvloom.sources import resp

    base, out = tmp_path / "store", str(tmp_path / "out")
    long = command("SET", "long", "*2\r\n$3\r\nGET\r\n" * 200)
    first, last = command("SET", "a", "1"), command("SET", "z", "2")
    steps = [first + long[:5], long[5:900], long[900:1500], long[1500:] + last + b"$", b"x\r\n", last]
    path = base / "r" / "0.aof"
    path.parent.mkdir(parents=True)
    resp.register(spark)
    seen: list = []
    query = spark.readStream.format("respLog").option("path", str(base)).load().writeStream.foreachBatch(
        lambda d, i: seen.append(sorted((r.start_offset, r.name, (r._error or "")[:14]) for r in d.collect()))
    ).option("checkpointLocation", out).start()
    try:
        for s in steps:
            with open(path, "ab") as f:
                f.write(s)
            query.processAllAvailable()
    finally:
        query.stop()
    rows = [x for batch in seen for x in batch]
    at = len(first) + len(long)
    assert rows == [(0, "SET", ""), (len(first), "SET", ""), (at, "SET", ""), (at + len(last), None, "InvalidInteger")]
    reader = resp._LogStream({"path": str(base), "maxBytesPerTrigger": "1000"})
    monkeypatch.setattr(resp, "open", None, raising=False)
    assert [sum(__import__("json").loads(reader.latestOffset()["files"]).values()) for _ in range(3)] == [1000, 2000, min(3000, sum(map(len, steps)))]
