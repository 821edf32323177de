from __future__ import annotations

from kvloom.operators import prefix_sum
from kvloom.operators.rules import RuleSet
from kvloom.sources import rdb
from kvloom.sources import segments as seg
from kvloom.streaming.job import COLUMNS, SyncJob
from test_sources import command


def keys(job):
    return {(r.db, bytes(r.key).decode()): bytes(r.value).decode() for r in job.keyspace(0).collect() if r.field is None}


def test_job_follows_select(spark, tmp_path, monkeypatch):
    base, out = str(tmp_path / "store"), str(tmp_path / "out")
    rows = [(db, b"k%d" % i, rdb.encode_string(b"old"), None, 0) for db in (0, 1, 2) for i in range(3)]
    seg.write_snapshot_segment(base, "run_0", 0, rdb.write_snapshot(rows))
    w = seg.LogWriter(base, "run_0", 0, log_size=60)
    w.write_all([command("SET", "k0", "zero"), command("SELECT", "1"), command("SET", "k0", "one"), command("SET", "new", "one"), command("DEL", "k1"), command("SELECT", "2"), command("SET", "k2", "black")])
    other = seg.LogWriter(base, "run_1", 0, log_size=60)
    other.write_all([command("SET", "other", "zero")])
    want = {(0, "k0"): "zero", (1, "k0"): "one", (1, "new"): "one", (0, "other"): "zero"}
    old = {(db, f"k{i}"): "old" for db in (0, 1, 2) for i in range(3)}
    del old[(1, "k1")]
    job = SyncJob(spark, base, out, rules=RuleSet(db_black=(2,)))
    job.run()
    job.wait()
    assert keys(job) == old | want
    w.write_all([command("SET", "later", "black"), command("SELECT", "1"), command("SET", "later", "one")])
    other.write_all([command("SET", "later", "zero")])
    job.restart()
    job.wait()
    assert keys(job) == old | want | {(1, "later"): "one", (0, "later"): "zero"}
    job.stop()
    monkeypatch.setattr(prefix_sum, "BITS", 5)
    batch = sorted(map(tuple, job.commands().select(*COLUMNS).collect()), key=str)
    log = spark.read.parquet(f"{out}/log").select(*COLUMNS)
    assert batch == sorted(map(tuple, log.collect()), key=str)


def test_job_applies_what_the_log_says(spark, tmp_path):
    """Options, many keys, fields, bytes that are no text, refused keys, unknown commands, and what follows malformed bytes in other runs."""
    base, out = str(tmp_path / "store"), str(tmp_path / "out")
    odd = b"\xff\x00k"
    raw = b"\x01" + rdb.encode_string(b"item")
    rows = [(0, odd, rdb.encode_string(b"\xfe"), 5000, 0), (0, b"list", raw, None, 1), (0, b"list2", raw, None, 1), (0, b"a2", rdb.encode_string(b"5"), 900, 0), (0, b"a", rdb.encode_string(b"1"), None, 0), (0, b"b", rdb.encode_string(b"2"), None, 0), (3, b"gone", rdb.encode_string(b"3"), None, 0)]
    seg.write_snapshot_segment(base, "run_0", 0, rdb.write_snapshot(rows))
    w = seg.LogWriter(base, "run_0")
    w.write_all([
        command("SET", "k", "v", "EX", "10"), command("del", "a", "b"), command("HSET", "h", "f", "1", "g", "2"), command("HDEL", "h", "g"), command("SET", "keep", "1", "PXAT", "77"),
        command("SET", "keep", "2", "KEEPTTL"), command("EXPIRE", "none", "5"), command("HSET", "none", "f", "1"), command("RENAME", "k", "z"), command("MSET", "m1", "x", "bad:1", "y"),
        command("EXPIRE", "a2", "soon"), command("HSET", "list2", "f", "1"), command("LPUSH", "l", "1"), command("DEL", "list", "bad:2"), command("SELECT", "3"), command("FLUSHDB"), command("SET", "after", "1"), b"$x\r\n",
    ])
    seg.LogWriter(base, "run_1").write_all([command("SET", "second", "1")])
    job = SyncJob(spark, base, out, rules=RuleSet(prefix_black=("bad:",)))
    job.run()
    job.wait()
    got = {(r.db, bytes(r.key), r.field and bytes(r.field)): (bytes(r.value), r.expire_ms, r.source) for r in job.keyspace(1000).collect()}
    assert got == {
        (0, odd, None): (b"\xfe", 5000, "snapshot"), (0, b"list", None): (raw, None, "snapshot"), (0, b"list2", None): (raw, None, "snapshot"), (0, b"a2", None): (b"5", 900, "snapshot"), (0, b"z", None): (b"v", 11000, "log"), (0, b"h", b"f"): (b"1", None, "log"),
        (0, b"keep", None): (b"2", 77, "log"), (0, b"none", b"f"): (b"1", None, "log"), (3, b"after", None): (b"1", None, "log"), (0, b"second", None): (b"1", None, "log"),
    }
    assert sorted((r.name or "", r.reason.split(":")[0]) for r in job.unapplied().collect()) == [("", "InvalidInteger"), ("EXPIRE", "malformed arguments"), ("HSET", "wrong type"), ("LPUSH", "not supported")]
    assert {k: v for k, v in job.metrics()["data"].items() if k != "offset"} == {"aof_commands_total": 16, "filtered_commands_total": 2, "sync_errors_total": 1}
    job.stop()
