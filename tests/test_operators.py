from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvloom.config import ConfigError, load
from kvloom.functions import hashing as H
from kvloom.functions import wire as W
from kvloom.operators import ranges, rules, segments, state
from kvloom.operators.prefix_sum import running_total


def drops(spark, rule, rows):
    d = spark.createDataFrame(rows, "cmd string, key string, db int")
    return [r[0] for r in d.select(rule.drops(F.col("cmd"), F.col("key"), F.col("db"))).collect()]


@pytest.mark.parametrize(("rule", "rows", "want"), [
    (rules.RuleSet(db_black=(1, 2, 3)), [("SET", "user:123", 0), ("SET", "user:123", 1), ("SET", "user:123", 4)], [False, True, False]),
    (rules.RuleSet(cmd_black=("FLUSHDB", "FLUSHALL", "DEBUG")), [("FLUSHDB", None, 0), ("SET", "key", 0), ("AUTH", None, 0), ("flushdb", None, 0)], [True, False, True, False]),
    (rules.RuleSet(prefix_white=("user:", "order:")), [("SET", "user:profile:name", 0), ("SET", "temp:abc", 0)], [False, True]),
    (rules.RuleSet(prefix_black=("temp:", "cache:")), [("SET", "temp:123", 0), ("SET", "user:123", 0)], [True, False]),
    (rules.RuleSet((1, 2), ("FLUSHDB",), ("user:",), ("temp:",)), [("SET", "user:123", 1), ("SET", "user:123", 0), ("SET", "other:abc", 0), ("SET", "temp:abc", 0)], [True, False, True, True]),
    (rules.RuleSet(prefix_white=("user:",), slot_white=((0, 100),)), [("SET", "user:123", 0)], [True]),
    (rules.RuleSet(), [("PING", None, 0)], [False]),
])
def test_rules(spark, rule, rows, want):
    assert drops(spark, rule, rows) == want


def test_many_keys(spark):
    d = spark.createDataFrame([("DEL", ["user:1", "temp:2"]), ("DEL", ["user:1"]), ("PING", None)], "cmd string, keys array<string>")
    rule = rules.RuleSet(prefix_black=("temp:",))
    assert [r[0] for r in d.select(rule.keeps_all_keys(F.col("cmd"), F.col("keys"), F.lit(0))).collect()] == [False, True, True]


def test_prefix_is_pushed_down(spark, small):
    d = spark.read.parquet(f"{small}/customer.parquet").filter(rules.has_prefix(F.col("c_name"), ["Customer"]))
    assert "StringStartsWith" in d._jdf.queryExecution().executedPlan().toString()


def test_slots(spark):
    d = spark.createDataFrame([("foo", 12182), ("mykey", 14687), ("user:123", 12893), ("123456789", 12739), ("{user}:a", None), ("x{}y", 0), ("", 0)], "key string, slot int")
    got = {r.key: r.s for r in d.select("key", H.key_slot(F.col("key")).alias("s")).collect()}
    want = {r.key: r.slot for r in d.collect() if r.slot is not None}
    assert {k: got[k] for k in want} == want
    same = spark.createDataFrame([("user",)], "key string").select(H.key_slot(F.col("key"))).first()[0]
    assert got["{user}:a"] == same
    whole = d.filter("key = 'x{}y'").select(H.key_slot(F.col("key"), empty_tag_is_tag=False)).first()[0]
    assert whole != 0


def test_fnv(spark):
    def model(b):
        h = 14695981039346656037
        for x in b:
            h = (h ^ x) * 1099511628211 % 2**64
        return h

    words = ["", "hello", "a" * 50, "é中", "user:1"]
    d = spark.createDataFrame([(w,) for w in words], "k string").select("k", H.fnv_decimal(H.fnv1a(F.col("k"))).alias("h"), H.worker_index(H.fnv1a(F.col("k")), 5).alias("w"), H.worker_index(H.fnv1a(F.col("k")), 0).alias("z"))
    for r in d.collect():
        assert int(r.h) == model(r.k.encode()) and r.w == model(r.k.encode()) % 5 and r.z == 0
    assert model(b"hello") == 11831194018420276491


def test_crc64_goes_on(spark):
    d = spark.createDataFrame([(b"123456789", b"12345", b"6789")], "a binary, b binary, c binary")
    r = d.select(H.crc64("a").alias("x"), H.crc64_from("c", H.crc64("b")).alias("y")).first()
    assert r.x == r.y == 0xE9C6D914C4B8D9CA.to_bytes(8, "little")


@pytest.mark.parametrize(("cmd", "want"), [("MGET", [1, 2, 3, 4]), ("BITOP", [2, 3, 4]), ("RENAME", [1, 2]), ("PING", [0]), ("UNKNOWNCMD", None), ("get", None)])
def test_key_positions(spark, cmd, want):
    assert spark.range(1).select(W.key_positions(F.lit(cmd))).first()[0] == want


def test_ranges(spark):
    merged = lambda rs: sorted(map(tuple, ranges.merge(spark.createDataFrame(rs, "s long, e long")).collect()))
    assert merged([(0, 100), (50, 150), (200, 300), (250, 350)]) == [(0, 150), (200, 350)]
    assert merged([(1, 2), (3, 4), (6, 7)]) == [(1, 4), (6, 7)]
    rnd = random.Random(1)
    rs = [(a, a + rnd.randint(0, 300)) for a in (rnd.randint(0, 20000) for _ in range(200))]
    assert merged(rs) == rules.merge_ranges(rs)
    c = ranges.coverage(ranges.merge(spark.createDataFrame([(0, 100), (200, 300)], "s long, e long"))).first()
    assert tuple(c) == (2, 202)
    inside = ranges.contained(spark.createDataFrame([(0,), (16383,), (16384,)], "p long"), spark.createDataFrame([(0, 16383)], "s long, e long"), "p")
    assert {r.p: r.inside for r in inside.collect()} == {0: True, 16383: True, 16384: False}


def test_running_total_over_blocks(spark):
    rows = [("r", i, i % 7) for i in range(0, 20000, 3)]
    got = running_total(spark.createDataFrame(rows, "run string, i long, v long"), "run", "i", "v", "t").orderBy("i").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.t == total


def test_transactions(spark):
    from kvloom.streaming.transactions import next_status

    rnd = random.Random(5)
    rows = [(f"r{k}", i, rnd.choice(["MULTI", "EXEC", "DISCARD", "SET", "GET"])) for k in range(20) for i in range(60)]
    got = state.transaction_status(spark.createDataFrame(rows, "run_id string, seq long, cmd string"))
    want, last = {}, {}
    for r, i, c in rows:
        last[r] = next_status(last.get(r, "No"), c)
        want[r, i] = last[r]
    assert {(r.run_id, r.seq): r.txn for r in got.collect()} == want


def test_transaction_vectors():
    from kvloom.streaming.transactions import next_status

    def run(cmds):
        s, out = "No", []
        for c in cmds:
            s = next_status(s, c)
            out.append(s)
        return out

    assert run(["MULTI", "SET", "GET", "EXEC"]) == ["Begin", "In", "In", "Commit"]
    assert run(["MULTI", "SET", "DISCARD"]) == ["Begin", "In", "No"]
    assert run(["EXEC"]) == run(["DISCARD"]) == ["No"]
    assert run(["MULTI", "EXEC"]) == ["Begin", "Begin"]


def test_rotation_and_cadence(spark):
    d = spark.createDataFrame([("r", 0, 16), ("r", 1, 4), ("r", 2, 7), ("r", 3, 1)], "run_id string, seq long, size long")
    assert [r.seg for r in segments.rotate(d, 10).orderBy("seq").collect()] == [0, 16, 16, 27]
    e = spark.createDataFrame([("r", i, t) for i, t in enumerate([0, 10, 5000, 9000, 10001])], "run_id string, seq long, at_ms long")
    assert sorted(r.at_ms for r in segments.cadence(e, 5000).collect()) == [0, 5000, 10001]


def test_segment_vectors(spark):
    names = spark.createDataFrame([("1000_2048.rdb",), ("500.aof",), ("invalid.rdb",), ("1_2.aof",), ("99999999999999999999.aof",)], "n string")
    k, o, s = segments.parse_name(F.col("n"))
    assert [tuple(r) for r in names.select(k, o, s).collect()] == [("rdb", 1000, 2048), ("aof", 500, None), (None, None, None), (None, None, None), ("aof", None, None)]
    seg = spark.createDataFrame([("r", "rdb", 1000, 2048)], "run_id string, kind string, offset long, size long")
    probes = spark.createDataFrame([("r", o) for o in (999, 1000, 1500, 3047, 3048)], "run_id string, o long")
    assert sorted(r.o for r in segments.find_snapshot(probes, seg).collect()) == [1000, 1500, 3047]


def test_log_lookup_far_from_its_start(spark):
    seg = spark.createDataFrame([("r", "aof", 5, 10), ("r", "aof", 9_000_000, 10)], "run_id string, kind string, offset long, size long")
    probes = spark.createDataFrame([("r", o) for o in (0, 5, 8_999_999, 9_000_000, 50_000_000)], "run_id string, o long")
    assert {r.o: r.offset for r in segments.find_log(probes, seg).collect()} == {5: 5, 8_999_999: 5, 9_000_000: 9_000_000, 50_000_000: 9_000_000}


def test_gc(spark):
    import datetime as dt

    seg = spark.createDataFrame([("r", "rdb", i, 50, dt.datetime(2024, 1, 1 + i)) for i in range(5)], "run_id string, kind string, offset long, size long, created_at timestamp")
    assert [r.offset for r in segments.victims(seg, 200).collect()] == [0]
    assert segments.victims(seg, 250).count() == 0


def test_checkpoint_vectors(spark):
    ok = [("id_offset", "1000"), ("id_runid", "x"), ("id_version", "5"), ("id_mtime", "1234567890"), ("b_offset", "not_a_number"), ("b_version", "1"), ("b_mtime", "1"), ("c_offset", "1"), ("c_mtime", "1")]
    got = {r.replid: r for r in state.parse_fields(spark.createDataFrame(ok, "field string, value string")).collect()}
    assert (got["id"].offset, got["id"].version, got["id"].error) == (1000, 5, None)
    assert got["b"].error == "offset" and got["c"].error == "version"


def test_config():
    c = load('{"input": {"addresses": ["a:1"]}, "output": {"addresses": ["b:1"]}, "store": {"dir": "s"}}', "/base")
    assert c.store.dir == "/base/s" and c.replay.batch_size == 65536 and c.checkpoint_ms == 5000
    for bad in ('{"input": {"addresses": []}, "output": {"addresses": ["b"]}}', '{"output": {"addresses": ["b"]}}', "{", '{"input": {"addresses": ["a"], "x": 1}, "output": {"addresses": ["b"]}}', '{"input": {"addresses": ["a"]}, "output": {"addresses": ["b"]}, "store": {"max_size": 1}}'):
        with pytest.raises(ConfigError):
            load(bad)
