"""Log application against a dictionary that takes one command after the other."""

from __future__ import annotations

import random

import pytest

from kvloom.operators import apply as A
from kvloom.operators import prefix_sum

NOW = 1000


def brute(snapshot, log):
    """{(db, key): [string or None, {field: value}, expire]} after the log; sources are left out."""
    state: dict = {}
    for db, key, field, value, expire in snapshot:
        own = state.setdefault((db, key), [None, {}, expire])
        if field is None:
            own[0] = value
        else:
            own[1][field] = value
    for _, _, db, name, args in sorted(log):
        k = (db, args[0]) if args else None
        old = state.get(k)
        if name == "SET":
            state[k] = [args[1], {}, NOW + int(args[3]) * 1000 if len(args) == 4 else None if len(args) == 2 else (old or [0, 0, None])[2]]
        elif name == "DEL":
            for a in args:
                state.pop((db, a), None)
        elif name == "HSET" and (not old or old[0] is None):
            own = state.setdefault(k, [None, {}, None])
            own[1] = own[1] | dict(zip(args[1::2], args[2::2], strict=True))
        elif name == "HDEL" and old and old[0] is None:
            for f in args[1:]:
                old[1].pop(f, None)
            if not old[1]:
                del state[k]
        elif name == "EXPIRE" and old:
            old[2] = NOW + int(args[1]) * 1000
        elif name == "PERSIST" and old:
            old[2] = None
        elif name in ("SADD", "ZADD") and (not old or old[0] is None):
            own = state.setdefault(k, [None, {}, None])
            own[1] = own[1] | ({("set", m): None for m in args[1:]} if name == "SADD" else {("zset", m): s for s, m in zip(args[1::2], args[2::2], strict=True)})
        elif name in ("SREM", "ZREM") and old and old[0] is None:
            for m in args[1:]:
                old[1].pop((name[0].replace("S", "set").replace("Z", "zset"), m), None)
            if not old[1]:
                del state[k]
        elif name == "RENAME" and args[0] != args[1]:
            state.pop((db, args[1]), None)
            if old:
                state[db, args[1]] = state.pop(k)
        elif name == "FLUSHDB":
            state = {x: v for x, v in state.items() if x[0] != db}
        elif name == "FLUSHALL":
            state = {}
    return state


def applied(spark, snapshot, log):
    snap = spark.createDataFrame([(db, k, f, v, e) for db, k, f, v, e in snapshot], "db int, key string, field string, value string, expire_ms long")
    rows = spark.createDataFrame([(r, s, db, n, [a.encode() for a in args]) for r, s, db, n, args in log], "run_id string, seq long, db int, name string, args array<binary>")
    state: dict = {}
    for r in A.apply(snap, rows, NOW).collect():
        own = state.setdefault((r.db, bytes(r.key).decode()), [None, {}, r.expire_ms])
        assert own[2] == r.expire_ms
        if r.field is None:
            own[0] = bytes(r.value).decode()
        else:
            f = bytes(r.field).decode()
            own[1][f if r.kind == "hash" else (r.kind, f)] = None if r.value is None else bytes(r.value).decode()
    return state


def random_case(rnd, n, names, keys, runs=2):
    key, field = (lambda: rnd.choice(keys)), (lambda: rnd.choice("fgh"))
    snapshot = []
    for db in (0, 1):
        for k in keys:
            if rnd.random() < 0.3:
                snapshot.append((db, k, None, "old" + k, rnd.choice([None, 77])))
            elif rnd.random() < 0.5:
                e = rnd.choice([None, 88])
                snapshot += [(db, k, f, "old" + f, e) for f in "fg"]
    log = []
    for i in range(n):
        name = rnd.choice(names)
        args = {
            "SET": lambda i=i: [key(), f"v{i}", *rnd.choice([[], [], ["EX", str(i)], ["KEEPTTL"]])], "DEL": lambda: [key(), key()][: rnd.randint(1, 2)], "HSET": lambda i=i: [key(), field(), f"v{i}", field(), f"w{i}"],
            "HDEL": lambda: [key(), field(), field()], "EXPIRE": lambda i=i: [key(), str(i)], "PERSIST": lambda: [key()], "RENAME": lambda: [key(), key()], "FLUSHDB": list, "FLUSHALL": list, "SADD": lambda: [key(), field(), field()], "SREM": lambda: [key(), field(), field()],
            "ZADD": lambda i=i: [key(), str(i), field(), str(i / 4), "z"], "ZREM": lambda: [key(), field(), "z"], "GET": lambda: [key()],
        }[name]()
        log.append((f"r{i * runs // n}", i, rnd.choice([0, 0, 1]), name, args))
    return snapshot, log


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_without_renames(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_sum, "BITS", 4)
    rnd = random.Random(seed)
    snapshot, log = random_case(rnd, 400, ["SET", "DEL", "HSET", "HSET", "HSET", "HDEL", "HDEL", "HDEL", "EXPIRE", "PERSIST", "GET"] + ["FLUSHDB"] * (seed == 1), [f"k{i}" for i in range(12)])
    assert applied(spark, snapshot, log) == brute(snapshot, log)


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_with_renames(spark, seed):
    rnd = random.Random(10 + seed)
    names = ["SET", "HSET", "HSET", "HDEL", "EXPIRE", "DEL", *["RENAME"] * (3 + 3 * seed)] + ["FLUSHDB"] * (seed == 2)
    snapshot, log = random_case(rnd, 300, names, [f"k{i}" for i in range(9)])
    assert applied(spark, snapshot, log) == brute(snapshot, log)


def test_random_logs_of_sets_and_sorted_sets(spark):
    rnd = random.Random(30)
    snapshot, log = random_case(rnd, 400, ["SADD", "SREM", "SREM", "ZADD", "ZREM", "ZREM", "EXPIRE", "DEL", "RENAME", "SET", "HSET"], [f"k{i}" for i in range(9)])
    assert applied(spark, snapshot, log) == brute(snapshot, log)


def test_members_and_scores(spark):
    log = [
        ("SADD", ["s", "a", "b"]), ("SMOVE", ["s", "t", "a"]), ("ZADD", ["z", "CH", "1.5", "m", "2", "n"]), ("ZADD", ["z", "3", "m"]), ("HSETNX", ["h", "f", "1"]),
        ("ZADD", ["z", "NX", "9", "m"]), ("ZADD", ["z", "1"]), ("ZADD", ["z", "x", "m"]), ("ZADD", ["z", "1", "m", "x", "n"]), ("SADD", ["s"]), ("SMOVE", ["s", "t"]),
    ]
    rows = [("r", i, 0, n, a) for i, (n, a) in enumerate(log)]
    assert applied(spark, [], rows) == {(0, "s"): [None, {("set", "b"): None}, None], (0, "t"): [None, {("set", "a"): None}, None], (0, "z"): [None, {("zset", "m"): "3", ("zset", "n"): "2"}, None], (0, "h"): [None, {"f": "1"}, None]}
    d = spark.createDataFrame([(r, s, db, n, [a.encode() for a in args], None) for r, s, db, n, args in rows], "run_id string, seq long, db int, name string, args array<binary>, _error string")
    assert {r.seq: r.reason for r in A.unapplied(d).collect()} == {5: "not supported"} | {i: "malformed arguments" for i in range(6, 11)}


def test_snapshot_collections_become_elements(spark, tmp_path):
    from kvloom.functions import elements as E
    from kvloom.sources import rdb
    from kvloom.sources import segments as seg

    sets = [(None, None, b"%d" % i, None) for i in range(3)]
    zsets = [(None, None, b"m%d" % i, i / 2) for i in range(3)]
    rows = [(0, b"s%d" % t, E.raw_value(t, sets), 50, t) for t in (2, 11, 20)] + [(0, b"z%d" % t, E.raw_value(t, zsets), None, t) for t in (3, 5, 12, 17)]
    rows += [(0, b"l", E.raw_value(14, [(0, None, b"x", None)]), None, 14), (0, b"k", rdb.encode_string(b"v"), None, 0)]
    seg.write_snapshot_segment(str(tmp_path), "r", 0, rdb.write_snapshot(rows))
    got = sorted((bytes(r.key), r.kind, r.field and bytes(r.field), r.value and bytes(r.value), r.expire_ms) for r in E.entries(rdb.read_snapshots(spark, str(tmp_path))).collect())
    want = [(b"s%d" % t, "set", b"%d" % i, None, 50) for t in (2, 11, 20) for i in range(3)] + [(b"z%d" % t, "zset", b"m%d" % i, (b"0", b"0.5", b"1")[i], None) for t in (3, 5, 12, 17) for i in range(3)]
    assert got == sorted([*want, (b"l", "list", None, rows[-2][2], None), (b"k", "string", None, b"v", None)])


def test_long_chain_and_cycle_of_renames(spark):
    chain = [("r", i, 0, "RENAME", [f"c{i}", f"c{i + 1}"]) for i in range(60)]
    cycle = [("r", 100 + i, 0, "RENAME", [f"x{i % 3}", f"x{(i + 1) % 3}"]) for i in range(50)]
    log = [("r", -1, 0, "HSET", ["c0", "f", "1"]), *chain, ("r", 90, 0, "SET", ["x0", "v", "EX", "9"]), *cycle, ("r", 300, 0, "HSET", ["c60", "g", "2"])]
    assert applied(spark, [], log) == {(0, "c60"): [None, {"f": "1", "g": "2"}, None], (0, "x2"): ["v", {}, NOW + 9000]}


def test_snapshot_hashes_keep_their_fields(spark):
    snapshot = [(0, "h", "a", "1", 5), (0, "h", "b", "2", 5), (0, "s", None, "x", None)]
    log = [("r", 0, 0, "HSET", ["h", "c", "3"]), ("r", 1, 0, "HDEL", ["h", "a"]), ("r", 2, 0, "HSET", ["s", "f", "1"])]
    assert applied(spark, snapshot, log) == {(0, "h"): [None, {"b": "2", "c": "3"}, 5], (0, "s"): ["x", {}, None]}


def test_malformed_and_wrong_commands_change_nothing_and_are_listed(spark):
    snapshot = [(0, "k", None, "v", 5)]
    bad = [("EXPIRE", ["k", "bad"]), ("EXPIRE", ["k"]), ("SET", []), ("SET", ["k"]), ("SET", ["k", "w", "EX", "x"]), ("SETEX", ["k", "x", "w"]), ("MSET", ["k"]), ("HSET", ["k2", "f"]), ("HDEL", ["k"]), ("DEL", []), ("RENAME", ["k"])]
    log = [("r", i, 0, n, a) for i, (n, a) in enumerate(bad)] + [("r", 50, 0, "HSET", ["k", "f", "1"]), ("r", 51, 0, "LPUSH", ["k", "1"]), ("r", 52, 0, "GET", ["k"])]
    assert applied(spark, snapshot, log) == {(0, "k"): ["v", {}, 5]}
    rows = spark.createDataFrame([(r, s, db, n, [a.encode() for a in args], None) for r, s, db, n, args in log], "run_id string, seq long, db int, name string, args array<binary>, _error string")
    snap = spark.createDataFrame(snapshot, "db int, key string, field string, value string, expire_ms long")
    got = {r.seq: r.reason for r in A.unapplied(rows, snap).collect()}
    assert got == {i: "malformed arguments" for i in range(len(bad))} | {50: "wrong type", 51: "not supported"}


def test_empty_tables(spark):
    assert applied(spark, [], []) == {}
    assert applied(spark, [(0, "k", None, "v", None)], []) == {(0, "k"): ["v", {}, None]}
