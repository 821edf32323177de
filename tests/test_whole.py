"""Queries that have to take all rows of their input."""

from __future__ import annotations

import random

from kvloom import queries as q
from kvloom.operators import prefix_sum, replay
from kvloom.operators.prefix_sum import numbered


def test_places_and_switches_go_on_from_block_to_block(spark, monkeypatch):
    rnd = random.Random(5)
    keys = sorted({"".join(rnd.choices("ab:é1", k=rnd.randint(0, 16))) for _ in range(400)})
    rows = [(k, rnd.choice([0, 0, 1, 2])) for k in keys]
    d = spark.createDataFrame(rnd.sample(rows, len(rows)), "key string, db int")
    placed = numbered(d, "key", "pos")
    assert sorted((r.pos, r.key) for r in placed.collect()) == list(enumerate(keys, 1))
    monkeypatch.setattr(prefix_sum, "BITS", 3)
    want = [(i + 1, db) for i, (_, db) in enumerate(rows) if db != (rows[i - 1][1] if i else 0)]
    assert sorted(map(tuple, replay.select_switches(placed).collect())) == want


def test_payloads_of_all_types_and_lengths(spark):
    sizes = [0, 1, 63, 64, 16383, 16384]
    rows = [(f"k{i}", t, 0, "v" * n) for i, (t, n) in enumerate((t, n) for t in (0, 1, 2, 4, 5) for n in sizes)] + [("none", 0, 0, None)]

    class Fixed:
        keyspace = spark.createDataFrame(rows, "key string, rdb_type int, db int, value string")

    lengths = {r.key: r.n for r in q.dump_payload_len(Fixed).collect()}
    payloads = {r.key: r.payload for r in q.dump_payload(Fixed).collect()}
    assert set(lengths) == set(payloads) == {r[0] for r in rows}
    assert lengths["none"] is None and payloads["none"] is None
    for key, kind, _, value in rows[:-1]:
        n = len(value)
        code = f"{n:02X}" if n < 64 else f"{n + 0x4000:04X}" if n < 16384 else f"80{n:08X}"
        body = f"{kind:02X}{code}{value.encode().hex().upper()}0900"
        assert payloads[key][:-16] == body and lengths[key] == len(payloads[key]) // 2 == len(body) // 2 + 8


def test_every_kind_of_key_has_a_payload(spark, small):
    got = {r.kind for r in q.QUERIES["dump_payload"](spark, small).selectExpr("split(key, ':')[0] AS kind").distinct().collect()}
    assert got == {"customer", "order", "part", "supplier", "nation"}
