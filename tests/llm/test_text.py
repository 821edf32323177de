"""Tokens, shards, lines, mixing."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import same
from kvloom.llm import bpe, line_dedup, mixing, sstable
from kvloom.llm.entries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é" * 50), (5, "word " * 5000), (5, "word " * 5000), (None, "no id"), (-7, "x" * 20000), (9, "a\x1cb\x85c d<|endoftext|>E")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.SegmentTreeBpe(bpe.default_vocabulary())


PARTS = ["a", "b", "the", "ing", "'s", "'", "é", "é", "ß", "İ", "中", "\x1c", "\x85", "　", " ", "\n", "<|endoftext|>", "<|", "1", "99", "!", "?!", "\x00", "​", "😀", "ﬁ", "The"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25).map("".join))
def test_bpe_equals_the_library(text):
    lib = test_bpe_equals_the_library.library
    ids = lib.encode(text, add_special_tokens=False).ids
    tree = test_bpe_equals_the_library.own
    assert tree.encode(text) == ids and tree.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    raw, decoded = tree.encode_both(text)
    assert raw == struct.pack(f"<{len(ids)}I", *ids) and decoded.decode() == tree.decode(ids)


@pytest.fixture(autouse=True)
def _give(library, own):
    test_bpe_equals_the_library.library, test_bpe_equals_the_library.own = library, own


def test_segment_tree_on_one_long_word(library, own):
    for text in ("aaaab" * 4000, "x" * 9999, "!" * 3001, "abcdefghijklmnopqrstuvwxyz" * 500):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded():
    m = bpe.Memory(str.upper, 10)
    for i in range(100):
        assert m[f"k{i % 37}"] == f"K{i % 37}"
        assert len(m) <= 10 and len(m.old) <= 10


def test_op4_on_odd_rows(spark, library):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted(map(tuple, bpe.digest_documents(d).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digest_documents(d.limit(0)).count() == 0
    full = {r.doc_id: list(r.ids) for r in bpe.encode_documents(d).collect()}
    assert full[9] == library.encode(ODD[-1][1], add_special_tokens=False).ids
    assert {r.doc_id: (r.n_tokens, list(r.ids)) for r in bpe.encode_ids(d).collect()}[9] == (len(full[9]), full[9])


def test_op4_on_documents(spark, small, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op4_bpe"](spark, small).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


# Shards ----------------------------------------------------------------


def _expected(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_shards_of_odd_rows(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 20_000)
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    out = str(tmp_path / "sst")
    sstable.write_shards(d, out)
    got = sorted(map(tuple, sstable.digest_shards(spark, out).collect()), key=lambda r: r[1])
    assert got == _expected(ODD, library)
    assert sorted((r.doc_id for r in sstable.lookup(spark, out, [5, -7, 12345]).collect())) == [-7, 5, 5]
    rows = {r.doc_id: struct.unpack(f"<{len(r.ids) // 4}I", r.ids) for r in sstable.read_shards(spark, out).collect()}
    assert list(rows[9]) == [*library.encode(ODD[-1][1], add_special_tokens=False).ids, 1]


def test_lookups_read_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 2000)
    writer = sstable.ShardWriter(4)
    for i in range(0, 4000, 2):
        writer.add(sstable.make_key(i), np.arange(i % 60))
    (tmp_path / "one").write_bytes(writer.finish())
    writer = sstable.ShardWriter(4)
    for i in range(4000, 5000):
        writer.add(sstable.make_key(i), np.arange(3))
    (tmp_path / "two").write_bytes(writer.finish())
    store = sstable.ShardStore(spark, str(tmp_path))
    opened = store.n_read
    assert [len(x) for x in store.get(1234)] == [1234 % 60] and [len(x) for x in store.get(4999)] == [3] and store.get(10**9) == []
    assert sum(len(store.get(i)) for i in range(1, 400, 2)) == 0
    assert opened < store.size / 10 and store.n_read < store.size / 4


def test_shards_of_an_empty_table(spark, tmp_path):
    out = str(tmp_path / "sst")
    sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), out)
    assert sstable.digest_shards(spark, out).count() == 0


def test_op2_on_documents(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_sstable_output"](spark, small).collect()), key=lambda r: r[1])
    assert got == _expected(rows, library)


def test_shard_lookup_and_damage():
    import numpy as np

    w = sstable.ShardWriter(4)
    ids = sorted(random.Random(3).sample(range(-(10**12), 10**12), 3000))
    for i in ids:
        w.add(sstable.make_key(i), np.arange(i % 50))
    data = w.finish()
    s = sstable.Shard.of(data)
    assert s.n_blocks > 3 and [i for i, _ in s] == ids
    assert all(len(s.get(i)[0]) == i % 50 for i in ids[::97])
    assert s.get(5 * 10**12) == []
    hits = sum(s.may_contain(i) for i in range(2 * 10**12, 2 * 10**12 + 2000))
    assert hits < 60
    with pytest.raises(ValueError):
        sstable.Shard.of(data[:-3])
    with pytest.raises(ValueError):
        w.add(sstable.make_key(ids[0]), np.arange(1))


# Lines -----------------------------------------------------------------


def _dedup(rows):
    keep = lambda s: s.strip(" \t\n\x0b\f\r").translate(str.maketrans(mixing_upper, mixing_upper.lower()))
    owners: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(keep(line)) >= 40:
                owners.setdefault(keep(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(owners.get(keep(x), ())) >= 5 and len(keep(x)) >= 40 and i != max(owners[keep(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


mixing_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_op10_equals_sql(spark, small):
    same(QUERIES["op10_line_dedup"], SQL["op10_line_dedup"], spark, small)


def test_lines_against_brute_force(spark):
    rnd = random.Random(7)
    pool = ["Shared line number %d with more than forty letters é" % i for i in range(6)] + ["  SHARED line number 1 with more than forty letters é\r", "short", "", "\t"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 7)))) for i in range(60)] + [(None, pool[0]), (100, None), (101, pool[0] + "\n" + pool[0]), (20_000, pool[2]), (3, pool[1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("pos", F.lit(1)).withColumn("block", F.lit(2))
    d = d.withColumn("__kept", F.lit("mine")).withColumn("__dropped", F.lit(3)).withColumn("kept", F.lit("too")).withColumn("my `odd` name", F.lit(4))
    out = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d))
    got = sorted(((r.doc.doc_id, r.n_dropped, r.kept) for r in out.collect()), key=str)
    assert got == sorted(((i, n, k) for i, _, n, k in _dedup(rows)), key=str)
    clean = line_dedup.dedup_lines(d)
    assert clean.columns == d.columns and clean.count() == len(rows)
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# Mixing ----------------------------------------------------------------


def test_op5_equals_sql(spark, small):
    same(QUERIES["op5_mixing"], SQL["op5_mixing"], spark, small)


def _water(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **share}
        full |= over


def test_mix_on_odd_rows(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), rnd.choice(["a", "b", "c", "hot", "hot", "hot", None, "é"])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (None, "x y", "b"), (None, "x y", "b"), (777, "t " * 9, "c"), (777, "t " * 9, "c"), (600, "u\x0bv w", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("target", F.lit(1)).withColumn("key", F.lit(1))
    got = mixing.plan_mix(d).collect()
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = _water(sizes)
    source = {i: s for i, _, s in rows if i is not None}
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        s = source.get(r.id, "b")
        assert abs(r.target - target[s]) < 1e-6 * (1 + target[s]) and r.source_size == sizes[s] and r.taken <= 2 * r.size
        assert all(0 <= p <= 1 for p in r.positions)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(d.repartition(7)).collect()))
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    # Every row is read as often as the words taken of it say, to the nearest whole; rows that repeat an id have plans of their own.
    reads: dict = {}
    for r in got:
        reads[r.id, r.size] = reads.get((r.id, r.size), 0) + (math.floor(r.taken / r.size + 0.5) if r.size else 0)
    seen: dict = {}
    for r in mixed.collect():
        seen[r.doc_id, size(r.text)] = seen.get((r.doc_id, size(r.text)), 0) + 1
    assert seen == {k: n for k, n in reads.items() if n}
    # In order of training time.
    first = {r.id: r.positions for r in got if r.id not in (None, 777) and len(r.positions) == 1}
    times = [first[r.doc_id][0] for r in mixed.collect() if r.doc_id in first]
    assert len(times) > 20 and times == sorted(times)
    assert mixing.plan_mix(d.limit(0)).count() == 0
    only_empty = d.filter("source = 'empty'")
    assert [r.taken for r in mixing.plan_mix(only_empty).collect()] == [0] and mixing.mix(only_empty).count() == 0
