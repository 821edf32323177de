"""Near copies, repeated strings, components."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import same
from kvloom.llm import components as cc
from kvloom.llm import jaccard_join as jj
from kvloom.llm import repeats
from kvloom.llm.entries import QUERIES, SQL


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            m = len(sets[a][1] & sets[b][1])
            if m and 100 * m >= 75 * (len(sets[a][1]) + len(sets[b][1]) - m):
                parent[root(a)] = root(b)
    least: dict = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def near_copies(rnd, n):
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    passage = [word() for _ in range(30)]
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rnd.randint(1, 60))]
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 6, 15])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w).title() if rnd.random() < 0.5 else "\n".join(w)))
    return rows


def test_join_against_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        monkeypatch.setattr(jj, "HOT_PAIRS", 256 if seed == 1 else 2)
        rows = near_copies(random.Random(seed), 220)
        rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one two three"), (5, rows[9][1]), (None, rows[3][1]), (None, "alone and without any id")]
        d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("n", F.lit(2))
        got = sorted(map(tuple, jj.similar_components(d).collect()), key=str)
        assert got == brute_components(rows)


def test_collided_classes_take_the_second_hash(spark):
    d = spark.createDataFrame([(1, 3, 7, 1), (2, 3, 7, 2), (3, 3, 8, 5), (4, 0, None, None), (5, 3, 8, 5)], "id long, n long, class long, other long")
    assert jj.collided(d) == [7]
    words = "a b c d e f g h i j k l m n o p".split()
    docs = spark.createDataFrame([(i, " ".join([*words, str(i)])) for i in range(3)], "doc_id long, text string")
    known = [jj.class_of(jj.shingles(r.text.encode())) for r in docs.collect()]
    assert {r["class"] for r in jj.prefixes(docs, 50).collect()} == {a for a, _ in known}
    assert {r["class"] for r in jj.prefixes(docs, 50, rehash=[known[1][0]]).collect()} == {known[0][0], known[1][1], known[2][0]}
    assert all(a != b for a, b in known)


def test_join_empty_and_pipeline_form(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jj.similar_components(empty).count() == 0
    rows = [(1, "a b c d e f g h", "x"), (2, "A B C D E F G H", "y"), (3, "q r s", None), (None, "a b c d e f g h", "z")]
    kept = jj.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert kept.columns == ["doc_id", "text", "component"] and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def test_group_of_near_copies_that_do_not_all_link(spark):
    """Every copy differs from the others in several places: links form chains, and no pair may be missed."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(80)] = f"x{rnd.random()}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, jj.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_prefix_choice():
    import numpy as np

    assert jj.choose_prefix(100, 60, np.array([2] * 40)) == (0, 0)
    match, k = jj.choose_prefix(100, 20, np.array([2] * 5 + [5000] * 75))
    assert match >= 1 and k == 25 + match - 20


def test_op8_equals_sql(spark, small):
    same(QUERIES["op8_jaccard_join"], SQL["op8_jaccard_join"], spark, small)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# Repeats ---------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        runs = sum(1 for p in range(len(b)) if hit[p] and (p == 0 or not hit[p - 1]))
        out[i] = (len(b), sum(hit), runs, bytes(x for x, h in zip(b, hit, strict=True) if not h))
    return out


def check_repeats(spark, rows, **limits):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("z", F.lit(1))
    got = {r[0]: (r[1], r[2], r[3], bytes(r[4])) for r in repeats.remove_repeats(d, **limits).collect()}
    assert got == brute_repeats(rows)


def test_repeats_against_brute_force(spark):
    rnd = random.Random(3)
    pool = ["abcde" * 30, "x" * 150, "é" * 60, "The quick brown fox jumps over the lazy dog. " * 3] + ["".join(rnd.choices("abcd efgh", k=rnd.randint(1, 160))) for _ in range(12)]
    rows = [(i, "".join(rnd.choices(pool, k=rnd.randint(0, 6)))) for i in range(250)] + [(1000, None), (1001, ""), (1002, "x" * 5000), (1003, "ab" * 99), (-4, pool[3])]
    check_repeats(spark, rows)


def test_a_transform_is_in_suffix_order_and_steps_back():
    rnd = random.Random(2)
    for _ in range(60):
        texts = ["".join(rnd.choices("ab", k=rnd.randint(0, 30))).encode() for _ in range(rnd.randint(1, 8))]
        t = repeats.Transform(np.frombuffer(b"".join(texts), "u1"), np.array([len(x) for x in texts]))
        # Terminators are less than all bytes and ordered by their string.
        suffixes = sorted(([(1, c) for c in x[i:]] + [(0, j)], j, i) for j, x in enumerate(texts) for i in range(len(x) + 1))
        assert list(zip(t.string, t.offset, strict=True)) == [(j, i) for _, j, i in suffixes]
        for place, (_, j, i) in enumerate(suffixes):
            assert t.last[place] == (texts[j][i - 1] + 1 if i else 0)
            assert not i or (t.string[t.step[place]], t.offset[t.step[place]]) == (j, i - 1)


@pytest.mark.parametrize("shards,limit", [(1, 10**6), (4, 10**6), (9, 10)])
def test_interleaving_gives_the_intervals_of_common_prefixes(monkeypatch, shards, limit):
    """Several shards, of which none has sorted another's suffixes."""
    monkeypatch.setattr(repeats, "MERGE_WINDOWS", limit)
    rnd = random.Random(shards)
    for rounds in (2, 3, 6):
        made = [["".join(rnd.choices("abc", k=rnd.randint(0, 25))).encode() for _ in range(rnd.randint(1, 5))] for _ in range(shards)]
        ts = [repeats.Transform(np.frombuffer(b"".join(x), "u1"), np.array([len(y) for y in x])) for x in made]
        where = [(s, j, i) for s, t in enumerate(ts) for j, i in zip(t.string.tolist(), t.offset.tolist(), strict=True)]
        want = {}
        for s, x in enumerate(made):
            for j, y in enumerate(x):
                for i in range(len(y) - rounds + 1):
                    want.setdefault(y[i : i + rounds], set()).add((s, j, i))
        entry, interval = repeats.interleave(ts, rounds)
        got = {}
        for e, k in zip(entry.tolist(), interval.tolist(), strict=True):
            got.setdefault(k, set()).add(where[e])
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_repeats_in_pieces_and_parts(spark, monkeypatch):
    """Small limits: texts are hashed in pieces, items are cut, shards and merges are many, all anchors are hot."""
    rnd = random.Random(8)
    long = "".join(rnd.choices("abcdefgh \n", k=1500))
    rows = [(i, long[rnd.randrange(400) : rnd.randrange(600, 1500)] + "".join(rnd.choices("xyz", k=50))) for i in range(30)]
    rows += [(40, "x" * 900), (41, "ab" * 300 + long[:200]), (42, long[:130] * 3)]
    for name, value in (("PIECE", 256), ("SHARD_ITEMS", 40), ("SHARD", 700), ("MERGE", 20_000), ("MERGE_WINDOWS", 500), ("ITEM_WINDOWS", 64), ("HOT", 0)):
        monkeypatch.setattr(repeats, name, value)
    for _, t in rows:
        assert sum(len(p) - 99 for _, p in repeats._pieces(t.encode())) == len(t) - 99
    x = [t.encode() for _, t in sorted(rows)]
    joined = b"".join(x)
    place, first = repeats.repeated_windows(np.frombuffer(joined, "u1"), np.array([len(t) for t in x]))
    assert len(place) and all(joined[p : p + 100] == joined[f : f + 100] and f < p for p, f in zip(place, first, strict=True))
    hit = bytearray(len(joined))
    for p in place:
        hit[p : p + 100] = b"\1" * 100
    assert sum(hit) == sum(v[1] for v in brute_repeats(rows).values())
    data = [(i, 7, at, p) for i, t in rows for at, p in repeats._pieces(t.encode())]
    for _, _, at, p in data:
        anew = repeats._filed_anew(p, at)
        assert sum(n for _, _, n, _ in anew) == max(0, len(p) - 99) and all(len(d) == n + 99 and d == p[a - at : a - at + n + 99] for _, a, n, d in anew)
    check_repeats(spark, rows, hot=0)


def test_repeats_of_rows_that_repeat_an_id(spark):
    a, b, c = ("".join(random.Random(i).choices("abcdefgh ", k=400)) for i in range(3))
    for rows, lost in (([(3, a), (3, a)], {0}), ([(4, a), (4, b)], {0}), ([(4, a), (4, a + b), (4, a)], {0, 400}), ([(1, c), (4, a), (4, c), (4, c)], {0, 400})):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = repeats.remove_repeats(d).collect()
        assert len(got) == len(rows) and {r.n_removed for r in got} == lost


def test_repeats_empty_and_null_ids(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "a passage that is longer than a hundred bytes " * 4
    d = spark.createDataFrame([(None, t), (2, t), (3, t), (3, t)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed > 0) for r in repeats.remove_repeats(d).collect())
    assert got == [("2", True), ("3", True), ("3", True), ("None", False)]


def test_op9_on_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in brute_repeats(rows).items()}
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op9_repeat_removal"](spark, small).collect()} == want
