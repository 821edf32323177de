"""Vector searches, language, toxicity, pipeline."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import same
from kvloom.llm import language, mtree, quantized_search, toxicity
from kvloom.llm.blocks import usable
from kvloom.llm.entries import QUERIES, SQL

BAD = [(1000, None), (1001, [float("nan")] * 8), (1002, [float("inf")] * 8), (1003, []), (None, [1.0] * 8), (1005, [None] * 8), (1020, [0.0] * 8), (1040, [1.0, 2.0])]


def vectors(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("dim", F.lit(1))
    return usable(d, "vec_id", "embedding")


def sample(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype("f4")
    x[5:60] = x[5]  # one vector many times
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_op1_equals_sql(spark, small):
    same(QUERIES["op1_mtree_topk"], SQL["op1_mtree_topk"], spark, small)


def test_products_against_brute_force(spark):
    rows = sample() + BAD + [(7, sample()[7][1])]
    d = vectors(spark, rows)
    got: dict = {}
    for r in mtree.top_products(d, d.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 20 == 0]:
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert mtree.top_products(d.limit(0), d.limit(0)).count() == 0


def test_tree_prunes_and_is_exact():
    """With the shipped pages: several nodes are opened and fewer products computed than there are rows."""
    rng = np.random.default_rng(1)
    x = np.floor(64 * (rng.normal(size=(40, 1, 8)) * 4 + rng.normal(size=(40, 50, 8)) * 0.2).reshape(-1, 8))
    tree = mtree.MTree.build(np.arange(len(x)), x)
    for q in range(0, 2000, 97):
        ids, scores = tree.search(x[q], q, 10)
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:10]
        assert ids.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
    assert tree.opened > 2 * 21 and tree.computed < 0.5 * 21 * len(x)
    same_point = mtree.MTree.build(np.arange(500), np.ones((500, 3)))
    assert same_point.search(np.ones(3), 3, 4)[0].tolist() == [0, 1, 2, 4]


def test_bounds_go_on_from_cell_to_cell(spark, monkeypatch):
    """Many cells and trees; clustered vectors, of which most cells need no visit."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 1, 6)) * 3 + rng.normal(size=(30, 60, 6)) * 0.1).reshape(-1, 6).astype("f4")
    x[:90] = x[0]
    d = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    for name, value in (("TREE_ROWS", 50), ("QUERY_ROWS", 30)):
        monkeypatch.setattr(mtree, name, value)
    got: dict = {}
    for r in mtree.top_products(d, d.filter("vec_id % 20 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = np.floor(64 * x.astype(float))
    for q in range(0, len(x), 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:7]
        assert sorted(got[q]) == [(k + 1, i, int(s[i])) for k, i in enumerate(want.tolist())]


def test_large_components_stay_exact(spark):
    big = [(i, [float(2**23 + i), float(i)]) for i in range(30)]
    d = vectors(spark, big)
    r = mtree.top_products(d, d.filter("vec_id = 20"), 1).first()
    v = [int(np.floor(64 * np.float32(x))) for x in (2**23 + 29, 29)]
    q = [int(np.floor(64 * np.float32(x))) for x in (2**23 + 20, 20)]
    assert r.score == sum(a * b for a, b in zip(q, v, strict=True)) and r.vec_id == 29


def test_nearest_recall_and_scores(spark):
    """With the shipped share of exact scores: 64 of 3,000 rows, so the codes decide."""
    rows = sample(3000, 16, 2) + [(5000, [0.0] * 16), *BAD]
    d = vectors(spark, rows).filter(F.exists("vector", lambda x: x != 0))
    got: dict = {}
    for r in quantized_search.nearest(d, d.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    ids = np.arange(3000)
    x = np.array([v for _, v in rows[:3000]], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        s[q] = -2
        want = np.lexsort((ids, -s))[:5]
        assert len(got[q]) == 5 and all(abs(v[1] - s[i]) < 1e-12 for i, v in got[q].items())
        hits += len(set(want) & set(got[q]))
    assert hits >= 0.9 * 300
    assert unit.shape == (3000, 16)
    assert quantized_search.nearest(d.limit(0), d.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "offset", "near copies"])
def test_nearest_inside_tight_groups(spark, kind):
    """Rows whose nearest ones differ by far less than rows do on the whole."""
    rng, n = np.random.default_rng(4), 3000
    x = rng.normal(size=(n, 16))
    if kind == "clusters":
        x = x[rng.integers(0, 6, n)] + 1e-2 * rng.normal(size=(n, 16))
    elif kind == "offset":
        x = 5 + x / 20
    else:
        x[: n // 3] = x[0] + 1e-5 * x[: n // 3]
    d = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got: dict = {}
    for r in quantized_search.nearest(d, d.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x, hits = np.array([r.vector for r in d.orderBy("vec_id").collect()], float), 0
    for q in range(0, n, 50):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] ** 2).sum()))
        s[q] = -2
        hits += len(set(np.lexsort((np.arange(n), -s))[:5].tolist()) & got[q])
    assert hits >= 0.95 * 300


def test_shares_of_blocks_lose_nothing(spark, monkeypatch):
    """Many blocks that give shares, several broadcasts and a second pass, against one block that gives all: also where a block holds far more than its share."""
    rows = sample(1500, 16, 5)
    near = [(6000 + i, [v + 1e-3 * ((i + j) % 7) for j, v in enumerate(rows[50][1])]) for i in range(90)]
    d = vectors(spark, rows + near)
    queries = d.filter("vec_id % 50 = 0")
    whole = quantized_search.nearest(d, queries, rerank=80)
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(quantized_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(quantized_search, "QUERY_ROWS", 9)
    assert sorted(map(tuple, quantized_search.nearest(d, queries, rerank=80).collect())) == want
    assert len(want) >= 5 * 30


def test_anisotropic_codes_beat_plain_ones_where_it_matters():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16))
    book = quantized_search.Codebook(16, x)
    codes = book.encode(x)
    assert codes.shape == (2000, 4) and codes.dtype == np.uint8
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    own = np.array([quantized_search.scan(codes[i : i + 1].T, book.tables(unit[i]))[0] for i in range(200)])
    plain = book._nearest(book._cut(x[:200]))
    shares = book._parallel(book._cut(x[:200]), plain).sum(axis=1)
    assert np.abs(1 - own).mean() < np.abs(shares).mean()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_scores_equal_plain_python(spark):
    """Words and n-grams counted and backed off in plain Python."""
    import math
    from collections import Counter

    import regex

    rng = random.Random(9)
    pool = {"en": "the cat sat on mats".split(), "de": "der hund über straße läuft".split(), "fr": "le chât déjà là".split()}
    docs = [(i, " ".join(rng.choices(pool[g], k=rng.randint(1, 9))) + rng.choice([".", " 12", "", "½"]), g) for i in range(60) for g in [rng.choice(list(pool))]]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    langs = sorted({g for _, _, g in docs})
    words = {g: Counter(w for _, t, h in docs if h == g for w in letters(t)) for g in langs}
    grams = {n: {g: Counter() for g in langs} for n in range(1, language.LONGEST + 1)}
    for g in langs:
        for w, c in words[g].items():
            p = f"^{w}$"
            for n in grams:
                for i in range(len(p) - n + 1):
                    grams[n][g][p[i : i + n]] += c

    def logs(table, key):
        keys = set().union(*table.values())
        if key not in keys:
            return None
        return [math.log((table[g][key] + language.SMOOTH) / (sum(table[g].values()) + language.SMOOTH * len(keys))) for g in langs]

    def score(word):
        if (known := logs(words, word)) is not None:
            return known
        p = f"^{word}$"
        for n in range(language.LONGEST, 0, -1):
            found = [x for i in range(len(p) - n + 1) if (x := logs(grams[n], p[i : i + n])) is not None]
            if found:
                return [sum(c) / len(found) for c in zip(*found, strict=True)]
        return [0.0] * len(langs)

    odd = [(1, "The catmat"), (2, "hundstraße!!"), (3, "½² Ⅷ ①"), (4, "déjà-vu the"), (5, "xyz"), (6, "e\u0301té"), (7, None), (8, "中文")]
    for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        found = letters(dict(odd)[r.doc_id] or "")
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = [sum(c) for c in zip(*map(score, found), strict=True)]
        p = [math.exp(t - max(total)) for t in total]
        assert r.lang_pred == langs[p.index(max(p))] and abs(r.score - max(p) / sum(p)) < 1e-9


def test_language_of_odd_rows(spark):
    docs = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)]
    model = language.train(spark.createDataFrame([*docs, (50, None, "en"), (51, "x", None)], "doc_id long, text string, lang string"))
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "the katzenhund und"), (4, "the the the"), (None, "und"), (6, "the " * 20000)]
    got = language.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en", "de", "en"]
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language.predict(spark.createDataFrame(odd, "doc_id long, text string"), none).collect()] == ["und"] * 7
    assert model.word("katzenhaus").argmax() == 0  # de is first


def test_language_memory_starts_over():
    m = language.Model(["a", "b"], language.Table(["x"], np.array([[5.0, 0]])), {n: language.Table(["y", "z"], np.array([[0, 3.0], [3, 0]])) if n == 1 else language.Table([], np.zeros((0, 2))) for n in range(1, language.LONGEST + 1)})
    s = language.Scorer(m)
    s.size = 5000
    s.clear()
    for k in range(5):
        assert s(" ".join(f"y{i}k{k}" for i in range(6000)))[0] == "b"
    assert s.used <= 5001


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op7_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    s = np.array([r.score for r in held])
    assert ((0 <= s) & (s <= 1)).all()
    auc = np.mean([(s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()])
    assert auc > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in held)


def test_toxicity_of_odd_rows(spark):
    good = "the weather is nice today and all of us went out"
    docs = [(i, f"you are such an idiot moron {i}" if i % 3 == 0 else f"{good} {i}") for i in range(300)]
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(5, 1), (None, 1), (7, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = [(1, None), (2, ""), (3, "You IDIOT!"), (4, "y0u m0r0n 1d1ot"), (5, good * 2000), (None, "idiot moron you")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("x", F.lit(3))
    got = toxicity.score(extra, model).collect()
    assert [r["__score"] >= 0.5 for r in got] == [False, False, True, True, False, True] and got[0].toxic == "x"
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["__score"] for r in toxicity.score(d, none).collect()} == {0.0}
    one = toxicity.train(d, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert {r["__score"] for r in toxicity.score(d, one).collect()} == {0.0}


def test_toxicity_scores_equal_plain_python(spark):
    """Trees walked one by one in plain Python over features counted one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "½ " * 5000), (-4, "YOU!!! " * 300 + "x"), (-4, "y0u")], "doc_id long, text string")
    f = toxicity.Featurizer(model.lexicon)
    weight = dict(model.lexicon)
    for r in toxicity.score(docs.union(odd), model, name="s").collect():
        text = r.text or ""
        codes = [f.classify(w) for w in text.split()]
        hits = [model.lexicon[c - toxicity.WORD][0] for c in codes if c >= toxicity.WORD]
        n, raw = max(1, len(codes)), text.encode()
        x = f(text)
        assert x[0] == len(hits) / n and x[2] == len(hits) and abs(x[1] - sum(weight[w] for w in hits) / n) < 1e-12
        at, you = ([i for i, c in enumerate(codes) if test(c)] for test in (lambda c: c >= toxicity.WORD, lambda c: c == toxicity.SECOND))
        assert x[4] == sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in at)
        assert abs(x[5] - sum(65 <= b < 91 for b in raw) / max(1, len(raw))) < 1e-12
        total = model.trees.start
        for feature, cut, value in model.trees.trees:
            node = 1
            while feature[node] >= 0:
                j = feature[node]
                node = 2 * node + int(sum(e <= x[j] for e in model.trees.edges[j]) > cut[node])
            total += value[node]
        a, p = model.at, model.probability
        k = sum(v <= total for v in a)
        flat = p[0] if k == 0 else p[-1] if k == len(a) else p[k - 1] + (p[k] - p[k - 1]) * (total - a[k - 1]) / (a[k] - a[k - 1])
        assert abs(r.s - min(1, max(0, 0.999 * flat + 0.001 / (1 + np.exp(-total))))) < 1e-9


def test_isotonic():
    at, p = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(p) > 0).all() and (np.diff(at) > 0).all() and p[0] == 0 and p[-1] == 1
