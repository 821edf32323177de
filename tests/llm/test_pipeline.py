"""The pipeline against plain Python, and its stages on odd tables."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from kvloom.llm import bpe, toxicity
from test_copies import brute_components
from test_text import _dedup, _water

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_score(model, text: str) -> float:
    """The model's trees and calibration, one document at a time."""
    x = toxicity.Featurizer(model.lexicon)(text)
    total = model.trees.start
    for feature, cut, value in model.trees.trees:
        node = 1
        while feature[node] >= 0:
            node = 2 * node + int(sum(e <= x[feature[node]] for e in model.trees.edges[feature[node]]) > cut[node])
        total += value[node]
    a, p = model.at, model.probability
    k = sum(v <= total for v in a)
    flat = p[0] if k == 0 else p[-1] if k == len(a) else p[k - 1] + (p[k] - p[k - 1]) * (total - a[k - 1]) / (a[k] - a[k - 1])
    return min(1, max(0, 0.999 * flat + 0.001 / (1 + math.exp(-total))))


def plain_mix(rows: list[tuple]) -> list[tuple]:
    """(doc_id, text, source) for each reading, in order of training time."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, slopes = _water(sizes), {s: (-0.5, 0.0, 0.5)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out = []
    for s in sizes:
        at, demand, slope = 0, math.floor(target[s]), slopes[s]
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: key(r[0])):
            n = size(t)
            parts = [max(0, min(n, demand - sizes[s] * e - at)) for e in (0, 1)]
            reads = math.floor(sum(parts) / max(1, n) + 0.5)
            for e in range(reads):
                u = (at + sizes[s] * e) / target[s]
                out.append((u if slope == 0 else (slope - 1 + math.sqrt((1 - slope) ** 2 + 4 * slope * u)) / (2 * slope), key(i), i, t, s))
            at += n
    return [x[2:] for x in sorted(out)]


def test_pipeline_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if plain_score(model, r.text or "") < 0.5]
    source = {i: s for i, _, s in rows}
    rows = [(i, t) for i, _, _, t in _dedup([(i, t) for i, t, _ in rows])]
    first = {i: c for i, _, c in brute_components(rows)}
    rows = [(i, t, source[i]) for i, t in rows if first[i] == i]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = [(i, library.encode(t, add_special_tokens=False).ids) for i, t, _ in plain_mix(rows)]
    got = [(r.doc_id, list(r.ids)) for r in cp.run(spark, SF).collect()]
    assert len(first) > len(rows) > 100 and sorted(got) == sorted(want) and all(len(x) for _, x in got)


LINE = "a shared line that is longer than forty letters, found in many documents"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "short text of seven words in all", "en", "a", 5), (3, "short text of seven words in all", "en", "a", 5),
    (None, "no id but some words here as well", "de", "b", 1), (None, None, None, None, None), (4, "word " * 30_000, "en", "b", 9), (5, "ümläut\u0000 \x1c <|endoftext|>\n\n", "fr", "c", 2),
    *[(100 + i, f"{LINE}\nown words number {i} of this very document", "en", "hot", 3) for i in range(8)], (200, LINE, "en", "hot", 1), (201, LINE.upper(), "en", "hot", 1),
]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_tables(spark, name, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table, more columns with clashing names."""
    stage = dict(cp.STAGES)[name]
    names = ("text_", "__score", "__kept", "id", "key", "class", "component", "n", "size", "positions", "doc", "at", "ids", "n_tokens", "a `b`")
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(c) for c in names})
    spark.createDataFrame([(i, 0, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for d in (docs, docs.limit(0), spark.createDataFrame(ODD, SCHEMA)):
        d.write.mode("overwrite").parquet(f"{tmp_path}/in")
        given = spark.read.parquet(f"{tmp_path}/in")
        out = stage(spark, given, str(tmp_path))
        out.write.mode("overwrite").parquet(f"{tmp_path}/out")
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        if name == "bpe":
            assert out.columns == ["doc_id", "n_tokens", "ids"] and len(rows) == given.count() and all(r.n_tokens == len(r.ids) for r in rows)
            continue
        assert out.columns == given.columns
        if not given.count():
            assert not rows
        elif name == "toxicity":
            assert sorted(map(str, rows)) == sorted(map(str, given.collect()))
        elif name == "line_dedup":
            assert len(rows) == len(ODD) and {(r.doc_id, r.text) for r in rows if r.doc_id in (1, 3, 200, 201)} == {(1, ""), (3, ODD[3][1]), (200, ""), (201, LINE.upper())}
            assert {r.text for r in rows if r.doc_id and 100 <= r.doc_id < 108} == {f"own words number {i} of this very document" for i in range(8)}
        elif name == "jaccard_join":
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD if r[0] != 201)
        else:
            seen: dict = {}
            for r in rows:
                assert (r.doc_id, r.text, r.lang, r.source, r.n_chars) in ODD
                seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
            assert not {1, 2} & set(seen) and all(n <= 2 * sum(x[0] == i for x in ODD) for i, n in seen.items())
