"""Web archives, filter audit, fill-in-middle."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import same
from kvloom.llm import filter_audit, fim, warc
from kvloom.llm.entries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_warc", "op12_filter_audit", "op13_fill_in_middle"])
def test_query_equals_sql(name, spark, small):
    same(QUERIES[name], SQL[name], spark, small)


# Archives --------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def brute_pages(rows, least=100):
    """(page_id, size, digest, kind, refers_to) by the contract, row by row."""
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        first = min(ids, default=None)
        again = len(raw) >= least and first is not None and (i is None or i > first)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def odd_pages():
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(i, f"http://www.Example.com/{i % 7}?q={i}", long if i % 3 else f"{i}" * 40) for i in range(5, 60)]
    rows += [(1, None, None), (2, "", ""), (3, "no host", "x" * 99), (4, "no host", "x" * 99), (60, "http://a b\r\nX-Evil: 1/\x7f", long), (61, "//h.org/\t", "\r\n\r\n" * 50), (62, "http://ü.de/é", "y" * 300000)]
    rows += [(None, "http://n.org/", long), (None, "http://n.org/", "z" * 200), (5, "http://again.org/", "z" * 200), (5, "http://again.org/", "z" * 200), (-3, "https://h.org:80/#f", "z" * 200)]
    rows += [(200 + i, "http://hot.org/", long) for i in range(300)]
    return rows


def read_back(spark, tmp_path, rows, schema=PAGES, **kw):
    pages = spark.createDataFrame(rows, schema)
    warc.write_archives(pages, f"{tmp_path}/warc", **kw)
    warc.build_index(spark, f"{tmp_path}/warc", f"{tmp_path}/cdx")
    return pages


def test_archives_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    rows = odd_pages()
    pages = read_back(spark, tmp_path, rows)
    got = [tuple(r) for r in warc.lookup(spark, f"{tmp_path}/cdx", pages, id_col="page_id").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == brute_pages(rows)
    payloads = {r[0]: bytes(r[1]).decode() for r in warc.lookup(spark, f"{tmp_path}/cdx", pages, id_col="page_id").filter("payload IS NOT NULL").select("page_id", "payload").collect()}
    assert payloads[61] == "\r\n\r\n" * 50 and payloads[62] == "y" * 300000 and payloads[1] == ""


def test_lookup_reads_little_and_finds_all_captures_of_a_url(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, f"http://h{i % 50}.org/p{i}", rnd.randbytes(3000).hex()) for i in range(3000)] + [(9000 + i, "https://h7.org/same", f"{i}" * 60) for i in range(5)]
    read_back(spark, tmp_path, rows)
    wanted = spark.createDataFrame([("https://h7.org/same",), ("http://h3.org/p3",), ("http://none.org/",), ("http://h3.org/p3",)], "u string")
    found = warc.lookup(spark, f"{tmp_path}/cdx", wanted, url_col="u").collect()
    assert sorted(r["page_id"] for r in found) == [3, *range(9000, 9005)]
    files = warc.index_files(spark, f"{tmp_path}/cdx")
    searcher = warc.Searcher(files)
    key = spark.range(1).select(warc.key_of(F.lit("http://h3.org/p3"))).first()[0]
    hits = list(searcher.find(warc.place(key, 3), warc.place(key, 3)))
    assert len(hits) == 1
    [(_, raw)] = searcher.records(hits)
    assert warc.parse_record(raw)[1].decode() == rows[3][2]
    whole = sum(os.path.getsize(f"{tmp_path}/warc/{n}") for n in os.listdir(f"{tmp_path}/warc") if n.endswith("txt"))
    assert searcher.archive.n_read < whole / 1000


def test_archives_can_be_read_by_any_decompressor(spark, tmp_path):
    read_back(spark, tmp_path, odd_pages()[:30])
    names = [n for n in os.listdir(f"{tmp_path}/warc") if n.endswith("txt")]
    text = b""
    for n in names:
        with open(f"{tmp_path}/warc/{n}", "rb") as f:
            text += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert text.count(b"WARC-Type: warcinfo") == len(names)
    assert len(re.findall(rb"(?m)^WARC-Type: (?:response|revisit)\r$", text)) == 30


@pytest.mark.parametrize("size", [0, 1, 255, 256, 70000, 400000])
@pytest.mark.parametrize("kind", ["zeros", "random"])
def test_frames_end_where_their_headers_say(size, kind):
    data = bytes(size) if kind == "zeros" else random.Random(size).randbytes(size)
    for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
        frame = zstandard.ZstdCompressor(level=3, **options).compress(data)
        assert warc.frame_end(b"ab" + frame + b"rest", 2) == 2 + len(frame)


def test_keys_and_damage(spark):
    urls = ["http://www.Example.com:80/A?b#c", "https://u@x.org", "//h/", "a/b", "", None, "HTTP://X.Y.Z?q"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.key_of(warc.uri_of(F.col("u")))).collect()]
    assert got == ["com:80,example,www)/A?b#c", "org,u@x)", "h)/", ")a/b", ")", ")", "z,y,x)?q"]
    raw = warc.record("response", "http://a/", 1, hashlib.sha256(b"payload").hexdigest(), 7, b"payload", None, warc.DATE)
    assert warc.parse_record(raw)[1] == b"payload"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload\r", b"pAyload\r"))
    with pytest.raises(ValueError, match="cut"):
        warc.parse_record(raw[:-8])


def test_archives_of_nothing_and_odd_columns(spark, tmp_path):
    pages = read_back(spark, tmp_path, [])
    assert warc.lookup(spark, f"{tmp_path}/cdx", pages, id_col="page_id").count() == 0
    rows = [(1, "http://a/", "h" * 200, "k", 1, "p"), (2, "http://b/", "h" * 200, None, None, None)]
    other = spark.createDataFrame(rows, "`a.b` long, key string, html string, digest string, kind int, payload string")
    warc.write_archives(other, f"{tmp_path}/w2", id_col="a.b", url_col="key")
    warc.build_index(spark, f"{tmp_path}/w2", f"{tmp_path}/c2")
    assert sorted(r["record_type"] for r in warc.lookup(spark, f"{tmp_path}/c2", other, url_col="key", id_col="a.b").collect()) == ["response", "revisit"]


# Filter audit ----------------------------------------------------------


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        earlier = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": earlier}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in own if r[1][f] and not any(r[1][x] for x in order[:k])]
                removed_by[f] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(not any(r[1][x] for x in order[: k + 1]) for r in own), len(here), sum(r[1][f] and any(r[1][x] for x in order[:k]) for r in own),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in here), sum(r[3] for r in here), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[6] = removed_by[v[6]]
    return out


def test_audit_against_brute_force(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a " * 300, "A b C " * 20, " ".join(f"w{i}" for i in range(250)), "x\x0by\x1cz\xa0w " * 90, "$5 " + " ".join(f"é{i}" for i in range(200)), "ABC\x00", "word " * 199 + "word"]
    docs = [(rnd.choice([*range(40), None]), rnd.choice(texts), rnd.choice(["en", "de", None, "", "en"])) for _ in range(120)]
    labels = [(rnd.choice([*range(50), None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*d, 1, 2, "w") for d in docs], "doc_id long, text string, lang string, row int, n int, word string")
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == brute_audit(docs, labels)
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# Fill in middle --------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=1500), st.integers(0, 1500))
def test_rank_and_select(bits, i):
    b = fim.Bits(np.array(bits, bool))
    ones = [k for k, x in enumerate(bits) if x]
    assert b.total == len(ones)
    i = min(i, len(bits))
    assert b.rank(i) == sum(bits[:i])
    assert b.select(i) == (ones[i] if i < len(ones) else len(bits))


def brute_fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, plain, first = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or plain % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if first % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ALPHABET = st.lists(st.sampled_from(["a", "Zz", " ", "\n", "é", "中", "😀", "<", "<P", "S>", "M>", "<S>", "1", "\x00", "word "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)), ALPHABET)
def test_rearrangement_against_brute_force(doc_id, text):
    *got, output = fim.rearranged(doc_id, text.encode())
    assert (*got, output.decode()) == brute_fim(doc_id, text)


def test_fill_in_middle_restores_odd_texts(spark):
    texts = [None, "", "a", "<", "<P", "<S<S", "M>x<M", "é" * 3000, "word " * 40000, "x<P>y", "\x00\x01", "<S" * 50, "ab<" * 99]
    rows = [(i if i % 9 else None, texts[i % len(texts)], i, "o") for i in range(300)]
    d = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, n int, output string").repartition(3))
    got = d.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((repr(r["doc_id"]), r["back"]) for r in got) == sorted((repr(i), t or "") for i, t, *_ in rows)
    assert sorted(repr(tuple(r)[1:6]) for r in got) == sorted(repr(brute_fim(i, t or "")) for i, t, *_ in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
