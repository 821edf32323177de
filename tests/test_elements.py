"""Collection encodings: known bytes, round trips, damage."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvloom.functions import elements as E
from kvloom.sources.rdb import CorruptSnapshot, encode_length, encode_string


def test_known_bytes():
    # Public examples of the formats: a listpack of 1, "a", 1000; a ziplist of "2" and "5"; a zipmap foo => bar, hello => world; an intset.
    assert list(E.listpack(bytes.fromhex("0f00000003000101816102c3e802ff"))) == [b"1", b"a", b"1000"]
    assert list(E.ziplist(bytes.fromhex("0f0000000c000000020000f302f6ff"))) == [b"2", b"5"]
    assert list(E.zipmap(b"\x02\x03foo\x03\x00bar\x05hello\x05\x00world\xff")) == [b"foo", b"bar", b"hello", b"world"]
    assert list(E.zipmap(b"\x01\x01a\x02\x03xy???\xff")) == [b"a", b"xy"]
    assert list(E.intset(bytes.fromhex("0200000002000000ffff0500"))) == [b"-1", b"5"]
    assert E.encode_ziplist([b"2", b"5"]).hex() == "0f0000000c000000020000f302f6ff"


values = st.one_of(
    st.binary(max_size=80), st.integers(-(1 << 63), (1 << 63) - 1).map(lambda n: b"%d" % n), st.integers(-9000, 9000).map(lambda n: b"%d" % n),
    st.sampled_from([b"", b"0", b"-0", b"007", b"+1", b"x" * 63, b"x" * 64, b"y" * 4095, b"y" * 4096, b"z" * 16383, b"z" * 20000, b"9" * 21]),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(values, max_size=20))
def test_compact_lists_round_trip(items):
    assert list(E.listpack(E.encode_listpack(items))) == items
    assert list(E.ziplist(E.encode_ziplist(items))) == items
    pairs = items[: len(items) // 2 * 2]
    assert list(E.zipmap(E.encode_zipmap(pairs))) == pairs


@settings(max_examples=100, deadline=None)
@given(st.lists(values, max_size=12), st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=12), st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=12))
def test_values_round_trip(items, scores, numbers):
    for kind in (1, 10, 14, 18):
        rows = [(i, None, v, None) for i, v in enumerate(items)]
        assert list(E.elements(kind, E.raw_value(kind, rows))) == rows
    for kind in (2, 20):
        rows = [(None, None, v, None) for v in items]
        assert list(E.elements(kind, E.raw_value(kind, rows))) == rows
    for kind in (4, 9, 13, 16):
        rows = [(None, f, v, None) for f, v in zip(items, items[1:], strict=False)]
        assert list(E.elements(kind, E.raw_value(kind, rows))) == rows
    for kind in (3, 5, 12, 17):
        rows = [(None, None, v, s) for v, s in zip(items, scores, strict=False)]
        assert list(E.elements(kind, E.raw_value(kind, rows))) == rows
    rows = [(None, None, b"%d" % n, None) for n in sorted(numbers)]
    assert list(E.elements(11, E.raw_value(11, rows))) == rows
    assert list(E.elements(15, b"any")) == []


def test_lists_of_many_nodes_and_long_entries():
    rows = [(i, None, b"%d" % i + b"x" * (i * 37 % 3000), None) for i in range(300)]
    for kind in (14, 18):
        raw = E.raw_value(kind, rows)
        assert raw[0] & 0x40 or 2 < raw[0] < 64
        assert list(E.elements(kind, raw)) == rows


def test_damage_is_an_error():
    good = E.encode_listpack([b"a", b"b"])
    for bad in (good[:-1], good[:4] + b"\x00", good[:-1] + b"\x01", b""):
        with pytest.raises((CorruptSnapshot, IndexError)):
            list(E.listpack(bad))
    with pytest.raises(CorruptSnapshot):
        list(E.elements(4, encode_length(2) + encode_string(b"f")))
    with pytest.raises(CorruptSnapshot):
        list(E.elements(16, encode_string(E.encode_listpack([b"f"]))))
    with pytest.raises(CorruptSnapshot):
        list(E.intset(b"\x03\x00\x00\x00\x00\x00\x00\x00"))
