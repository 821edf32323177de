from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvloom.functions.wire import BufferOverflow, Decoder, InvalidInteger, InvalidLength, InvalidType, Value


def decode(data: bytes) -> Value | None:
    d = Decoder()
    d.feed(data)
    return d.decode()


@pytest.mark.parametrize(("raw", "tag", "data"), [
    (b"+OK\r\n", "simple", b"OK"), (b"-ERR unknown\r\n", "error", b"ERR unknown"), (b":100\r\n", "integer", 100), (b":0\r\n", "integer", 0),
    (b":-1\r\n", "integer", -1), (b"$5\r\nhello\r\n", "bulk", b"hello"), (b"$0\r\n\r\n", "bulk", b""), (b"$-1\r\n", "null", None), (b"*-1\r\n", "null", None),
])
def test_flat_values(raw, tag, data):
    assert decode(raw) == Value(tag, data)


def test_arrays():
    assert decode(b"*2\r\n$-1\r\n:1\r\n") == Value("array", [Value("null"), Value("integer", 1)])
    v = decode(b"*3\r\n+OK\r\n:100\r\n$4\r\ndata\r\n")
    assert [x.tag for x in v.data] == ["simple", "integer", "bulk"]
    assert str(v) == "*3 [+OK, :100, $4 (data)]"


@pytest.mark.parametrize(("raw", "error"), [(b"?unknown\r\n", InvalidType), (b":abc\r\n", InvalidInteger), (b"$-2\r\n", InvalidLength), (b"*-2\r\n", InvalidLength)])
def test_malformed(raw, error):
    with pytest.raises(error):
        decode(raw)


def test_limit():
    with pytest.raises(BufferOverflow):
        Decoder(1000).feed(b"x" * 1001)


def test_split_input_keeps_all():
    d = Decoder()
    for part, n in ((b"*2\r\n$5\r\n", 0), (b"hel", 0), (b"lo\r\n:4", 0), (b"2\r\n+O", 1), (b"K\r\n", 1)):
        d.feed(part)
        assert len(list(d)) == n
    assert d.offset == len(b"*2\r\n$5\r\nhello\r\n:42\r\n+OK\r\n") and len(d) == 0


def test_commands():
    v = decode(b"*3\r\n$3\r\nset\r\n:1\r\n$1\r\nv\r\n")
    assert v.command() == (b"set", [b"v"])
    assert decode(b"*1\r\n:1\r\n").command() is None and decode(b"+OK\r\n").is_ok()


flat = st.one_of(
    st.binary(max_size=20).map(lambda b: Value("bulk", b)), st.integers(-(2**63), 2**63 - 1).map(lambda n: Value("integer", n)), st.just(Value("null")),
    st.text("abc é", max_size=8).map(lambda s: Value("simple", s.encode())),
)
values = st.recursive(flat, lambda x: st.lists(x, max_size=4).map(lambda v: Value("array", v)), max_leaves=12)


@settings(max_examples=100, deadline=None)
@given(st.lists(values, max_size=4), st.integers(1, 7))
def test_round_trip(vs, step):
    raw, d, got = b"".join(v.encode() for v in vs), Decoder(), []
    for i in range(0, len(raw), step):
        d.feed(raw[i : i + step])
        got += [v for _, v in d]
    assert got == vs and d.offset == len(raw)
