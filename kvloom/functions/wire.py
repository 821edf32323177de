"""RESP values and commands as expressions, and an incremental decoder for bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvloom.functions.constants import DECODER_LIMIT, KEY_POSITIONS

CRLF = "\r\n"


def _bulk(x: Column) -> Column:
    return F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit(CRLF), x.cast("string"), F.lit(CRLF))


def encode_command(args: Column) -> Column:
    """A command (array of strings or binaries) as an array of bulk strings."""
    return F.concat(F.lit("*"), F.size(args).cast("string"), F.lit(CRLF), F.array_join(F.transform(args, _bulk), ""))


def encode_value(tag: Column, text: Column) -> Column:
    """One flat value by tag: simple, error, integer, bulk, null."""
    line = lambda mark: F.concat(F.lit(mark), text, F.lit(CRLF))
    return (
        F.when(tag == "simple", line("+")).when(tag == "error", line("-")).when(tag == "integer", line(":"))
        .when(tag == "bulk", _bulk(text)).otherwise(F.lit("$-1\r\n"))
    )


def display_value(tag: Column, text: Column) -> Column:
    """The value as people read it."""
    return (
        F.when(tag == "simple", F.concat(F.lit("+"), text)).when(tag == "error", F.concat(F.lit("-"), text))
        .when(tag == "integer", F.concat(F.lit(":"), text))
        .when((tag == "bulk") & (F.octet_length(text) == 0), F.lit("$0"))
        .when(tag == "bulk", F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit(" ("), text, F.lit(")")))
        .otherwise(F.lit("$-1 (Null)"))
    )


def display_array(items: Column) -> Column:
    """An array of display texts as one."""
    return F.concat(F.lit("*"), F.size(items).cast("string"), F.lit(" ["), F.array_join(items, ", "), F.lit("]"))


def wire_length(args: Column) -> Column:
    """Bytes that encode_command gives, without making them."""
    digits = lambda n: F.length(n.cast("string"))
    each = F.transform(args, lambda x: (F.octet_length(x) + digits(F.octet_length(x)) + 5).cast("long"))
    return F.aggregate(each, (digits(F.size(args)) + 3).cast("long"), lambda a, x: a + x)


def kind_of(raw: Column) -> Column:
    """Tag of an encoded value, by its first byte."""
    mark = F.substring(raw, 1, 1)
    return (
        F.when(mark == "+", "simple").when(mark == "-", "error").when(mark == ":", "integer")
        .when((mark == "$") & (F.substring(raw, 2, 2) == "-1"), "null").when(mark == "$", "bulk").when(mark == "*", "array")
    )


def as_command(elements: Column) -> tuple[Column, Column]:
    """(name, args) of an array of struct<tag, text>: the first element must be bulk; other elements that are not are left out."""
    first = F.get(elements, F.lit(0))
    rest = F.filter(F.slice(elements, 2, F.greatest(F.size(elements), F.lit(1))), lambda x: x["tag"] == "bulk")
    ok = first["tag"] == "bulk"
    return F.when(ok, first["text"]), F.when(ok, F.transform(rest, lambda x: x["text"]))


def key_positions(cmd: Column) -> Column:
    """array<int>: argument places of a command's keys, [0] for none, null for unknown commands. Names are case-sensitive."""
    pairs = [x for name, at in KEY_POSITIONS.items() for x in (F.lit(name), F.array(*[F.lit(i) for i in at]))]
    return F.try_element_at(F.create_map(*pairs), cmd)


def command_keys(cmd: Column, args: Column) -> Column:
    """Keys of a command; empty for commands without keys, null for unknown ones."""
    keys = F.transform(key_positions(cmd), lambda i: F.when(i > 0, F.get(args, i - 1)))
    return F.filter(keys, lambda k: k.isNotNull())


# Decoder ---------------------------------------------------------------


class WireError(ValueError):
    """Malformed bytes."""


class InvalidType(WireError):
    pass


class InvalidInteger(WireError):
    pass


class InvalidLength(WireError):
    pass


class BufferOverflow(WireError):
    pass


@dataclass(frozen=True)
class Value:
    tag: str  # simple, error, integer, bulk, array, null
    data: Any = None

    def is_ok(self) -> bool:
        return self.tag == "simple" and self.data == b"OK"

    def command(self) -> tuple[bytes, list[bytes]] | None:
        if self.tag != "array" or not self.data or self.data[0].tag != "bulk":
            return None
        return self.data[0].data, [x.data for x in self.data[1:] if x.tag == "bulk"]

    def encode(self) -> bytes:
        if self.tag in ("simple", "error"):
            return (b"+" if self.tag == "simple" else b"-") + self.data + b"\r\n"
        if self.tag == "integer":
            return b":%d\r\n" % self.data
        if self.tag == "bulk":
            return b"$%d\r\n%s\r\n" % (len(self.data), self.data)
        if self.tag == "array":
            return b"*%d\r\n" % len(self.data) + b"".join(x.encode() for x in self.data)
        return b"$-1\r\n"

    def __str__(self) -> str:
        text = lambda: self.data.decode("utf-8", "replace")
        if self.tag in ("simple", "error"):
            return ("+" if self.tag == "simple" else "-") + text()
        if self.tag == "integer":
            return f":{self.data}"
        if self.tag == "bulk":
            return f"${len(self.data)} ({text()})" if self.data else "$0"
        if self.tag == "array":
            return f"*{len(self.data)} [" + ", ".join(map(str, self.data)) + "]"
        return "$-1 (Null)"


class _More(Exception):
    """The value isn't complete yet."""


class Decoder:
    """feed() bytes, decode() values; nothing is lost while a value is incomplete, and offset counts exactly the bytes of whole values."""

    def __init__(self, limit: int = DECODER_LIMIT):
        self.buffer, self.at, self.offset, self.limit = bytearray(), 0, 0, limit

    def feed(self, data: bytes) -> None:
        if len(self) + len(data) > self.limit:
            raise BufferOverflow(f"{len(self) + len(data)} bytes, the limit is {self.limit}")
        if self.at > 1 << 16 and self.at * 2 > len(self.buffer):
            del self.buffer[: self.at]
            self.at = 0
        self.buffer += data

    def __len__(self) -> int:
        return len(self.buffer) - self.at

    def reset(self) -> None:
        self.buffer, self.at, self.offset = bytearray(), 0, 0

    def decode(self) -> Value | None:
        try:
            value, end = self._value(self.at)
        except _More:
            return None
        self.offset += end - self.at
        self.at = end
        return value

    def __iter__(self) -> Iterator[tuple[int, Value]]:
        """(end offset, value) of all whole values."""
        while (v := self.decode()) is not None:
            yield self.offset, v

    def _line(self, at: int) -> tuple[bytes, int]:
        end = self.buffer.find(b"\r\n", at)
        if end < 0:
            raise _More
        return bytes(self.buffer[at:end]), end + 2

    def _number(self, at: int) -> tuple[int, int]:
        line, end = self._line(at)
        try:
            return int(line), end
        except ValueError:
            raise InvalidInteger(repr(line)) from None

    def _value(self, at: int) -> tuple[Value, int]:
        if at >= len(self.buffer):
            raise _More
        mark = self.buffer[at : at + 1]
        if mark in (b"+", b"-"):
            line, end = self._line(at + 1)
            return Value("simple" if mark == b"+" else "error", line), end
        if mark == b":":
            n, end = self._number(at + 1)
            return Value("integer", n), end
        if mark == b"$":
            n, end = self._number(at + 1)
            if n < -1:
                raise InvalidLength(n)
            if n == -1:
                return Value("null"), end
            if len(self.buffer) < end + n + 2:
                raise _More
            return Value("bulk", bytes(self.buffer[end : end + n])), end + n + 2
        if mark == b"*":
            n, end = self._number(at + 1)
            if n < -1:
                raise InvalidLength(n)
            if n == -1:
                return Value("null"), end
            items = []
            for _ in range(n):
                item, end = self._value(end)
                items.append(item)
            return Value("array", items), end
        raise InvalidType(repr(bytes(mark)))
