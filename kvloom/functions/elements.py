"""Elements of snapshot values: decoders of every collection encoding, and the way back to raw bytes.

An element is (place, field, value, score): lists have places and values, sets
values, hashes fields and values, sorted sets values and scores; strings are one
value. Integers in compact encodings are their decimal text.

Encodings: plain counts and strings (1, 2, 4), strings with 8-byte scores (3, 5),
zipmap (9), ziplist (10, 12, 13), intset (11), listpack (16, 17, 20), and lists of
nodes, each a ziplist (14) or a listpack (18).
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvloom.functions.constants import VALUE_CLASSES
from kvloom.sources.rdb import CorruptSnapshot, SnapshotReader, encode_length, encode_string
from kvloom.sources.shared import written

Element = tuple[int | None, bytes | None, bytes | None, float | None]
CLASS_OF = {t: name for name, types in VALUE_CLASSES.items() for t in types}
ZIPLISTS, LISTPACKS, SCORES = (10, 12, 13, 14), (16, 17, 18, 20), (3, 5)
#: Bytes of a node that the writer of lists of nodes fills at most.
NODE = 8192


# Compact encodings -----------------------------------------------------


def listpack(data: bytes) -> Iterator[bytes]:
    """Entries of a listpack."""
    if len(data) < 7 or int.from_bytes(data[:4], "little") != len(data):
        raise CorruptSnapshot("listpack of another size than stated")
    at = 6
    while (b := data[at]) != 0xFF:
        begin = at
        if b < 0x80:
            value, at = b"%d" % b, at + 1
        elif b < 0xC0:
            value, at = data[at + 1 : at + 1 + (b & 63)], at + 1 + (b & 63)
        elif b < 0xE0:
            n = (b & 31) << 8 | data[at + 1]
            value, at = b"%d" % (n - 8192 if n >= 4096 else n), at + 2
        elif b < 0xF0:
            n = (b & 15) << 8 | data[at + 1]
            value, at = data[at + 2 : at + 2 + n], at + 2 + n
        elif b == 0xF0:
            n = int.from_bytes(data[at + 1 : at + 5], "little")
            value, at = data[at + 5 : at + 5 + n], at + 5 + n
        elif b <= 0xF4:
            n = (2, 3, 4, 8)[b - 0xF1]
            value, at = b"%d" % int.from_bytes(data[at + 1 : at + 1 + n], "little", signed=True), at + 1 + n
        else:
            raise CorruptSnapshot(f"listpack entry {b:#x}")
        yield value
        at += len(_back_length(at - begin))
        if at >= len(data):
            raise CorruptSnapshot("listpack without an end")


def _back_length(n: int) -> bytes:
    """The entry's length behind it, to be read from the right: seven bits a byte."""
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127)
    return bytes([out[-1]]) + bytes(x | 128 for x in out[-2::-1]) if len(out) > 1 else bytes(out)


def as_integer(data: bytes, bits: int = 64) -> int | None:
    """The number whose decimal text data is; None for other bytes."""
    if 0 < len(data) <= 20 and (data.isdigit() or (data[:1] == b"-" and data[1:].isdigit())):
        n = int(data)
        if b"%d" % n == data and -(1 << (bits - 1)) <= n < 1 << (bits - 1):
            return n
    return None


def encode_listpack(values: Iterable[bytes]) -> bytes:
    out, n = bytearray(), 0
    for v in values:
        i = as_integer(v)
        if i is not None and 0 <= i < 128:
            entry = bytes([i])
        elif i is not None and -4096 <= i < 4096:
            entry = (0xC000 | i & 0x1FFF).to_bytes(2, "big")
        elif i is not None:
            code, size = next((c, s) for c, s in ((0xF1, 2), (0xF2, 3), (0xF3, 4), (0xF4, 8)) if -(1 << 8 * s - 1) <= i < 1 << 8 * s - 1)
            entry = bytes([code]) + i.to_bytes(size, "little", signed=True)
        elif len(v) < 64:
            entry = bytes([0x80 | len(v)]) + v
        elif len(v) < 4096:
            entry = (0xE000 | len(v)).to_bytes(2, "big") + v
        else:
            entry = b"\xf0" + len(v).to_bytes(4, "little") + v
        out += entry + _back_length(len(entry))
        n += 1
    return struct.pack("<IH", len(out) + 7, min(n, 0xFFFF)) + bytes(out) + b"\xff"


def ziplist(data: bytes) -> Iterator[bytes]:
    """Entries of a ziplist."""
    if len(data) < 11 or int.from_bytes(data[:4], "little") != len(data):
        raise CorruptSnapshot("ziplist of another size than stated")
    at = 10
    while data[at] != 0xFF:
        at += 5 if data[at] == 0xFE else 1
        b = data[at]
        if b >> 6 == 3:
            if 0xF1 <= b <= 0xFD:
                value, at = b"%d" % (b - 0xF1), at + 1
            else:
                size = {0xC0: 2, 0xD0: 4, 0xE0: 8, 0xF0: 3, 0xFE: 1}.get(b)
                if size is None:
                    raise CorruptSnapshot(f"ziplist entry {b:#x}")
                value, at = b"%d" % int.from_bytes(data[at + 1 : at + 1 + size], "little", signed=True), at + 1 + size
        else:
            n, at = (b & 63, at + 1) if b >> 6 == 0 else ((b & 63) << 8 | data[at + 1], at + 2) if b >> 6 == 1 else (int.from_bytes(data[at + 1 : at + 5], "big"), at + 5)
            value, at = data[at : at + n], at + n
        yield value
        if at >= len(data):
            raise CorruptSnapshot("ziplist without an end")


def encode_ziplist(values: Iterable[bytes]) -> bytes:
    out, n, before = bytearray(), 0, 0
    last = 10
    for v in values:
        i = as_integer(v)
        if i is not None and 0 <= i <= 12:
            entry = bytes([0xF1 + i])
        elif i is not None:
            code, size = next((c, s) for c, s in ((0xFE, 1), (0xC0, 2), (0xF0, 3), (0xD0, 4), (0xE0, 8)) if -(1 << 8 * s - 1) <= i < 1 << 8 * s - 1)
            entry = bytes([code]) + i.to_bytes(size, "little", signed=True)
        elif len(v) < 64:
            entry = bytes([len(v)]) + v
        elif len(v) < 16384:
            entry = (0x4000 | len(v)).to_bytes(2, "big") + v
        else:
            entry = b"\x80" + len(v).to_bytes(4, "big") + v
        entry = (bytes([before]) if before < 254 else b"\xfe" + before.to_bytes(4, "little")) + entry
        last = 10 + len(out)
        out += entry
        before, n = len(entry), n + 1
    return struct.pack("<IIH", len(out) + 11, last, min(n, 0xFFFF)) + bytes(out) + b"\xff"


def zipmap(data: bytes) -> Iterator[bytes]:
    """Fields and values of a zipmap, in turn."""
    at, value = 1, False
    while data[at] != 0xFF:
        n, at = (data[at], at + 1) if data[at] < 254 else (int.from_bytes(data[at + 1 : at + 5], "little"), at + 5)
        free = data[at] if value else 0
        at += value
        if at + n + free >= len(data):
            raise CorruptSnapshot("zipmap without an end")
        yield data[at : at + n]
        at, value = at + n + free, not value


def encode_zipmap(values: Iterable[bytes]) -> bytes:
    out, n = bytearray(), 0
    for v in values:
        out += (bytes([len(v)]) if len(v) < 254 else b"\xfe" + len(v).to_bytes(4, "little")) + (b"\x00" if n % 2 else b"") + v
        n += 1
    return bytes([min(n // 2, 254)]) + bytes(out) + b"\xff"


def intset(data: bytes) -> Iterator[bytes]:
    size, n = struct.unpack_from("<II", data)
    if size not in (2, 4, 8) or len(data) != 8 + size * n:
        raise CorruptSnapshot("intset of another size than stated")
    for i in range(n):
        yield b"%d" % int.from_bytes(data[8 + i * size : 8 + (i + 1) * size], "little", signed=True)


def encode_intset(values: Iterable[bytes]) -> bytes:
    numbers = sorted({int(v) for v in values})
    size = next(s for s in (2, 4, 8) if not numbers or (-(1 << 8 * s - 1) <= numbers[0] and numbers[-1] < 1 << 8 * s - 1))
    return struct.pack("<II", size, len(numbers)) + b"".join(n.to_bytes(size, "little", signed=True) for n in numbers)


# Values ----------------------------------------------------------------


def _flat(kind: int, raw: bytes) -> Iterator[bytes]:
    """The strings of a value of any encoding without binary scores, in turn."""
    r = SnapshotReader(io.BytesIO(raw))
    if kind in (1, 2, 4):
        for _ in range(r._elements() * (2 if kind == 4 else 1)):
            yield r._string()
    elif kind in (14, 18):
        for _ in range(r._elements()):
            yield from (ziplist if kind == 14 else listpack)(r._string())
    else:
        yield from {9: zipmap, 11: intset}.get(kind, ziplist if kind in ZIPLISTS else listpack)(r._string())


def elements(kind: int, raw: bytes) -> Iterator[Element]:
    """Elements of a raw value; none for types without a class (streams, modules)."""
    name = CLASS_OF.get(kind)
    if name is None:
        return
    if name == "string":
        yield None, None, SnapshotReader(io.BytesIO(raw))._string(), None
    elif kind in SCORES:
        r = SnapshotReader(io.BytesIO(raw))
        for _ in range(r._elements()):
            yield None, None, r._string(), struct.unpack("<d", r._take(8))[0]
    elif name in ("hash", "zset"):
        flat = _flat(kind, raw)
        for one in flat:
            two = next(flat, None)
            if two is None:
                raise CorruptSnapshot("a field without a value")
            yield (None, one, two, None) if name == "hash" else (None, None, one, float(two))
    else:
        for i, v in enumerate(_flat(kind, raw)):
            yield i if name == "list" else None, None, v, None


def _score(x: float) -> bytes:
    return b"%d" % int(x) if x == int(x) and abs(x) < 1 << 53 else repr(x).encode()


def raw_value(kind: int, items: list[Element]) -> bytes:
    """Raw bytes of a value that has these elements, in the encoding of its type."""
    name = CLASS_OF[kind]
    if name == "string":
        return encode_string(items[0][2])
    if kind in SCORES:
        return encode_length(len(items)) + b"".join(encode_string(v) + struct.pack("<d", s) for _, _, v, s in items)
    flat = [x for _, f, v, s in items for x in ((f, v) if name == "hash" else (v, _score(s)) if name == "zset" else (v,))]
    if kind in (1, 2, 4):
        return encode_length(len(items)) + b"".join(map(encode_string, flat))
    if kind in (14, 18):
        nodes, own, size = [], [], 0
        for v in flat:
            if own and size + len(v) > NODE:
                nodes.append(own)
                own, size = [], 0
            own.append(v)
            size += len(v)
        nodes += [own] if own else []
        return encode_length(len(nodes)) + b"".join(encode_string((encode_ziplist if kind == 14 else encode_listpack)(n)) for n in nodes)
    pack = {9: encode_zipmap, 11: encode_intset}.get(kind, encode_ziplist if kind in ZIPLISTS else encode_listpack)
    return encode_string(pack(flat))


# Tables ----------------------------------------------------------------

COLUMNS = "place int, field binary, value binary, score double"
BATCH = 4096


def explode_values(snapshot: DataFrame) -> DataFrame:
    """(run_id, pos, db, key, expire, rdb_type, place, field, value, score): a row for each element of each value of a snapshot.

    Rows without a raw value (streams) have none. An empty collection has none. Damaged values fail the query.
    """
    names = ["run_id", "pos", "db", "key", "expire", "rdb_type"]
    schema = ", ".join(f"{n} {snapshot.schema[n].dataType.simpleString()}" for n in names) + ", " + COLUMNS
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.float64()]

    def run(batches):
        for b in batches:
            rows: list[Element] = []
            of: list[int] = []

            def batch():
                taken = b.select(names).take(pa.array(of, pa.int64()))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                return pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*names, "place", "field", "value", "score"])

            for i, (kind, raw) in enumerate(zip(b.column("rdb_type").to_pylist(), b.column("raw_value"), strict=True)):
                if not raw.is_valid:
                    continue
                for e in elements(kind, raw.as_py()):
                    rows.append(e)
                    of.append(i)
                    if len(rows) == BATCH:
                        yield batch()
                        rows, of = [], []
            if rows:
                yield batch()

    return snapshot.select(*names, "raw_value").mapInArrow(run, schema)


def entries(snapshot: DataFrame) -> DataFrame:
    """(run_id, db, key, kind, field, value, expire_ms, rdb_type) of a snapshot, as log application takes them: strings, elements of hashes, sets
    and sorted sets (a member is the field, its score the value), and other values as they are. kind is null for streams."""
    rows = written(snapshot, "entries")
    kind, expire = F.col("rdb_type"), F.unix_millis("expire").alias("expire_ms")
    named = F.element_at(F.create_map(*[F.lit(x) for t, n in CLASS_OF.items() for x in (t, n)]), kind)
    decoded = kind.isin(*(VALUE_CLASSES["hash"] + VALUE_CLASSES["set"] + VALUE_CLASSES["zset"]))
    whole = rows.filter(~decoded).select("run_id", "db", "key", named.alias("kind"), F.lit(None).cast("binary").alias("field"), F.coalesce("value", "raw_value").alias("value"), expire, kind)
    is_hash, score = kind.isin(*VALUE_CLASSES["hash"]), F.col("score")
    # Whole scores as servers write them.
    shown = F.when((score == F.floor(score)) & (F.abs(score) < 1e15), score.cast("long").cast("string")).otherwise(score.cast("string"))
    each = explode_values(rows.filter(decoded)).select(
        "run_id", "db", "key", named.alias("kind"), F.when(is_hash, F.col("field")).otherwise(F.col("value")).alias("field"),
        F.when(is_hash, F.col("value")).otherwise(shown.cast("binary")).alias("value"), expire, kind,
    )
    return whole.unionByName(each)


def pack_values(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, rdb_type, raw_value) of rows with rdb_type and items, an array of structs (place, field, value, score)."""
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in (*keep, "rdb_type")) + ", raw_value binary"

    def run(batches):
        for b in batches:
            for i, kind in enumerate(b.column("rdb_type").to_pylist()):
                # One value's elements at a time.
                items = b.column("items")[i].values
                raw = raw_value(kind, list(zip(*[c.to_pylist() for c in items.flatten()], strict=True)))
                yield pa.RecordBatch.from_arrays([*[b.column(n).slice(i, 1) for n in (*keep, "rdb_type")], pa.array([raw], pa.binary())], names=[*keep, "rdb_type", "raw_value"])

    # Few rows of any size: spread, so that a task, and a batch that it gets, holds few of them.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep, "rdb_type")
    return rows.select(*keep, "rdb_type", F.col("items").cast("array<struct<place:int,field:binary,value:binary,score:double>>").alias("items")).mapInArrow(run, schema)
