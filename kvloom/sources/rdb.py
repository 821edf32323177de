"""Snapshot files: a streaming reader, a writer, and Spark sources over both.

A snapshot says nowhere where its entries begin: one pass over heads finds
places to cut it, and tasks read the parts by their ranges. Rows stream out of
the reader one by one and values stay encoded ("raw"), only strings are decoded.
"""

from __future__ import annotations

import datetime as dt
import io
import os
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kvloom.functions.constants import MAX_ELEMENTS, MODULE_TYPES, STREAM_TYPES, VALUE_TYPES
from kvloom.functions.hashing import crc64_joined, crc64_of
from kvloom.sources.pushed import Pushed, enable
from kvloom.sources.shared import written
from kvloom.sources.store import Cursor, Ranged, readable, required_local

SCHEMA = "run_id string, pos long, db int, key binary, value binary, raw_value binary, expire timestamp, rdb_type int"
AUX_SCHEMA = "run_id string, key binary, value binary"
MAGIC = b"REDIS"
#: Types whose value is one string; a count and that many strings (times); a count, and strings with 8-byte scores.
ONE_STRING = {0, 9, 10, 11, 12, 13, 16, 17, 20}
STRINGS_EACH = {1: 1, 2: 1, 4: 2, 14: 1, 18: 1}
SCORED = {3, 5}


class CorruptSnapshot(ValueError):
    pass


def lzf_decompress(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        back = (c & 31) << 8 | data[i]
        i += 1
        at = len(out) - back - 1
        if at < 0:
            raise CorruptSnapshot("compressed string points before its start")
        for k in range(n + 2):
            out.append(out[at + k])
    if len(out) != size:
        raise CorruptSnapshot("compressed string has another length than stated")
    return bytes(out)


class SnapshotReader:
    """Iterates over (db, key, value, raw, expire_ms, type); fills aux, version. Modules give no row, streams a row without raw value."""

    def __init__(self, f: BinaryIO, check_crc: bool = False):
        self.f, self.seen, self.check_crc, self.crc = f, 0, check_crc, 0
        self.aux: list[tuple[bytes, bytes]] = []
        self.version = None
        self.tape: bytearray | None = None  # bytes read since _record()
        self.passing = False  # strings are passed over, not read
        self.glides = False  # entries of the buffer are passed over together

    def _take(self, n: int) -> bytes:
        data = self.f.read(n) if n else b""
        if len(data) != n:
            raise CorruptSnapshot(f"ends after {self.seen + len(data)} bytes, inside an entry")
        self.seen += n
        if self.check_crc:
            self.crc = crc64_of(data, self.crc)
        if self.tape is not None:
            self.tape += data
        return data

    def _uint(self, n: int, order: str = "little") -> int:
        return int.from_bytes(self._take(n), order)

    def _length(self) -> tuple[int, bool]:
        """(length, False), or (number of a special coding, True)."""
        b = self._uint(1)
        if b < 0x40:
            return b, False
        if b < 0x80:
            return (b & 63) << 8 | self._uint(1), False
        if b in (0x80, 0x81):
            return self._uint(4 if b == 0x80 else 8, "big"), False
        if b >= 0xC0:
            return b & 63, True
        raise CorruptSnapshot(f"length byte {b:#x}")

    def _count(self) -> int:
        n, special = self._length()
        if special:
            raise CorruptSnapshot("a special coding where a length belongs")
        return n

    def _pass_string(self) -> bytes:
        """Short strings are read all the same: streams look at their ids."""
        n, special = self._length()
        if special and n < 3:
            n = 1 << n
        elif special and n == 3:
            n, _ = self._count(), self._count()
        elif special:
            raise CorruptSnapshot(f"string coding {n}")
        if n <= 64:
            return self._take(n)
        if not self.f.skip(n):
            raise CorruptSnapshot(f"ends after {self.f.f.size} bytes, inside an entry")
        self.seen += n
        return b""

    def _string(self) -> bytes:
        if self.passing:
            return self._pass_string()
        n, special = self._length()
        if not special:
            return self._take(n)
        if n < 3:
            return str(int.from_bytes(self._take(1 << n), "little", signed=True)).encode()
        if n == 3:
            packed, size = self._count(), self._count()
            return lzf_decompress(self._take(packed), size)
        raise CorruptSnapshot(f"string coding {n}")

    def _elements(self) -> int:
        n = self._count()
        if n > MAX_ELEMENTS:
            raise CorruptSnapshot(f"{n} elements")
        return n

    def _value(self, kind: int) -> tuple[bytes | None, bytes | None]:
        if kind in MODULE_TYPES:
            self._module()
            return None, None
        if kind in STREAM_TYPES:
            self._stream(kind != STREAM_TYPES[0])
            return None, None
        self.tape, value = bytearray(), None
        if kind in ONE_STRING:
            value = self._string()
        elif kind in SCORED:
            for _ in range(self._elements()):
                self._string()
                self._take(8)
        else:
            for _ in range(self._elements() * STRINGS_EACH[kind]):
                self._string()
        raw, self.tape = bytes(self.tape), None
        return value, raw

    def _module(self) -> None:
        self._count()
        while (code := self._count()) != 0:
            if code in (1, 2):
                self._count()
            elif code in (3, 4):
                self._take(4 if code == 3 else 8)
            elif code == 5:
                self._string()
            else:
                raise CorruptSnapshot(f"module code {code}")

    def _stream(self, newer: bool) -> None:
        numbers = lambda n: [self._count() for _ in range(n)]
        for _ in range(self._count()):
            if len(self._string()) != 16:
                raise CorruptSnapshot("stream id of other than 16 bytes")
            self._string()
        numbers(7 if newer else 2)  # last id; also first id, last deleted id, entries added
        for _ in range(self._count()):
            self._string()
            numbers(3 if newer else 2)
            for _ in range(self._count()):
                self._take(24)
                self._count()
            for _ in range(self._count()):
                self._string()
                self._take(16 if newer else 8)
                self._take(16 * self._count())

    def header(self) -> None:
        if self._take(5) != MAGIC:
            raise CorruptSnapshot("not a snapshot")
        digits = self._take(4)
        if not digits.isdigit():
            raise CorruptSnapshot(f"version {digits!r}")
        self.version = int(digits)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes | None, bytes | None, int | None, int]]:
        self.header()
        return self.entries()

    def _glide(self, db: int, expire: int | None, marks: Marks | None) -> tuple[int, int | None]:
        """(database, pending expiry) behind the entries of common types and short strings that lie whole in the buffer; others are left to entries()."""
        self.f.peek(256)
        buf, i, base = self.f.buffer, self.f.at - self.f.begin, self.f.begin
        begin = here = i
        size = len(buf)
        due = 0 if marks is None or not marks.found else marks.found[-1][0] + marks.every - base
        try:
            while True:
                here = i
                if marks is not None and i >= due:
                    marks.note(base + i, db, expire)
                    due = i + marks.every
                op = buf[i]
                i += 1
                if op in ONE_STRING:
                    strings, gap = 2, 0
                elif op in STRINGS_EACH or op in SCORED:
                    b = buf[i]
                    if b >= 128:
                        break
                    i += 1 + b if b < 64 else 2 + ((b & 63) << 8 | buf[i + 1])
                    strings, gap = buf[i], 8 if op in SCORED else 0
                    if strings >= 64:
                        break
                    i, strings = i + 1, strings * STRINGS_EACH.get(op, 1)
                elif op == 0xFE and buf[i] < 64:
                    db, expire, i = buf[i], None, i + 1
                    continue
                elif op in (0xFC, 0xFD) and i + 8 <= size:
                    n = 8 if op == 0xFC else 4
                    expire = int.from_bytes(buf[i : i + n], "little") * (1 if n == 8 else 1000)
                    i += n
                    continue
                elif op == 0xF9 and i < size:
                    i += 1
                    continue
                elif op == 0xF8 and buf[i] < 128 and i + 1 < size:
                    i += 1 if buf[i] < 64 else 2
                    continue
                else:
                    break
                while strings:
                    b = buf[i]
                    if b < 64:
                        i += 1 + b + gap
                    elif b < 128:
                        i += 2 + ((b & 63) << 8 | buf[i + 1]) + gap
                    elif 0xC0 <= b <= 0xC2:
                        i += 1 + (1 << b - 0xC0) + gap
                    else:
                        break
                    strings -= 1
                if strings or i > size:
                    break
                expire = None
                if marks is not None:
                    marks.rows += 1
        except IndexError:
            pass
        self.f.at = base + here
        self.seen += here - begin
        return db, expire

    def entries(self, db: int = 0, expire: int | None = None, stop: int | None = None, marks: Marks | None = None, wanted=None) -> Iterator[tuple[int, bytes, bytes | None, bytes | None, int | None, int] | None]:
        """Entries from here on, in database db and with a pending expiry, up to the place stop or the end of the file. wanted(db, type): other
        entries are passed over, and come as None."""
        while stop is None or self.seen < stop:
            if self.glides:
                db, expire = self._glide(db, expire, marks)
                yield 0
            if marks:
                marks.note(self.seen, db, expire)
            op = self._uint(1)
            if op == 0xFF:
                crc = self.crc
                tail = self.f.read(8)
                if self.check_crc and len(tail) == 8 and any(tail) and int.from_bytes(tail, "little") != crc:
                    raise CorruptSnapshot("checksum differs")
                return
            if op == 0xFE:
                db, expire = self._count(), None
            elif op == 0xFD:
                expire = self._uint(4) * 1000
            elif op == 0xFC:
                expire = self._uint(8)
            elif op == 0xFB:
                self._count(), self._count()
            elif op == 0xFA:
                was, self.passing = self.passing, False
                self.aux.append((self._string(), self._string()))
                self.passing = was
            elif op == 0xF9:
                self._take(1)
            elif op == 0xF8:
                self._count()
            elif op == 0xF7:
                self._module()
            elif op in VALUE_TYPES:
                here = wanted is None or wanted(db, op)
                was, self.passing = self.passing, self.passing or not here
                key = self._string()
                value, raw = self._value(op)
                self.passing = was
                if op not in MODULE_TYPES:
                    yield (db, key, value, raw, expire, op) if here else None
                expire = None
            else:
                raise CorruptSnapshot(f"opcode {op:#x}")


class Marks:
    """Places between entries: the first, and one after each so many bytes."""

    def __init__(self, every: int):
        self.every, self.rows, self.found = every, 0, []

    def note(self, at: int, db: int, expire: int | None) -> None:
        if not self.found or at - self.found[-1][0] >= self.every:
            self.found.append((at, db, expire, self.rows))


class Skimmer(SnapshotReader):
    """Passes over the strings of a snapshot without reading them, to find places where it can be cut."""

    def __init__(self, f: Cursor):
        super().__init__(f)
        self.passing = self.glides = True

    def marks(self, every: int) -> list[tuple[int, int, int | None, int]]:
        """(place, database, pending expiry, rows before) of places between entries, about every so many bytes, and behind the last."""
        return [m for some in self.stretches(every) for m in some[:-1]] + [(self.seen, 0, None, self.rows)]

    def stretches(self, every: int) -> Iterator[list[tuple[int, int, int | None, int]]]:
        """marks, some at a time; the last of some is the first of the next."""
        self.header()
        marks = Marks(every)
        for passed in self.entries(marks=marks):
            marks.rows += passed != 0
            if len(marks.found) > 4096:
                yield marks.found
                marks.found = marks.found[-1:]
        self.rows = marks.rows
        yield [*marks.found, (self.seen, 0, None, marks.rows)]


def encode_length(n: int) -> bytes:
    if n < 64:
        return bytes([n])
    if n < 16384:
        return (n | 0x4000).to_bytes(2, "big")
    return b"\x80" + n.to_bytes(4, "big")


def encode_string(data: bytes) -> bytes:
    return encode_length(len(data)) + data


def select_database(db: int) -> bytes:
    return b"\xfe" + encode_length(db)


def snapshot_head(aux=(), version: int = 9) -> bytes:
    return MAGIC + b"%04d" % version + b"".join(b"\xfa" + encode_string(k) + encode_string(v) for k, v in aux)


def snapshot_pieces(rows, aux=(), version: int = 9) -> Iterator[bytes]:
    """A snapshot file, piece by piece, of (db, key, raw, expire_ms, type) rows; a sixth value holds opcodes that go before the entry."""
    crc = 0

    def counted(piece: bytes) -> bytes:
        nonlocal crc
        crc = crc64_of(piece, crc)
        return piece

    yield counted(snapshot_head(aux, version))
    now = None
    for db, key, raw, expire, kind, *lead in rows:
        piece = b""
        if db != now:
            piece += select_database(db)
            now = db
        if expire is not None:
            piece += b"\xfc" + expire.to_bytes(8, "little")
        yield counted(piece + b"".join(x or b"" for x in lead) + bytes([kind]) + encode_string(key) + raw)
    yield counted(b"\xff")
    yield crc.to_bytes(8, "little")


def write_snapshot(rows, aux=(), version: int = 9) -> bytes:
    """A snapshot file of rows as in snapshot_pieces."""
    return b"".join(snapshot_pieces(rows, aux, version))


def _rows(run_id: str, entries, first: int = 0):
    for pos, entry in enumerate(entries, first):
        if entry is None:
            continue
        db, key, value, raw, expire, kind = entry
        at = None if expire is None else dt.datetime.fromtimestamp(expire / 1000, dt.timezone.utc)
        yield run_id, pos, db, key, value, raw, at, kind


#: Bytes of a snapshot that a task reads.
SPLIT = 32 << 20
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.timestamp("us", "UTC"), pa.int32()]
INDEX = "run_id string, path string, at long, db int, expire_ms long, pos long, stop long"


def snapshot_index(spark: SparkSession, base: str, split: int = SPLIT) -> DataFrame:
    """INDEX: places at which the snapshots under base can be cut, about every split bytes: offset, database, pending expiry, rows before, next place.

    One pass over each file that reads heads and short strings and seeks over
    the rest. The index is a table, which can be kept beside the files.
    """
    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                with Ranged(path) as f:
                    for marks in Skimmer(Cursor(f, piece=1 << 14)).stretches(split):
                        rows = [(path.split("/")[-2], path, *m, after[0]) for m, after in zip(marks, marks[1:], strict=False)]
                        cols = list(zip(*rows, strict=True)) or [[]] * 7
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rdb").load(base).select("path")
    return written(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, INDEX), "snapshot-index")


def read_snapshots(spark: SparkSession, base: str, check_crc: bool = False, split: int = SPLIT, index: DataFrame | None = None) -> DataFrame:
    """Rows of all snapshots under base; corrupt files fail the query.

    Files are cut at the places of index (snapshot_index, made here if it is not
    given), and each part is read by its range. With check_crc the checksums of
    blocks are joined to that of their file before, in a job of its own.
    """
    if not readable(base):
        return _read(spark, base, SCHEMA, check_crc, lambda run, r: _rows(run, r), KINDS)
    index = snapshot_index(spark, base, split) if index is None else index
    if check_crc:
        _check(index)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        yield from batched(rows(batches), KINDS, names)

    def rows(batches):
        for b in batches:
            for run_id, path, at, db, expire, pos, stop in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with Ranged(path) as f:
                    reader = SnapshotReader(Cursor(f, at, piece=min(1 << 18, stop - at)))
                    reader.seen = at
                    yield from _rows(run_id, reader.entries(db, expire, stop), pos)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return index.select(*[c.split()[0] for c in INDEX.split(", ")]).repartition(n, "path", "at").mapInArrow(run, SCHEMA)


#: Bytes whose checksum a task makes at a time, and of values in a batch.
BLOCK = 8 << 20


def _check(index: DataFrame) -> None:
    """Fail if the bytes of a file of the index differ from its checksum, where it has one."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = index.groupBy("path").agg(F.max("stop").alias("end")).select("path", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1) / BLOCK))).alias("k"))

    def run(batches):
        for b in batches:
            sums = []
            for path, end, k in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with Ranged(path) as f:
                    sums.append(crc64_of(f.read(k * BLOCK, min(BLOCK, end - k * BLOCK))).to_bytes(8, "little"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.binary())], names=["path", "end", "k", "crc"])

    def joined(t: pa.Table) -> pa.Table:
        crc = 0
        for r in t.sort_by("k").to_pylist():
            crc = crc64_joined(crc, int.from_bytes(r["crc"], "little"), min(BLOCK, r["end"] - r["k"] * BLOCK))
        with Ranged(r["path"]) as f:
            tail = f.read(r["end"], 8)
        if len(tail) == 8 and any(tail) and int.from_bytes(tail, "little") != crc:
            raise CorruptSnapshot("checksum differs")
        return pa.table({"path": [r["path"]]})

    sums = blocks.repartition(n, "path", "k").mapInArrow(run, "path string, end long, k long, crc binary")
    sums.groupBy("path").applyInArrow(joined, "path string").count()


def batched(rows, kinds: list, names: list[str], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, and of little more than BLOCK bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if len(part) == most or held > BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def read_aux(spark: SparkSession, base: str) -> DataFrame:
    """AUX pairs of all snapshots under base."""
    def pairs(run: str, r: SnapshotReader):
        r.passing = r.glides = isinstance(r.f, Cursor)
        for _ in r:
            pass
        yield from ((run, k, v) for k, v in r.aux)

    return _read(spark, base, AUX_SCHEMA, False, pairs, [pa.string(), pa.binary(), pa.binary()])


def _read(spark: SparkSession, base: str, schema: str, check_crc: bool, rows, kinds: list) -> DataFrame:
    """Whole files, each one stream: by ranges where the store allows it, else through Spark's reader, of 2 GB at most."""
    names = [f.split()[0] for f in schema.split(", ")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rdb").load(base)
    ranged = readable(base)
    files = files.select("path") if ranged else files.select("path", "content")

    def run(batches):
        for b in batches:
            for i, path in enumerate(b.column(0).to_pylist()):
                with Ranged(path) if ranged else io.BytesIO(b.column(1)[i].as_py()) as f:
                    yield from batched(rows(path.split("/")[-2], SnapshotReader(Cursor(f) if ranged else f, check_crc)), kinds, names)

    if ranged:
        files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, schema)


class _File(InputPartition):
    def __init__(self, run_id: str, path: str):
        self.run_id, self.path = run_id, path


class SnapshotSource(DataSource):
    """format("rdbSnapshot"): option path, a mounted folder base/{run_id}/*.rdb; checkCrc; reads files as streams of any size.

    Filters on run_id leave files out; entries of other databases or types than
    filters ask for are passed over, their long strings unread, unless checkCrc
    needs all bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "rdbSnapshot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotFiles(self.options)


class _SnapshotFiles(DataSourceReader):
    def __init__(self, options):
        self.base, self.check = required_local(options["path"]), options.get("checkCrc", "false") == "true"
        self.pushed = Pushed(("run_id", "db", "rdb_type"))

    def pushFilters(self, filters):
        return self.pushed.take(filters)

    def partitions(self):
        runs = self.pushed.tests().get("run_id", lambda _: True)
        return [
            _File(run, os.path.join(self.base, run, name))
            for run in sorted(os.listdir(self.base)) if os.path.isdir(os.path.join(self.base, run)) and runs(run)
            for name in sorted(os.listdir(os.path.join(self.base, run))) if re.fullmatch(r"\d+_\d+\.rdb", name)
        ]

    def read(self, partition):
        with Ranged(partition.path) as f:
            yield from self.rows(partition.run_id, f)

    def rows(self, run_id: str, f: Ranged):
        tests = self.pushed.tests()
        dbs, kinds = (tests.get(c, lambda _: True) for c in ("db", "rdb_type"))
        wanted = lambda db, op: dbs(db) and kinds(op)
        reader = SnapshotReader(Cursor(f, piece=1 << 16), self.check)
        reader.header()
        if self.check:
            entries = (e if wanted(e[0], e[5]) else None for e in reader.entries())
        else:
            entries = reader.entries(wanted=wanted if {"db", "rdb_type"} & set(tests) else None)
        yield from _rows(run_id, entries)


def register(spark: SparkSession) -> None:
    enable(spark)
    spark.dataSource.register(SnapshotSource)
