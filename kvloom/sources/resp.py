"""RESP sources: decoding of columns and files, and Python data sources for batch and streams."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kvloom.functions.constants import DECODER_LIMIT
from kvloom.functions.wire import Decoder, WireError
from kvloom.sources.pushed import Pushed, enable
from kvloom.sources.store import Cursor, Ranged, readable, required_local

SCHEMA = "run_id string, start_offset long, end_offset long, name string, args array<binary>, _error string"
PIECE = 1 << 20


def decode_column(df: DataFrame, raw: str) -> DataFrame:
    """df without raw, with name and args of the command that raw holds."""
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if f.name != raw]
    schema = T.StructType([*keep, T.StructField("name", T.StringType()), T.StructField("args", T.ArrayType(T.BinaryType()))])
    names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            found, args = [], []
            for x in b.column(raw).to_pylist():
                d = Decoder()
                d.feed(x or b"")
                v = d.decode()
                cmd = v.command() if v else None
                found.append(cmd[0].decode("utf-8", "replace") if cmd else None)
                args.append(cmd[1] if cmd else None)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(found, pa.string()), pa.array(args, pa.list_(pa.binary()))], names=[*names, "name", "args"])

    return df.mapInArrow(run, schema)


VALUE_COLUMNS = "tag string, text string, used long, _error string"


def decode_values(df: DataFrame, raw: str, limit: int = DECODER_LIMIT) -> DataFrame:
    """df without raw, with the first value that raw holds: tag, its text, bytes used; an incomplete value has none, malformed or too many bytes an _error."""
    from pyspark.sql import types as T

    keep = [f for f in df.schema.fields if f.name != raw]
    names = [f.name for f in keep]
    found_schema = T._parse_datatype_string(VALUE_COLUMNS)

    def one(data: bytes | None) -> tuple:
        d = Decoder(limit)
        try:
            d.feed(data or b"")
            v = d.decode()
        except WireError as e:
            return None, None, 0, type(e).__name__
        return (v.tag, str(v), d.offset, None) if v else (None, None, 0, None)

    def run(batches):
        for b in batches:
            cols = list(zip(*map(one, b.column(raw).to_pylist()), strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [*[b.column(n) for n in names], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *found_schema.names])

    return df.mapInArrow(run, T.StructType([*keep, *found_schema.fields]))


def decode_log(run_id: str, start: int, pieces: Iterator[bytes], limit: int = DECODER_LIMIT, fail_fast: bool = False):
    """Rows of SCHEMA of one log; malformed bytes give one row with _error and end the log, or raise with fail_fast."""
    d = Decoder(limit)
    at = start
    try:
        for piece in pieces:
            d.feed(piece)
            for end, v in d:
                cmd = v.command()
                yield run_id, at, start + end, cmd[0].decode("utf-8", "replace") if cmd else None, cmd[1] if cmd else None, None if cmd else "not a command"
                at = start + end
    except WireError as e:
        if fail_fast:
            raise
        yield run_id, at, None, None, None, f"{type(e).__name__}: {e}"


#: Bytes of a log that a task decodes.
SPLIT = 32 << 20
HEADER = re.compile(rb"\*[1-9]\d{0,8}\r\n\$\d{1,10}\r\n")


class _Cut(Exception):
    """The file ends inside a value."""


def _pass(c: Cursor, limit: int, strict: bool) -> None:
    """Move behind one value without reading what it holds. strict: bulk strings must end in CRLF, which the decoder does not ask for."""
    left, begin = 1, c.at
    while left:
        left -= 1
        mark = c.read(1)
        if mark not in (b"+", b"-", b":", b"$", b"*"):
            if not mark:
                raise _Cut
            raise WireError(mark)
        line = c.line()
        if line is None:
            raise _Cut
        if mark in (b"+", b"-"):
            continue
        try:
            n = int(line)
        except ValueError:
            raise WireError(line) from None
        if mark == b":":
            continue
        if n < -1:
            raise WireError(n)
        if mark == b"*":
            left += max(0, n)
        elif n >= 0:
            if c.at + n + 2 - begin > limit:
                raise WireError(n)
            if not c.skip(n):
                raise _Cut
            if strict and c.peek(2) != b"\r\n":
                raise WireError("no CRLF")
            if not c.skip(2):
                raise _Cut


def _follow(f: Ranged, start: int, end: int, limit: int, strict: bool = False) -> int:
    """Where the first value begins that does not begin before end, from a value at start on. Malformed or cut: the file's size, as the log ends there."""
    c = Cursor(f, start, piece=min(1 << 18, max(1 << 12, end - start)))
    try:
        while c.at < end:
            _pass(c, limit, strict)
    except (WireError, _Cut) as e:
        if strict and isinstance(e, WireError):
            raise
        return f.size
    return c.at


def _whole(f: Ranged, limit: int) -> int | None:
    """Where the file's last whole value ends; None if malformed bytes come before."""
    c = Cursor(f)
    while True:
        at = c.at
        try:
            _pass(c, limit, False)
        except _Cut:
            return at
        except WireError:
            return None


def _guess(f: Ranged, begin: int, end: int, limit: int) -> tuple[int | None, int | None]:
    """(start, stop) of the values that seem to begin in a split: from the first array header behind a CRLF that can be followed to the end."""
    if begin == 0:
        return 0, _follow(f, 0, end, limit)
    at = begin
    while at < end:
        data = f.read(at - 2, min(PIECE, end - at) + 32)
        last = min(PIECE, end - at)
        for m in HEADER.finditer(data, 2):
            if m.start() - 2 >= last:
                break
            if data[m.start() - 2 : m.start()] == b"\r\n":
                start = at - 2 + m.start()
                try:
                    return start, _follow(f, start, end, limit, strict=True)
                except WireError:
                    continue
        at += last
    return None, None


GUESSES = "path string, k long, begin long, end long, start long, stop long"


def _chain(rows: pa.Table) -> pa.Table:
    """The splits of one file as far as they follow from one another; start is null where a split has to be followed anew from the place in stop."""
    rows = rows.sort_by("k")
    ends, starts, stops = (rows.column(c).to_pylist() for c in ("end", "start", "stop"))
    at = 0
    for i, end in enumerate(ends):
        if at >= end:
            starts[i] = stops[i] = at  # a value of an earlier split covers this one
        elif starts[i] == at:
            at = stops[i]
        else:
            # Taken as right for now, so that other breaks are found in the same round.
            starts[i], stops[i], at = None, at, stops[i] if stops[i] is not None else end
    kept = {"start": pa.array(starts, pa.int64()), "stop": pa.array(stops, pa.int64())}
    return pa.table([kept.get(c, rows.column(c)) for c in rows.column_names], rows.schema)


def split_logs(spark: SparkSession, base: str, split: int = SPLIT, limit: int = DECODER_LIMIT) -> DataFrame:
    """(run_id, path, offset, start, stop): stretches of whole values of all logs under base, each of about split bytes.

    Splits begin at arbitrary bytes. Each guesses its first value and passes
    over values to its end, without reading them; then each split's true end is
    compared with the next one's guess, and those that differ are passed over
    again from the true end. A value that covers splits leaves them empty.
    """
    from pyspark.sql import functions as F

    from kvloom.operators.segments import read_catalogue
    from kvloom.sources.shared import written

    files = read_catalogue(spark, base).filter((F.col("kind") == "aof") & (F.col("size") > 0)).select("run_id", "path", "offset", "size")
    n = F.floor((F.col("size") - 1) / split)
    splits = files.select("run_id", "path", "offset", "size", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"))
    splits = splits.withColumns({"begin": F.col("k") * split, "end": F.least((F.col("k") + 1) * split, "size")})
    if splits.filter("k > 0").isEmpty():
        return splits.select("run_id", "path", "offset", F.col("begin").alias("start"), F.col("end").alias("stop"))

    def found(how):
        def run(batches):
            for b in batches:
                rows = b.to_pylist()
                for r in rows:
                    with Ranged(r["path"]) as f:
                        r["start"], r["stop"] = how(f, r)
                yield pa.RecordBatch.from_pylist(rows, b.schema)
        return run

    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("long")
    todo = splits.select("path", "k", "begin", "end", none.alias("start"), none.alias("stop")).repartition(spread, "path", "k")
    known = written(todo.mapInArrow(found(lambda f, r: _guess(f, r["begin"], r["end"], limit)), GUESSES), "splits")
    while True:
        chain = written(known.groupBy("path").applyInArrow(_chain, GUESSES), "splits")  # a row for each split of a file
        again = chain.filter("start IS NULL")
        if again.isEmpty():
            break
        again = again.repartition(spread, "path", "k").mapInArrow(found(lambda f, r: (r["stop"], _follow(f, r["stop"], r["end"], limit))), GUESSES)
        known = written(known.join(again.select("path", "k"), ["path", "k"], "left_anti").unionByName(again), "splits")
    stretches = chain.filter("stop > start").select("path", "start", "stop")
    return files.join(stretches, "path").select("run_id", "path", "offset", "start", "stop")


def read_logs(spark: SparkSession, base: str, max_buffer: int = DECODER_LIMIT, mode: str = "PERMISSIVE", split: int = SPLIT) -> DataFrame:
    """Commands of all base/{run_id}/{offset}.aof segments. Files over split bytes are read by several tasks, each by ranges; what is malformed ends its file."""
    from pyspark.sql import functions as F

    if not readable(base):
        return _read_whole_logs(spark, base, max_buffer, mode)

    def run(batches):
        for b in batches:
            rows: list = []
            for run_id, path, offset, start, stop in zip(*[c.to_pylist() for c in b.columns], strict=True):
                with Ranged(path) as f:
                    for row in decode_log(run_id, offset + start, f.pieces(start, stop), max_buffer, mode == "FAILFAST"):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
            if rows:
                yield _batch(rows)

    stretches = split_logs(spark, base, split, max_buffer)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stretches.select("run_id", "path", "offset", "start", "stop").repartition(n, F.col("path"), F.col("start")).mapInArrow(run, SCHEMA)


def _read_whole_logs(spark: SparkSession, base: str, max_buffer: int, mode: str) -> DataFrame:
    """Stores that only Spark can read: one task for each file, of 2 GB at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.aof").load(base).select("path", "content")

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = re.search(r"([^/]+)/(\d+)\.aof$", path)
                if not m:
                    continue
                raw = data.as_py()
                pieces = (raw[i : i + PIECE] for i in range(0, len(raw), PIECE))
                rows: list = []
                for row in decode_log(m[1], int(m[2]), pieces, max_buffer, mode == "FAILFAST"):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, SCHEMA)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()), pa.string()]
    names = ["run_id", "start_offset", "end_offset", "name", "args", "_error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _segments(base: str) -> list[tuple[str, int, str, int]]:
    """(run_id, offset, path, size), by run and offset."""
    out = []
    for run in sorted(os.listdir(base)) if os.path.isdir(base) else []:
        folder = os.path.join(base, run)
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if m := re.fullmatch(r"(\d+)\.aof", name):
                path = os.path.join(folder, name)
                out.append((run, int(m[1]), path, os.path.getsize(path)))
    return sorted(out)


class _Stretch(InputPartition):
    def __init__(self, run_id: str, offset: int, path: str, begin: int, end: int | None):
        self.run_id, self.offset, self.path, self.begin, self.end = run_id, offset, path, begin, end


def _read(s: _Stretch, limit: int, fail_fast: bool):
    def pieces():
        left = None if s.end is None else s.end - s.begin
        with open(s.path, "rb") as f:
            f.seek(s.begin)
            while left is None or left > 0:
                data = f.read(PIECE if left is None else min(PIECE, left))
                if not data:
                    return
                if left is not None:
                    left -= len(data)
                yield data

    yield from decode_log(s.run_id, s.offset + s.begin, pieces(), limit, fail_fast)


class RespLogSource(DataSource):
    """format("respLog"): options path, maxBufferSize, mode, for streams maxBytesPerTrigger; reads and writes, in batches and streams, a mounted folder of segments."""

    @classmethod
    def name(cls) -> str:
        return "respLog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(self.options)

    def writer(self, schema, overwrite: bool):
        from kvloom.sources.sink import LogSink

        return LogSink(self.options, schema, overwrite)

    def streamWriter(self, schema, overwrite: bool):
        from kvloom.sources.sink import LogStreamSink

        return LogStreamSink(self.options, schema, overwrite)


class _LogReader(DataSourceReader):
    """Filters on run_id leave files out, those on name commands, before rows are made of them."""

    def __init__(self, options):
        self.base, self.limit, self.fail_fast = required_local(options["path"]), int(options.get("maxBufferSize", DECODER_LIMIT)), options.get("mode", "") == "FAILFAST"
        self.pushed = Pushed(("run_id", "name"))

    def pushFilters(self, filters):
        return self.pushed.take(filters)

    def partitions(self):
        runs = self.pushed.tests().get("run_id", lambda _: True)
        return [_Stretch(r, o, p, 0, None) for r, o, p, _ in _segments(self.base) if runs(r)]

    def read(self, partition):
        names = self.pushed.tests().get("name", lambda _: True)
        return (row for row in _read(partition, self.limit, self.fail_fast) if names(row[3]))


class _LogStream(DataSourceStreamReader):
    """The offset is the number of bytes of each segment, so planning lists files and opens none.

    A batch from byte a to z of a segment gives the commands that end there. Its
    task passes over the values before a, without reading them, to where the
    last whole one ends: a command that is cut by a batch, or by several, comes
    with the batch in which its last byte lies.
    """

    def __init__(self, options):
        self.base, self.limit, self.fail_fast = required_local(options["path"]), int(options.get("maxBufferSize", DECODER_LIMIT)), options.get("mode", "") == "FAILFAST"
        self.most = int(options.get("maxBytesPerTrigger", 0))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        left = self.most or None
        for _, _, path, size in _segments(self.base):
            more = max(0, size - self.seen.get(path, 0))
            more = more if left is None else min(more, left)
            left = None if left is None else left - more
            if more:
                self.seen[path] = self.seen.get(path, 0) + more
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        a, z = json.loads(start["files"]), json.loads(end["files"])
        return [_Stretch(r, o, p, a.get(p, 0), z[p]) for r, o, p, _ in _segments(self.base) if z.get(p, 0) > a.get(p, 0)]

    def read(self, partition):
        with Ranged(partition.path, end=partition.begin) as f:
            begin = _whole(f, self.limit)
        if begin is not None:
            yield from _read(_Stretch(partition.run_id, partition.offset, partition.path, begin, partition.end), self.limit, self.fail_fast)

    def commit(self, end: dict) -> None:
        self.seen = {**json.loads(end["files"]), **self.seen}


def register(spark: SparkSession) -> None:
    enable(spark)
    spark.dataSource.register(RespLogSource)
