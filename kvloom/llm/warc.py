"""Web archives (WARC 1.1) of pages, and a two-level index of their captures.

Archives. A record is a zstandard frame of its own, so that any record can be
read by its range alone. Captures stand in order of their keys. Equal payloads
are stored once: the capture with the smallest id is a ``response``, the others
are ``revisit`` records that name it. An archive ends with a skippable frame of
one byte, the line feed of Spark's text writer, through which all files go (one
value, one file), so that half-written files of lost executors are never seen.

Index. Keys are URLs with the host reversed (``com,example,www)/path``), so
that captures of a site and its parts are neighbours. Sorted lines of captures
are pressed in blocks of BLOCK_LINES; a sparse directory of the blocks' first
lines stands behind them, and a footer behind it. The level above is the list
of index files with their first lines, one for SHARD_BYTES of pressed lines. A
lookup searches both by bisection, reads one block by its range, bisects its
lines, and reads the records by theirs; neighbours are read at once.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import materialize, quoted, scratch_dir, shuffle_partitions, table, tidy
from kvloom.sources.store import Ranged, listed

#: Smaller payloads are always stored.
MIN_REVISIT = 100
SHARD_BYTES = 32 << 20
BLOCK_LINES = 1024
#: Of all captures, the share from which on a payload's group is met by broadcast: at most 1 / HOT_SHARE groups.
HOT_SHARE = 1 / 2000
#: Bytes up to which neighbouring records are read at once, and bytes between them that are read along.
READ, GAP = 4 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Directory's offset, its bytes, blocks, magic. Its last byte is the writer's line feed.
FOOTER = struct.Struct("<QQI8s")
MAGIC = b"KVCDX1\x00\n"
SKIPPABLE = struct.pack("<II", 0x184D2A50, 1)
DIGEST = "sha256:"


def uri_of(url: Column) -> Column:
    """url as it can stand in a header: control characters and spaces by their numbers; null as empty."""
    plain = F.coalesce(url.cast("string"), F.lit(""))
    written = plain
    for code in [*range(33), 127]:
        written = F.replace(written, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(plain.rlike(r"[\x00-\x20\x7F]"), written).otherwise(plain)


def key_of(uri: Column) -> Column:
    """The host's labels from the last to the first, ``)``, and what follows the host. Without a host: ``)`` and all of it."""
    host = F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    rest = F.regexp_replace(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), F.lit(")"), rest)


# Archives --------------------------------------------------------------


def record(kind: str, uri: str, page_id: int | None, digest: str, size: int, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has HTTP headers only."""
    block = HTTP + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {date}"]
    if uri:
        head.append(f"WARC-Target-URI: {uri}")
    head += [f"WARC-Payload-Digest: {DIGEST}{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_urn(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _id(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == "none" else int(name)


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """(fields, place of the block) of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:]), end + 4


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of a record; ValueError if it is cut or its payload differs from its digest."""
    fields, at = headers(data)
    block = data[at : at + int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("cut record")
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if fields["WARC-Type"] == "response" and DIGEST + hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return fields, payload


def frame_end(data: bytes, at: int) -> int:
    """Where the zstandard frame that begins at a place ends, by its block headers alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & ~15 == 0x184D2A50:
        return at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    if magic != 0xFD2FB528:
        raise ValueError("not a zstandard frame")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def archive_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive's records, without its first, which describes the file."""
    at, raw = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        if data[at : at + 4] != SKIPPABLE[:4] and at:
            yield at, end - at, raw.decompress(data[at:end])
        at = end


def _written(rows: DataFrame, out: str) -> None:
    """rows (file binary) as files; the text writer adds the line feed that each ends with."""
    rows.select(F.col("file").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none").text(out)


def _file(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(quoted(html_col)).cast("binary"), F.lit(b""))
    uri = uri_of(F.col(quoted(url_col)))
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), uri.alias("uri"), payload.alias("payload"))
    return rows.select("page_id", "uri", key_of(F.col("uri")).alias("key"), F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"), "payload")


def revisits(captures: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(key, page_id, digest, refers_to) of the captures (page_id, key, digest, size) that repeat another's payload.

    Groups of a payload are found with map-side combining. The few that hold
    more than HOT_SHARE of all captures meet them by broadcast, the others by a
    join of small rows.
    """
    large = captures.filter(F.col("size") >= min_bytes)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    limit = captures.count() * HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("n") > limit).select("digest", F.col("first").alias("hot")))
    rows = large.select("key", "page_id", "digest").join(hot, "digest", "left")
    cold = rows.filter("hot IS NULL").drop("hot").join(groups.filter(F.col("n") <= limit).select("digest", "first"), "digest")
    both = cold.unionByName(rows.filter("hot IS NOT NULL").withColumnRenamed("hot", "first"))
    return both.filter("page_id IS NULL OR page_id > first").select("key", "page_id", "digest", F.col("first").alias("refers_to"))


def write_archives(
    pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT, date: str = DATE
) -> None:
    """Write a record for each row of pages to archives in the folder out, in order of keys and ids.

    Payloads are shuffled once: that a capture is a revisit is known from
    digests before, and comes beside it as a row of its own.

    Defined cases: null html has an empty payload, a null url no target URI; a
    null id repeats the payloads of others but is never referred to; rows that
    repeat the smallest id of a payload are responses all; an empty table writes
    no archive.
    """
    rows = _pages(pages, id_col, url_col, html_col)
    small = materialize(rows.select("page_id", "key", "digest", "size"), "warc-digests")
    again = revisits(small, min_bytes).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("key", "page_id", "digest", F.lit(1).alias("kind"), "uri", "size", "payload", none("long").alias("refers_to")).unionByName(
        again.select("key", "page_id", "digest", F.lit(0).alias("kind"), none("string").alias("uri"), none("int").alias("size"), none("binary").alias("payload"), "refers_to"))

    def archives(batches):
        press = zstandard.ZstdCompressor(level=3)
        # Of sizes unknown to the frame no reader could tell the end.
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:archive>\r\nWARC-Date: " + date.encode() + b"\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        file, told = bytearray(), None
        for b in batches:
            for i in range(b.num_rows):
                key, page_id, digest, kind, uri, size, payload, refers_to = (c[i].as_py() for c in b.columns)
                if kind == 0:
                    told = (key, page_id, digest), refers_to
                    continue
                to = told[1] if told and told[0] == (key, page_id, digest) else None
                file = file or bytearray(press.compress(info))
                file += press.compress(record("response" if to is None else "revisit", uri, page_id, digest, size, payload, to, date))
                if len(file) >= SHARD_BYTES:
                    yield _file(bytes(file) + SKIPPABLE)
                    file = bytearray()
        if file:
            yield _file(bytes(file) + SKIPPABLE)

    both = both.repartitionByRange(shuffle_partitions(pages.sparkSession), "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest", "kind")
    _written(both.mapInArrow(tidy(archives), "file binary"), out)


# Index -----------------------------------------------------------------

ENTRY = "uri string, page_id long, path string, offset long, length long"


def captures_in(spark: SparkSession, archives: str) -> DataFrame:
    """ENTRY of all records in a folder of archives."""
    def entries(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cols: list[list] = [[] for _ in range(5)]
                for offset, length, raw in archive_records(data.as_py()):
                    fields, _ = headers(raw)
                    for c, v in zip(cols, (fields.get("WARC-Target-URI", ""), _id(fields["WARC-Record-ID"]), path, offset, length), strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["uri", "page_id", "path", "offset", "length"])

    return spark.read.format("binaryFile").load(archives).select("path", "content").mapInArrow(tidy(entries), ENTRY)


def place(key: str, page_id: int | None) -> tuple[bytes, int]:
    """The order of captures: by key's bytes, as Spark sorts; of a key, ids in order, null first."""
    return key.encode(), -(1 << 63) - 1 if page_id is None else page_id


def _line(key: str, page_id: int | None, *rest) -> bytes:
    return "\t".join([key, "-" if page_id is None else str(page_id), *map(str, rest)]).encode()


def _read_line(line: bytes) -> tuple[tuple[bytes, int], list[bytes]]:
    key, page_id, *rest = line.split(b"\t")
    return (key, -(1 << 63) - 1 if page_id == b"-" else int(page_id)), rest


class IndexWriter:
    """Takes lines in order; finish() gives the file's bytes."""

    def __init__(self):
        self.out, self.lines, self.blocks, self.press = bytearray(), [], [], zstandard.ZstdCompressor(level=3)

    def add(self, key: str, page_id: int | None, path: str, offset: int, length: int) -> None:
        self.lines.append(_line(key, page_id, offset, length, path))
        if len(self.lines) == BLOCK_LINES:
            self._end_block()

    def _end_block(self) -> None:
        if self.lines:
            block = self.press.compress(b"\n".join(self.lines))
            first = b"\t".join(self.lines[0].split(b"\t")[:2])
            self.blocks.append(first + b"\t%d\t%d" % (len(self.out), len(block)))
            self.out += block
            self.lines = []

    def finish(self) -> bytes:
        self._end_block()
        directory = self.press.compress(b"\n".join(self.blocks))
        return bytes(self.out) + directory + FOOTER.pack(len(self.out), len(directory), len(self.blocks), MAGIC)


class IndexFile:
    """Reader of one index file by ranges: footer and directory when it opens, blocks when they are asked for."""

    def __init__(self, path: str):
        self.f = Ranged(path)
        tail = self.f.read(self.f.size - FOOTER.size, FOOTER.size) if self.f.size >= FOOTER.size else b""
        if not tail.endswith(MAGIC):
            raise ValueError(f"{path} is no index, or cut off")
        at, size, n, _ = FOOTER.unpack(tail)
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(at, size))
        self.blocks = [(p, int(o), int(s)) for p, (o, s) in map(_read_line, raw.split(b"\n"))] if n else []
        self.firsts = [b[0] for b in self.blocks]
        self.held: tuple[int, list] = (-1, [])

    def lines(self, block: int) -> list:
        if self.held[0] != block:
            _, at, size = self.blocks[block]
            raw = zstandard.ZstdDecompressor().decompress(self.f.read(at, size))
            self.held = block, [_read_line(x) for x in raw.split(b"\n")]
        return self.held[1]

    def between(self, low: tuple, high: tuple) -> Iterator[list[bytes]]:
        """(offset, length, path) of the captures from low to high, both included."""
        b = max(0, bisect_left(self.firsts, low) - 1)
        while b < len(self.blocks) and self.firsts[b] <= high:
            lines = self.lines(b)
            i = bisect_left(lines, low, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] <= high:
                yield lines[i][1]
                i += 1
            b += 1


def build_index(spark: SparkSession, archives: str, out: str) -> None:
    """Write the index of a folder of archives to the folder out; no file for no captures."""
    def shards(batches):
        writer = IndexWriter()
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                writer.add(*row)
                if len(writer.out) >= SHARD_BYTES:
                    yield _file(writer.finish()[:-1])
                    writer = IndexWriter()
        if writer.lines or writer.blocks:
            yield _file(writer.finish()[:-1])

    rows = materialize(captures_in(spark, archives).withColumn("key", key_of(F.col("uri"))).select("key", "page_id", "path", "offset", "length"), "warc-captures")
    rows = rows.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "path", "offset")
    _written(rows.mapInArrow(tidy(shards), "file binary"), out)


def index_files(spark: SparkSession, index: str) -> list[tuple[tuple[bytes, int], str]]:
    """The level above the directories: (first place, path) of each index file, in order. A row for SHARD_BYTES of pressed lines, some million captures."""
    def firsts(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                key, page_id = IndexFile(path).firsts[0]
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([key], pa.binary()), pa.array([None if page_id < -(1 << 63) else page_id], pa.int64())], names=["path", "key", "page_id"])

    paths = [(p,) for p, _ in listed(spark, index)]
    if not paths:
        return []
    rows = spark.createDataFrame(paths, "path string").repartition(shuffle_partitions(spark)).mapInArrow(firsts, "path string, key binary, page_id long").collect()
    return sorted((place(bytes(r["key"]).decode(), r["page_id"]), r["path"]) for r in rows)


FOUND = "wanted_uri string, page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class Searcher:
    """Looks captures up, in order of their places: files and blocks stay open while the next place lies in them."""

    def __init__(self, files: list[tuple[tuple[bytes, int], str]]):
        self.files, self.firsts = files, [f[0] for f in files]
        self.index: dict[int, IndexFile] = {}
        self.archive: Ranged | None = None

    def find(self, low: tuple, high: tuple) -> Iterator[tuple[str, int, int]]:
        """(path, offset, length) of the captures from low to high."""
        i = max(0, bisect_left(self.firsts, low) - 1)
        while i < len(self.files) and self.firsts[i] <= high:
            if i not in self.index:
                for old in self.index.values():
                    old.f.close()
                self.index = {i: IndexFile(self.files[i][1])}
            for offset, length, path in self.index[i].between(low, high):
                yield path.decode(), int(offset), int(length)
            i += 1

    def records(self, found: list[tuple[str, int, int]]) -> Iterator[tuple[int, bytes]]:
        """(place in found, record): neighbours in a file are read as one range."""
        raw, order = zstandard.ZstdDecompressor(), sorted(range(len(found)), key=found.__getitem__)
        i = 0
        while i < len(order):
            path, begin, length = found[order[i]]
            end, j = begin + length, i + 1
            while j < len(order) and (x := found[order[j]])[0] == path and x[1] <= end + GAP and x[1] + x[2] - begin <= READ:
                end, j = max(end, x[1] + x[2]), j + 1
            if self.archive is None or self.archive.path != path:
                if self.archive:
                    self.archive.close()
                self.archive = Ranged(path)
            data = self.archive.read(begin, end - begin)
            for k in order[i:j]:
                _, at, n = found[k]
                yield k, raw.decompress(data[at - begin : at - begin + n])
            i = j


def lookup(spark: SparkSession, index: str, wanted: DataFrame, url_col: str = "url", id_col: str | None = None) -> DataFrame:
    """FOUND: all captures of the wanted URLs, or, with id_col, those of a URL and page id.

    A URL or pair that is wanted several times is looked up once. wanted_uri is
    the URL as headers write it. The wanted places are dealt by range, so that
    each task meets its own part of the index in order; one URL's captures are
    spread where ids are wanted too. Payload is null for a revisit; its size and
    digest are those of the payload it refers to.
    """
    files = index_files(spark, index)
    of_one = id_col is not None
    rows = wanted.select(uri_of(F.col(quoted(url_col))).alias("uri"), (F.col(quoted(id_col)).cast("long") if of_one else F.lit(None).cast("long")).alias("page_id")).distinct()
    rows = rows.select(key_of(F.col("uri")).alias("key"), "page_id", "uri")
    rows = rows.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id", "uri")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in FOUND.split(", ")]

    def search(batches):
        searcher = Searcher(files)
        asked: list[str] = []
        found: list[tuple[str, int, int]] = []
        size = 0

        def emit():
            cols: list[list] = [[] for _ in kinds]
            for k, raw in searcher.records(found):
                fields, payload = parse_record(raw)
                uri = fields.get("WARC-Target-URI", "")
                if of_one and uri != asked[k]:  # another URL of the same key and id
                    continue
                revisit = fields["WARC-Type"] == "revisit"
                row = (
                    asked[k], _id(fields["WARC-Record-ID"]), uri, fields["WARC-Type"], _id(fields["WARC-Refers-To"]) if revisit else None,
                    int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix(DIGEST), None if revisit else payload,
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for key, page_id, uri in zip(*[c.to_pylist() for c in b.columns], strict=True):
                low = place(key, page_id)
                high = low if of_one else (low[0], 1 << 63)
                for hit in searcher.find(low, high):
                    asked.append(uri)
                    found.append(hit)
                    size += hit[2]
                    if size >= READ:
                        yield emit()
                        asked, found, size = [], [], 0
        if found:
            yield emit()

    return rows.mapInArrow(tidy(search), FOUND)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, archives, index = table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"), scratch_dir(spark, "cdx")
    write_archives(pages, archives)
    build_index(spark, archives, index)
    found = lookup(spark, index, pages, id_col="page_id")
    stored = F.col("record_type") == "response"
    return found.select(
        "page_id", F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
