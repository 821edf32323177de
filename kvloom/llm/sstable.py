"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key:

    block*  index  bloom  footer

* key: 0x00 for a null id, else 0x01 and the id as 8 bytes, big-endian, sign bit flipped; bytewise order is id order.
* block: entries of varint(bytes shared with the key before), varint(length of the rest), varint(length of the value),
  rest of the key, value. The first entry of a block shares nothing. A block ends with the entry that reaches BLOCK_BYTES.
* value: the ids as little-endian integers of `width` bytes.
* index: for each block varint(length of its first key), the key, u64 offset, u32 length.
* bloom: bits of all keys, HASHES places each.
* footer: fixed size, see FOOTER; its last byte is the magic's line feed.

Lookup reads the footer, asks the Bloom filter, binary-searches the index and scans one block. The files are written by
Spark's own text writer (one value, one file), so a lost executor's half-written shards are never committed, and any
store that Spark can write to will do.
"""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.llm.bpe import Memory, Words, default_vocabulary, loaded, pieces
from kvloom.llm.common import materialize, scratch_dir, shuffle_partitions, table, tidy

MAGIC = b"KVSST1\x00\n"
#: index offset, bloom offset, entries, ids, blocks, bloom bits, hash places, id width, null key present, magic
FOOTER = struct.Struct("<QQQQIQHBB8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 32 << 20
BITS_PER_KEY = 10
HASHES = 7
END_ID = 1


def make_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def read_key(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Takes (key, ids) in ascending key order; finish() gives the file's bytes."""

    def __init__(self, width: int):
        self.width, self.out, self.block, self.index, self.keys = width, bytearray(), bytearray(), [], []
        self.n_ids, self.last, self.first = 0, b"", b""

    def __len__(self) -> int:
        return len(self.out) + len(self.block)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.first, len(self.out), len(self.block)))
            self.out += self.block
            self.block = bytearray()

    def finish(self) -> bytes:
        self._end_block()
        index_at = len(self.out)
        for key, at, size in self.index:
            self.out += _varint(len(key)) + key + struct.pack("<QI", at, size)
        bloom_at, bits = len(self.out), max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _places(key, bits, HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out += bloom
        null = int(bool(self.keys) and self.keys[0] == b"\x00")
        self.out += FOOTER.pack(index_at, bloom_at, len(self.keys), self.n_ids, len(self.index), bits, HASHES, self.width, null, MAGIC)
        return bytes(self.out)


class Shard:
    """Reader over a shard: read(at, n) gives bytes of it. Footer and index are read at once, the filter and blocks when asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        at = size - FOOTER.size
        tail = read(at, FOOTER.size) if at >= 0 else b""
        if not tail.endswith(MAGIC):
            raise ValueError("not a shard, or cut off")
        (self.index_at, self.bloom_at, self.n, self.n_ids, self.n_blocks, self.bits, self.hashes, self.width, self.null, _) = FOOTER.unpack(tail)
        self.blocks = []
        index, i = read(self.index_at, self.bloom_at - self.index_at), 0
        for _ in range(self.n_blocks):
            k, i = _read_varint(index, i)
            self.blocks.append((index[i : i + k], *struct.unpack_from("<QI", index, i + k)))
            i += k + 12
        self.firsts = [b[0] for b in self.blocks]
        self.bloom: bytes | None = None

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, end = self.blocks[block]
        data, at, key = self.read(at, end), 0, b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            value, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", value // self.width, at)
            at += value

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(self.n_blocks):
            for key, ids in self._entries(b):
                yield read_key(key), ids

    def may_contain(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self.read(self.bloom_at, (self.bits + 7) // 8)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(make_key(doc_id), self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id (more than one where rows repeat an id)."""
        if not self.n or not self.may_contain(doc_id):
            return []
        key, found = make_key(doc_id), []
        b = max(0, bisect_right(self.firsts, key) - 1)
        while b > 0 and self.firsts[b] == key:
            b -= 1
        for b in range(b, self.n_blocks):
            if self.firsts[b] > key:
                break
            found += [ids for k, ids in self._entries(b) if k == key]
        return found


class LibraryIds:
    """Ids of the tokenizers library's model, as little-endian u32; each distinct word is encoded once while it is remembered."""

    def __init__(self, path: str):
        self.words = Words(path)
        self.tokenize = self.words.library.model.tokenize
        self.memory = Memory(self._piece, 250_000)

    def _piece(self, piece: str) -> bytes:
        ids: list[int] = []
        for w in self.words.split(piece):
            ids += [w] if isinstance(w, int) else [t.id for t in self.tokenize(w)]
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __call__(self, text: str) -> bytes:
        memory = self.memory
        return b"".join([memory[p] for p in pieces(text)])


def write_shards(docs: DataFrame, out: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write shards of ascending ids to the folder out.

    Defined cases: null and empty texts hold only the end id; null ids come
    first; rows that repeat an id are all kept, in order of their text; an
    empty table writes no shard.
    """
    path = path or default_vocabulary()

    def shards(batches):
        encode = loaded(LibraryIds, path)
        # 2 bytes an id where the vocabulary allows it
        size = encode.words.library.get_vocab_size()
        writer = None
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(np.frombuffer(encode(text.as_py() or ""), "<u4"), np.uint32(END_ID))
                writer = writer or ShardWriter(2 if size <= 1 << 16 else 4)
                writer.add(make_key(doc_id), ids)
                if len(writer) >= SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[:-1]], pa.binary())], names=["shard"])
                    writer = None
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()[:-1]], pa.binary())], names=["shard"])

    # The cast keeps the bytes; the text writer adds the line feed that ends the magic.
    (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(shuffle_partitions(docs.sparkSession), "id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(tidy(shards), "shard binary")
        .select(F.col("shard").cast("string").alias("value"))
        .write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none").text(out)
    )


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, place, doc_id, ids as binary u32) of all documents, decoded from the files."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path"), F.col("content"))

    def rows(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard, place = Shard.of(data.as_py()), 0
                part: list = []
                for doc_id, ids in shard:
                    part.append((name, place, doc_id, ids.astype("<u4").tobytes()))
                    place += 1
                    if len(part) >= 256:
                        yield _batch(part)
                        part = []
                if part:
                    yield _batch(part)

    def _batch(part):
        cols = list(zip(*part, strict=True))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "place", "doc_id", "ids"])

    return files.mapInArrow(rows, "shard string, place long, doc_id long, ids binary")


class ShardStore:
    """Point lookups in a folder of shards, by ranged reads of the file system that Spark uses; n_read counts the bytes.

    Opening reads the footer and index of each shard (of SHARD_BYTES). A lookup
    finds the shards that can hold the id by their first keys, asks the Bloom
    filter, and reads one block.
    """

    def __init__(self, spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.n_read = self.size = 0
        found = []
        for status in self.files.listStatus(path):
            if not status.getPath().getName().startswith(("_", ".")) and status.getLen() > 0:
                self.size += status.getLen()
                found.append(Shard(functools.partial(self._read, status.getPath()), status.getLen()))
        self.shards = sorted(found, key=lambda s: s.firsts[0])
        self.firsts = [s.firsts[0] for s in self.shards]

    def _read(self, path, at: int, n: int) -> bytes:
        stream = self.files.open(path)
        try:
            stream.seek(at)
            data = bytes(stream.readNBytes(n))
        finally:
            stream.close()
        self.n_read += len(data)
        return data

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this id."""
        key, found = make_key(doc_id), []
        i = max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.shards) and self.firsts[i] <= key:
            found += self.shards[i].get(doc_id)
            i += 1
        return found


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids array<long>) of a few given ids; of many, join them with read_shards."""
    store = ShardStore(spark, folder)
    return spark.createDataFrame([(i, ids.tolist()) for i in doc_ids for ids in store.get(i)], "doc_id long, ids array<long>")


def digest_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the shards. Every file is read once; what follows reads the digests only."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def per_doc(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc, at, n, crc, start = [], [], [], [], 0
                for doc_id, ids in Shard.of(data.as_py()):
                    doc.append(doc_id)
                    at.append(start)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    start += len(ids)
                arrays = [pa.array([name] * len(doc), pa.string()), *[pa.array(x, pa.int64()) for x in (doc, at, n, crc)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = materialize(files.mapInArrow(tidy(per_doc), "shard string, doc_id long, at long, n_tokens long, ids_crc32 long"), "sst-digests")
    # One row for each shard of SHARD_BYTES; shards that begin with the same repeated id follow in file order.
    totals = rows.groupBy("shard").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null"), F.sum("n_tokens").alias("n_ids"))
    before = Window.orderBy(F.desc("null"), F.asc_nulls_first("first"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("shard", "base")
    return rows.join(totals, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "sst")
    write_shards(table(spark, sf_dir, "documents"), folder)
    return digest_shards(spark, folder)
