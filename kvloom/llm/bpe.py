"""BPE encoding and decoding, equal to the tokenizers library for word-end BPE vocabularies.

Method: a segment tree over the ranks of adjacent pairs. The root gives the
leftmost merge of the lowest rank; a merge changes three leaves, each updated
in logarithmic time, until no pair can merge. A text of n symbols takes
O(n log n), also when it is one word of a million letters.

Normalisation and the split into words follow the library. Each distinct word
is encoded once for each worker while it is remembered; the memory is bounded.
A text with characters outside those of ``PLAIN`` is cut at white space first
(no word crosses it), and its chunks go through the library's own normaliser.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import each_batch, quoted, spread, table

#: Words in each of the two generations of a worker's memory.
MEMORY = 200_000
#: Longer words are encoded anew each time.
MEMORY_CHARS = 64
NO_MERGE = 1 << 62
#: Characters at which str.split() cuts but the library does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile("[\t\n\x0b\f\r \x85\xa0  -     　]+")
# Latin-1 characters that normalisation leaves as they are, but for case: ASCII, letters, punctuation (fixed values).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "«»¿¡"
PLAIN = re.sub(f"[^\t-\r -~{LETTERS}{MARKS}]", "", "".join(map(chr, range(256)))).encode("latin-1")
PLAIN_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
# The vocabulary's alphabet: bytes that print stand for themselves, the others follow from code point 256 on.
PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTS)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks(text: str) -> list[str]:
    """The text's parts between white space."""
    if NOT_SPACE.search(text):
        return [x for x in SPACES.split(text) if x]
    return text.split()


def is_plain(text: str) -> bool:
    """Whether all characters are of PLAIN and no special token can stand in the text."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


def pieces(text: str) -> list[str]:
    """What is encoded and remembered: the words of a plain text in lower case, else the chunks."""
    return PLAIN_WORDS.findall(text.lower()) if is_plain(text) else chunks(text)


class Memory(dict):
    """A dict that makes missing values, of bounded size: the older of two generations goes when the newer is full."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMORY_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Words:
    """The library's normaliser and pre-tokeniser over one piece of a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = {x["content"]: x["id"] for x in config["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def split(self, piece: str) -> list[str | int]:
        """Words in the vocabulary's alphabet, and ids of special tokens that stand in the text."""
        if is_plain(piece):
            words = PLAIN_WORDS.findall(piece.lower())
            return words if piece.isascii() else [w.encode().decode("latin-1").translate(ALPHABET) for w in words]
        out: list[str | int] = []
        for x in self.cut.split(piece) if self.cut else [piece]:
            if x in self.special:
                out.append(self.special[x])
            elif x:
                normal = self.library.normalizer.normalize_str(x)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out


class SegmentTreeBpe:
    def __init__(self, path: str):
        self.words = Words(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = vocab
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.words.special.items()}
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        #: (left id << 32 | right id) -> (rank << 32, merged id)
        self.merges = {vocab[a] << 32 | vocab[b]: (rank << 32, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.ids = Memory(self._ids, MEMORY // 2)
        self.both = Memory(self._both)

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the segment tree."""
        vocab = self.vocab
        ids = [vocab[c] for c in word[:-1] if c in vocab]
        if (last := word[-1] + self.suffix) in vocab:
            ids.append(vocab[last])
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges
        width = 1 << (n - 2).bit_length() if n > 2 else 1
        # Leaf i: rank of (symbol i, next symbol) in the high bits, i in the low ones, so the smallest is the leftmost lowest.
        tree = [NO_MERGE] * (2 * width)
        for i in range(n - 1):
            if (m := merges.get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[width + i] = m[0] | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            if tree[i] == value:
                return
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                value = value if value < other else other
                i >>= 1
                if tree[i] == value:
                    return
                tree[i] = value

        while (root := tree[1]) != NO_MERGE:
            i = root & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i] = merges[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            after[i] = k
            if j < n - 1:
                put(j, NO_MERGE)
            if k < n:
                before[k] = i
                m = merges.get(ids[i] << 32 | ids[k])
                put(i, NO_MERGE if m is None else m[0] | i)
            else:
                put(i, NO_MERGE)
            if (h := before[i]) >= 0:
                m = merges.get(ids[h] << 32 | ids[i])
                put(h, NO_MERGE if m is None else m[0] | h)
        return tuple(x for x in ids if x >= 0)

    def encode_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        for w in self.words.split(piece):
            if isinstance(w, int):
                ids.append(w)
            else:
                ids += self.encode_word(w)
        return ids

    def _ids(self, piece: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.encode_piece(piece)])

    def _both(self, piece: str) -> tuple[bytes, bytes]:
        ids = self.encode_piece(piece)
        return b"".join([i.to_bytes(4, "little") for i in ids]), self.decode(ids).encode()

    def encode_raw(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memory = self.ids
        return b"".join([memory[p] for p in pieces(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """As the library does for a vocabulary without a decoder: tokens joined by a space; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def encode_both(self, text: str) -> tuple[bytes, bytes]:
        """(ids as in encode_raw, the decoded ids in UTF-8)."""
        memory = self.both
        parts = [memory[p] for p in pieces(text)]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])


_LOADED: dict = {}


def loaded(kind: type, path: str):
    """One instance for each Python worker; workers serve many tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row.

    Defined cases: null and empty texts have no ids and decode to an empty
    text; rows that repeat an id each give a row; null ids stay null.
    """
    path = path or default_vocabulary()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(SegmentTreeBpe, path)
        ids, texts = [], []
        for text in b.column(1).to_pylist():
            raw, decoded = bpe.encode_both(text or "")
            ids.append(np.frombuffer(raw, "<u4").astype("i4"))
            texts.append(decoded.decode())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return spread(docs.select(id_col, text_col)).mapInArrow(each_batch(batch), schema)


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>) for each row, in the order of the rows; cases as in encode_documents."""
    path = path or default_vocabulary()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(SegmentTreeBpe, path)
        raw = [bpe.encode_raw(text.as_py() or "") for text in b.column(1)]
        sizes = np.array([0] + [len(r) // 4 for r in raw])
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes[1:], pa.int64()), ids], names=schema.names)

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(each_batch(batch), schema)


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, with digests made in the worker, so ids and texts never travel."""
    path = path or default_vocabulary()
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(SegmentTreeBpe, path)
        n, one, two = [], [], []
        for text in b.column(1):
            raw, decoded = bpe.encode_both(text.as_py() or "")
            n.append(len(raw) // 4)
            one.append(hashlib.sha256(raw).hexdigest())
            two.append(hashlib.sha256(decoded).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=schema.names)

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(each_batch(batch), schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
