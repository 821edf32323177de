"""Fill-in-middle transformation: a text's prefix, suffix and middle, rearranged.

Method: succinct rank/select. A packed bitvector marks the bytes at which a token
begins, with the number of ones before each block beside it. All ones are the
number of tokens; select on two ranks gives the byte cuts; rank on the bitvector
of code points turns byte cuts into lengths.

Tokens are ``[A-Za-z]+|[^A-Za-z]``: a run of ASCII letters, or any other code point.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm.common import each_batch, quoted, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts: those from this share on stay plain; of the others, those below it put the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: 64-bit words in a block of the directory.
BLOCK = 8
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class Bits:
    """A packed bitvector with a directory of ones before each block."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        blocks = len(packed) // (8 * BLOCK) + 1
        words = np.zeros(blocks * BLOCK * 8, np.uint8)
        words[: len(packed)] = packed
        self.words = words.view("<u8").reshape(blocks, BLOCK)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).sum(1, dtype=np.int64), out=self.before[1:])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, i: int) -> int:
        """Ones before place i."""
        block, inside = divmod(i, 64 * BLOCK)
        word, bit = divmod(inside, 64)
        own = self.words[block]
        return int(self.before[block] + np.bitwise_count(own[:word]).sum(dtype=np.int64)) + (int(own[word]) & ((1 << bit) - 1)).bit_count()

    def select(self, k: int) -> int:
        """The place of the one that k ones stand before; the length, if there is none."""
        if k >= self.total:
            return self.n
        block = int(np.searchsorted(self.before, k, "right")) - 1
        left = k - int(self.before[block])
        for word, x in enumerate(self.words[block].tolist()):
            ones = x.bit_count()
            if left < ones:
                break
            left -= ones
        for _ in range(left):
            x &= x - 1
        return (block * BLOCK + word) * 64 + (x & -x).bit_length() - 1


def boundaries(text: bytes) -> tuple[Bits, Bits]:
    """(tokens, code points): the bytes at which one begins."""
    x = np.frombuffer(text, np.uint8)
    begins = (x & 0xC0) != 0x80
    letter = LETTER[x]
    tokens = begins.copy()
    tokens[1:] &= ~(letter[1:] & letter[:-1])
    return Bits(tokens), Bits(begins)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on seed and id alone; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(doc_id: int | None, text: bytes, seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    tokens, chars = boundaries(text)
    n = tokens.total
    a, b, plain, first = draws(doc_id, seed)
    if not text or plain % 100 >= PLAIN_FROM or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    i, j = tokens.select(lo), tokens.select(hi)
    before, until = chars.rank(i), chars.rank(j)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if first % 100 < SUFFIX_FIRST:
        return n, "spm", before, until - before, b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
    return n, "psm", before, until - before, b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    Defined cases: a null or empty text is plain, with no tokens and an empty
    output; a text that holds a marker stays plain; rows that repeat an id draw
    the same numbers; a null id draws those of an empty one. Other columns,
    whatever their names, are not looked at.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [rearranged(i, t or b"", seed) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        arrays = [pa.array(c, k) for c, k in zip(cols[:4], kinds, strict=False)] + [pa.array(cols[4], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(each_batch(one), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. No marker stands in a rearranged text, and none arises where parts meet, so the first of each is the one that was put there."""
    between = lambda one, two: F.substring(output, F.instr(output, one) + 3, F.instr(output, two) - F.instr(output, one) - 3)
    middle = F.substring(output, F.instr(output, MIDDLE) + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
