"""Language identification by word-first backoff.

A word that training saw scores its log frequency in each language. An unseen
word falls back to its longest character n-grams that training saw, from
``LONGEST`` letters down to one. A document's language has the highest sum.

Training reads a bounded sample (``MAX_TRAIN`` labelled documents, the smallest
by a hash of their id) and keeps all its words and n-grams, so the model that
goes to the workers stops growing with the corpus: some 100 bytes for each
distinct word and n-gram, 8 more for each language. Prediction reads every word
of every text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import each_batch, materialize, quoted, table

MAX_TRAIN = 10_000
LONGEST = 5
#: Added to every count.
SMOOTH = 0.5
#: Known chunks in a worker's memory, times languages.
MEMORY = 1_000_000
UNKNOWN = "und"
#: A letter is the same for training, prediction and ``und``: numerals and marks are none.
NO_LETTERS = r"[^\p{L}]+"
LETTERS = regex.compile(r"\p{L}+")


class Table:
    """Counts of keys by language as log frequencies: a row of one matrix for each key."""

    def __init__(self, keys: list[str], counts: np.ndarray):
        self.row = {k: i for i, k in enumerate(keys)}
        self.logs = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * len(keys)))

    @classmethod
    def of(cls, found: pa.Table, langs: list[str]) -> Table:
        """found: (key, lang, n), each key and language once."""
        key, lang = (found.column(c).combine_chunks().dictionary_encode() for c in ("key", "lang"))
        keys, place = key.dictionary.to_pylist(), {g: i for i, g in enumerate(langs)}
        column = np.array([place[g] for g in lang.dictionary.to_pylist()], np.int64)
        counts = np.zeros((len(keys), len(langs)))
        counts[key.indices.to_numpy(), column[lang.indices.to_numpy()]] = found.column("n").to_numpy()
        return cls(keys, counts)


class Model:
    """Log frequencies by word and n-gram; columns follow the languages in code point order. grams: n-grams of all lengths by length."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def word(self, word: str) -> np.ndarray:
        """Score of one lower-case word in each language."""
        if (known := self.words.row.get(word)) is not None:
            return self.words.logs[known]
        padded = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            found = [r for i in range(len(padded) - n + 1) if (r := table.row.get(padded[i : i + n])) is not None]
            if found:
                return table.logs[found].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts; distinct chunks between white space are scored once and kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.size = model, max(8192, MEMORY // max(1, len(model.langs)))
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        #: Row 0 is for chunks without letters.
        self.vectors = np.zeros((self.size + 1, len(self.model.langs)))
        self.used = 1

    def add(self, chunk: str) -> int:
        words = LETTERS.findall(chunk.lower())
        if not words:
            row = 0
        else:
            row, self.used = self.used, self.used + 1
            self.vectors[row] = sum(self.model.word(w) for w in words)
        self.rows[chunk] = row
        return row

    def __call__(self, text: str | None) -> tuple[str, float]:
        chunks = (text or "").split()
        total, letters = np.zeros(len(self.model.langs)), False
        for at in range(0, len(chunks), 4096):  # so that a part of a very long text always fits into the table
            part = chunks[at : at + 4096]
            rows = [self.rows.get(c, -1) for c in part]
            if -1 in rows:
                if self.used + len(part) >= self.size or len(self.rows) >= 4 * self.size:
                    self.clear()
                    rows = [-1] * len(part)
                rows = [r if r >= 0 else self.rows[c] if c in self.rows else self.add(c) for r, c in zip(rows, part, strict=True)]
            total += self.vectors[rows].sum(axis=0)
            letters = letters or any(rows)
        if not letters or not self.model.langs:
            return UNKNOWN, 0.0
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def train(labelled: DataFrame) -> Model:
    """labelled: (doc_id, text, lang), any number of rows."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = rows.select("doc_id").orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(MAX_TRAIN).distinct()
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # MAX_TRAIN ids
    words = sample.select("lang", F.explode(F.split(F.lower("text"), NO_LETTERS)).alias("key")).filter("key <> ''")
    words = materialize(words.groupBy("key", "lang").agg(F.count("*").alias("n")), "lang-words")
    # All n-grams that begin at a place of a word: those that would reach behind its end are shorter than they should be.
    places = words.select("lang", "n", F.concat(F.lit("^"), "key", F.lit("$")).alias("p")).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("p"))))
    grams = places.select("lang", "n", F.posexplode(F.array(*[F.substring("p", F.col("i"), F.lit(k)) for k in range(1, LONGEST + 1)])).alias("k", "key"))
    grams = grams.filter(F.length("key") == F.col("k") + 1).groupBy("key", "lang").agg(F.sum("n").alias("n")).withColumn("k", F.length("key"))
    # Bounded by the sample: what MAX_TRAIN documents hold.
    known, parts = words.toArrow(), grams.toArrow()
    langs = sorted(known.column("lang").unique().to_pylist())
    return Model(langs, Table.of(known, langs), {k: Table.of(parts.filter(pc.equal(parts.column("k"), k)), langs) for k in range(1, LONGEST + 1)})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row.

    Defined cases: a null text, one without letters, and any text under a model
    without languages gives ``und`` with score 0; equal sums go to the first
    language in code point order; each repeated row gives a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_TRAIN documents
    made: dict = {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in made:
            made["scorer"] = Scorer(shared.value)
        found = [made["scorer"](t.as_py()) for t in b.column(1)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    rows = docs.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(each_batch(batch), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    return predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
