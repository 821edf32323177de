"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density, number and weight of lexicon words, lexicon words
near a second-person word, capitals, punctuation and obfuscation rates, length.
The lexicon holds the words that training documents of label 1 use much more
often than others.

Training reads a bounded sample (``MAX_TRAIN`` labelled documents, the smallest
by a hash of their id). Their words are counted on the executors; the driver
gets the words that pass the limits and MAX_TRAIN short feature vectors. Scoring
reads every whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvloom.llm.common import columns_of, each_batch, materialize, quoted, spread, table, unused
from kvloom.llm.language import fold

MAX_TRAIN = 20_000
#: Documents of label 1 that use a word of the lexicon, at least.
LEAST_DOCS = 3
#: A word's weight is the lower end of the 95 % range (one-sided) of the log odds of the label given the word against
#: without it, so that rare words that met label 1 by chance weigh little; and the weight of a word of the lexicon, at least.
SURE = 1.645
LEAST_ODDS = 1.0
#: Words to either side of a lexicon word in which a second-person word counts.
NEAR = 5
TREES, DEPTH, RATE, BINS, LEAF = 60, 4, 0.15, 64, 20
#: One part in this many of the training sample calibrates and doesn't grow trees.
CALIBRATION = 4
# Second-person words of the corpus languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros".split())
# Letters that look alike (fixed values).
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = " \t\n\r.,;:?!\"'()[]{}<>…«»“”‘’-–—*_~`^|/\\&%$#@+="
LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Codes of chunks; lexicon words follow from WORD on.
OTHER, SECOND, OBFUSCATED, WORD = range(4)
#: Added in the memory to the code of a chunk that is a lexicon word only in disguise.
DISGUISED = 1 << 40
#: Chunks in a worker's memory.
MEMORY = 150_000
NAMES = ("density", "weight", "hits", "top_weight", "near", "capitals", "exclaim", "question", "punctuation", "obfuscated", "hidden", "words", "word_length", "digits", "second")


class Featurizer:
    def __init__(self, lexicon: list[tuple[str, float]]):
        self.code = {w: i + WORD for i, (w, _) in enumerate(lexicon)}
        self.weight = np.array([0.0] * WORD + [x for _, x in lexicon])
        self.memory: dict[str, int] = {}
        chars = np.zeros((5, 256), bool)
        for row, letters in enumerate((range(65, 91), b"!", b"?", [c for c in range(33, 127) if not chr(c).isalnum()], range(48, 58))):
            chars[row, list(letters)] = True
        self.chars = chars.astype(float)

    def classify(self, chunk: str) -> int:
        """Code of a chunk between white space: that of its word in the lexicon, SECOND, OBFUSCATED or OTHER."""
        word = chunk.strip(EDGE).lower()
        if word in self.code:
            return self.code[word]
        if word in SECOND_PERSON:
            return SECOND
        if word.isalpha() or not word:
            # Look-alikes at the edges: stripping has taken them off.
            whole = chunk.lower().strip(" .,;:?\"'()[]{}<>").translate(LOOKALIKE)
            return self.code.get(whole, OTHER)
        plain = word.translate(LOOKALIKE)
        for form in (plain, "".join(LETTER_RUN.findall(plain))):
            if form in self.code:
                return self.code[form]
        if any(c.isalpha() for c in word):
            for p in LETTER_RUN.findall(word):
                if p in self.code:
                    return self.code[p]
            return OBFUSCATED
        return OTHER

    def _remembered(self, chunk: str) -> int:
        code = self.classify(chunk)
        plain = code < WORD or chunk.strip(EDGE).lower() in self.code
        return code if plain else code + DISGUISED

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        words, memory = text.split(), self.memory
        if len(memory) > MEMORY:
            memory.clear()
        codes = [memory.get(w, -1) for w in words]
        if -1 in codes:
            for i, c in enumerate(codes):
                if c < 0:
                    memory[words[i]] = codes[i] = memory[words[i]] if words[i] in memory else self._remembered(words[i])
        codes = np.array(codes, np.int64)
        hidden = int((codes >= DISGUISED).sum())
        codes %= DISGUISED
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n, size = max(1, len(words)), max(1, len(raw))
        capitals, exclaim, question, punctuation, digits = self.chars @ np.bincount(raw, minlength=256) / size
        weights = self.weight[codes] if len(codes) else np.zeros(0)
        hits = np.flatnonzero(codes >= WORD)
        you = np.flatnonzero(codes == SECOND)
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            after = np.abs(you[np.minimum(at, len(you) - 1)] - hits)
            before = np.abs(you[np.maximum(at - 1, 0)] - hits)
            near = int((np.minimum(after, before) <= NEAR).sum())
        odd = int((codes == OBFUSCATED).sum())
        return np.array([
            len(hits) / n, weights.sum() / n, len(hits), weights.max() if len(weights) else 0, near, capitals, exclaim, question,
            punctuation, odd / n, hidden, np.log1p(len(words)), size / n, digits, len(you) / n,
        ])


class Trees:
    """Second-order gradient boosting of the logistic loss on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        b, raw = self._bins(x), np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._walk(tree, b)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        """Nodes in heap order: feature (-1: leaf), last bin of the left side, value."""
        n = 2 ** (DEPTH + 1)
        feature, cut, value = np.full(n, -1), np.zeros(n, int), np.zeros(n)
        rows = {1: np.arange(len(g))}
        for node in range(1, n):
            own = rows.pop(node, None)
            if own is None:
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = -RATE * gs / (hs + 1)
            if node >= n // 2 or len(own) < 2 * LEAF:
                continue
            best = (1e-6, -1, 0)
            for f in range(b.shape[1]):
                bins = b[own, f]
                gl = np.cumsum(np.bincount(bins, g[own], BINS))[:-1]
                hl = np.cumsum(np.bincount(bins, h[own], BINS))[:-1]
                nl = np.cumsum(np.bincount(bins, minlength=BINS))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < LEAF) | (len(own) - nl < LEAF)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0] * (1 + 1e-6):  # equal gains: the first feature
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                left = b[own, best[1]] <= best[2]
                rows[2 * node], rows[2 * node + 1] = own[left], own[~left]
        return feature, cut, value

    @staticmethod
    def _walk(tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, every = np.ones(len(b), int), np.arange(len(b))
        for _ in range(DEPTH):
            f = feature[node]
            step = 2 * node + (b[every, np.maximum(f, 0)] > cut[node])
            node = np.where(f >= 0, step, node)
        return value[node]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.start + sum(self._walk(t, b) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending raw scores and the probabilities there."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for r, t in zip(raw[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + z for x, z in zip(blocks[-1], a, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: list[tuple[str, float]], x: np.ndarray, y: np.ndarray, calibrates: np.ndarray):
        self.lexicon, self.constant = lexicon, None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        grows = ~calibrates
        if not calibrates.any() or y[grows].min(initial=1) == y[grows].max(initial=0) or y[calibrates].min() == y[calibrates].max():
            grows = calibrates = np.ones(len(y), bool)
        self.trees = Trees(x[grows], y[grows])
        self.at, self.probability = isotonic(self.trees(x[calibrates]), y[calibrates])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = self.trees(x)
        flat = np.interp(raw, self.at, self.probability)
        # A thousandth of the uncalibrated probability keeps the trees' order where calibration is flat.
        return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-raw)), 0, 1)


def _features(docs: DataFrame, lexicon: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, toxic, x array<double>) of (doc_id, toxic, text)."""
    made: dict = {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "f" not in made:
            made["f"] = Featurizer(lexicon)
        x = [made["f"](t.as_py()) for t in b.column(2)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return docs.select("doc_id", "toxic", "text").mapInArrow(each_batch(batch), "doc_id long, toxic int, x array<double>")


def learn_lexicon(sample: DataFrame) -> list[tuple[str, float]]:
    """(word, weight) by documents that use the word: all words of the sample that pass both limits."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    n = sample.agg(F.count("*"), F.sum("toxic")).first()
    total, toxic = n[0] or 0, n[1] or 0
    if not toxic or toxic == total:
        return []
    used = sample.select("toxic", F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(
        F.sum("toxic").alias("t"), (F.count("*") - F.sum("toxic")).alias("f")
    )
    odds = F.log((F.col("t") + 0.5) * (total - toxic + 1) / ((F.col("f") + 0.5) * (toxic + 1)))
    weight = odds - SURE * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("f") + 0.5))
    # Bounded by the sample.
    rows = used.withColumn("weight", weight).filter((F.col("t") >= LEAST_DOCS) & (F.col("weight") >= LEAST_ODDS)).orderBy("word").collect()
    return [(r["word"], float(r["weight"])) for r in rows]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic), only rows that may be learned from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(MAX_TRAIN)
    # Of rows that repeat an id the least text stands for all: MAX_TRAIN rows.
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    calibrates = F.xxhash64(F.lit("part"), "doc_id") % CALIBRATION == 0
    sample = materialize(sample, "toxic-sample")
    # The calibrating part must not have helped to choose the words.
    lexicon = learn_lexicon(sample.filter(~calibrates))
    rows = _features(spread(sample), lexicon).withColumn("part", calibrates).orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    return Model(lexicon, x, np.array([float(r["toxic"]) for r in rows]), np.array([r["part"] for r in rows], bool))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """docs with the score added as the column ``name``, which docs must not have.

    Defined cases: null and empty texts are scored by the model as texts of no
    words; without training rows every score is 0, with one class only it is
    that class; each repeated row gives a row; other columns pass unchanged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees: bounded
    made: dict = {}
    # One struct of all columns passes unchanged, whatever their names are.
    rows = docs.select(F.struct(*columns_of(docs)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        if "f" not in made:
            made["f"] = Featurizer(shared.value.lexicon)
        x = np.array([made["f"](t.as_py()) for t in b.column(1)]).reshape(-1, len(NAMES))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value(x), pa.float64())], names=["doc", "score"])

    scored = rows.mapInArrow(each_batch(batch), schema)
    return scored.select(*[F.col("doc")[c].alias(c) for c in docs.columns], F.col("score").alias(name))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; columns unchanged."""
    model = train(docs.select("doc_id", "text"), learnable(labels))
    name = unused(docs, "__score")
    return score(docs, model, name=name).filter(F.col(name) < 0.5).select(*columns_of(docs))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
