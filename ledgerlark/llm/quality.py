"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Random indexing: every word has a fixed sparse random index vector; a word's vector is the sum of the index vectors of the words
around it in the training texts. Words outside the vocabulary share the vector of their shape (letters in upper or lower case, digits,
signs). A document is the mean of its words' vectors, the mean over its distinct words, and the share of distinct words.

The model is fitted on a bounded sample of labelled documents outside the held-out fold: the first DOCS documents in the order
of a hash of their id, and at most CHARS characters (beyond one document). A fifth of them is kept out of training to calibrate the
temperature.

Defined results. Null and empty texts are scored like any other, from the zero vector. Documents whose labels disagree are
left out of training, repeated labels count once. Without any label all scores are 1 (nothing is known against a text). Repeated rows are scored alike.
Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import WordCache, crc32_of_id, short_batches, texts

DOCS, CHARS = 3_000, 12_000_000
VOCABULARY, DIMENSIONS, NONZERO, NEIGHBOURS = 20_000, 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-4
THRESHOLD = 0.7
HELD_OUT = 2  # the fold of crc32(doc_id) mod 4 that is never learned from
CACHED = 100_000
_SHAPE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X" * 26 + "x" * 26 + "9" * 10)
_RUNS = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Letters as X or x, digits as 9, runs shortened to one."""
    plain = word.translate(_SHAPE)
    if not plain.isascii():
        plain = "".join(c if c.isascii() else "X" if c.isupper() else "x" if c.isalpha() else c for c in plain)
    return "\0" + _RUNS.sub(r"\1", plain)[:12]


def index_vectors(words: list[str]) -> np.ndarray:
    """Sparse random vectors of +1 and -1, fixed by the word itself."""
    out = np.zeros((len(words), DIMENSIONS), np.float32)
    for i, word in enumerate(words):
        bits = xxhash.xxh3_128_intdigest(word.encode())
        for _ in range(NONZERO):
            out[i, bits % DIMENSIONS] += 1 if bits >> 64 & 1 else -1
            bits = (bits >> 7) ^ (bits >> 64) * 0x9E37
    return out


@dataclass
class Model:
    ids: dict[str, int]  # words and shapes
    vectors: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def __post_init__(self):
        self.cache = None

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def id_of(self, word: str) -> int:
        found = self.ids.get(word)
        return self.ids.get(shape(word), 0) if found is None else found

    def pooled(self, whole: list[str]) -> np.ndarray:
        if self.cache is None:
            self.cache = WordCache(self.id_of, CACHED)
        out = np.zeros((len(whole), 2 * DIMENSIONS + 2), np.float32)
        for i, text in enumerate(whole):
            words = text.split()
            if words:
                distinct = set(words)
                for at, some in ((0, words), (DIMENSIONS, distinct)):
                    ids = np.bincount(np.fromiter(map(self.cache.__getitem__, some), np.int64, len(some)))
                    used = np.flatnonzero(ids)
                    out[i, at : at + DIMENSIONS] = ids[used] @ self.vectors[used] / len(some)
                out[i, -2:] = len(distinct) / len(words), np.log1p(len(words))
        return out

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((inputs - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, whole: list[str]) -> np.ndarray:
        if not self.layers:
            return np.ones(len(whole))
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(whole)) / self.temperature, -30, 30)))


def word_vectors(whole: list[str]) -> Model:
    """Random-indexing vectors of the most frequent words and of all shapes."""
    counts: Counter[str] = Counter()
    for text in whole:
        counts.update(text.split())
    common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1]
    names = ["\0", *common, *sorted({shape(w) for w in counts} - {"\0"})]
    model = Model({w: i for i, w in enumerate(names)}, np.zeros((len(names), DIMENSIONS), np.float32))
    index = index_vectors(names)
    for text in whole:
        words = text.split()
        if not words:
            continue
        ids = np.array([model.id_of(w) for w in words])
        shapes = np.array([model.ids[shape(w)] for w in words])
        around = np.zeros((len(ids), DIMENSIONS), np.float32)
        for k in range(1, NEIGHBOURS + 1):
            around[k:] += index[ids[:-k]]
            around[:-k] += index[ids[k:]]
        np.add.at(model.vectors, ids, around)
        other = shapes != ids
        np.add.at(model.vectors, shapes[other], around[other])
    model.vectors /= np.maximum(np.linalg.norm(model.vectors, axis=1, keepdims=True), 1e-9)
    model.vectors += index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)  # the word itself, besides its company
    return model


def fit(labelled: list[tuple[str, int]]) -> Model:
    """Train on (text, 0 or 1); every fifth row calibrates the temperature."""
    model = word_vectors([t for t, _ in labelled])
    if not labelled:
        return model
    inputs, target = model.pooled([t for t, _ in labelled]), np.array([q for _, q in labelled], np.float32)
    aside = np.arange(len(target)) % 5 == 4
    x, y = inputs[~aside], target[~aside]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    x = (x - model.mean) / model.scale
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for step in range(1, EPOCHS + 1):
        w1, b1, w2, b2 = layers
        hidden = np.tanh(x @ w1 + b1)
        wrong = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30))) - y) / len(y)
        back = np.outer(wrong, w2) * (1 - hidden**2)
        slopes = [x.T @ back + DECAY * w1, back.sum(0), hidden.T @ wrong + DECAY * w2, wrong.sum(keepdims=True)]
        for p, g, m, v in zip(layers, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if aside.any():
        logits, y = model.logits(inputs[aside]), target[aside]
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 81))

        def loss(t: float) -> float:
            z = np.clip(logits / t, -30, 30)
            return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z))

        model.temperature = float(min(options, key=loss))
    return model


def sample(docs: DataFrame, labels: DataFrame, doc_limit: int = DOCS, char_limit: int = CHARS) -> list[tuple[str, int]]:
    """(text, quality) of the bounded sample; a document's fold and order come from its id alone."""
    agreed = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null")
    agreed = agreed.filter(crc32_of_id(F.col("doc_id")) % 4 != HELD_OUT)
    agreed = agreed.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most")
    n = agreed.count()
    share = min(1.0, 2 * doc_limit / max(1, n))
    spread = F.xxhash64("doc_id")
    some = agreed.filter(F.pmod(spread, F.lit(1 << 30)) / float(1 << 30) <= share).withColumn("spread", spread)
    # At most about twice the limit of ids: proven small, so the texts are picked by a broadcast.
    some = some.orderBy("spread", "doc_id").limit(doc_limit)
    picked = texts(docs).join(F.broadcast(some), "doc_id")
    picked = picked.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("row = 1")
    order = Window.partitionBy(F.lit(0)).orderBy("spread", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    picked = picked.withColumn("before", F.coalesce(F.sum(F.length("text").cast("long")).over(order), F.lit(0))).filter(F.col("before") < char_limit)
    return [(r[0], r[1]) for r in picked.orderBy("spread", "doc_id").select("text", "quality").collect()]  # bounded by the limits


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    spark = docs.sparkSession
    short_batches(spark)
    held = spark.sparkContext.broadcast(model)  # at most VOCABULARY words and the sample's shapes

    def run(batches):
        model = held.value
        for batch in batches:
            found = np.round(model.scores(batch.column(1).to_pylist()), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and score all documents."""
    found = score(docs, fit(sample(docs, labels)))
    return found.select("doc_id", (crc32_of_id(F.col("doc_id")) % 4 == HELD_OUT).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that classify() accepts, with all their columns, filtered where they lie."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(fit(sample(docs, labels)))
    short_batches(spark)

    def run(batches):
        for batch in batches:
            whole = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(np.round(held.value.scores(whole), 6) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
