"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, five-letter word stems, word pairs and pairs that
skip one word. The model is fitted on a bounded sample of labelled rows (``max_train``); the L1 term
leaves few non-zero weights, so the model that is broadcast never exceeds ``2 ** bits`` entries and is
usually a few thousand.

Defined cases: a null or empty text has no features and gets the bias alone; rows that repeat are each
scored, and of rows that repeat a labelled doc_id the least text is learnt from; labels with a null doc_id or label are
ignored and repeated labels count as their maximum; with no labels every score is 0.5. Ids may have any type with an order. Columns beside doc_id and text are passed over, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _ALNUM, K1, K2, K3, appended, batch, ddl, least_hashed, map_batches, mix, word_hashes

BITS = 20
MAX_TRAIN = 12_288


def held_out(doc_id: Column | str) -> Column:
    """True for the rows labels are never learnt from: crc32 of the id as text is divisible by 5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class _Hashes:
    """Words and stems of texts as 64-bit hashes."""

    def features(self, text: str | None, bits: int) -> np.ndarray:
        """Hashed feature indices of a text, repeats included."""
        tokens = (text or "").lower().encode("utf-8", "surrogatepass").translate(_ALNUM).split()
        h = word_hashes(tokens)
        stems = word_hashes([t[:5] for t in tokens])
        parts = (mix(h * K1), mix(stems * K2 + K1), mix(h[:-1] * K1 + h[1:] * K3 + K2), mix(h[:-2] * K3 + h[2:] * K1 + K3))
        return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint32)


class Ftrl:
    """FTRL-proximal with per-coordinate rates over binary features."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, l2: float = 1.0, bias_rate: float = 0.2):
        self.bits, self.alpha, self.beta, self.l1, self.l2, self.bias_rate = bits, alpha, beta, l1, l2, bias_rate
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, x: np.ndarray, y: int) -> None:
        """One example: x holds distinct indices."""
        w = self.weights(x)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -30, 30)))
        g = p - y
        n = self.n[x]
        grown = n + g * g
        self.z[x] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[x] = grown
        self.bias_n += g * g
        self.bias -= self.bias_rate * self.alpha * g / (self.beta + np.sqrt(self.bias_n))

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights()
        at = np.flatnonzero(w)
        return at.astype(np.uint32), w[at].astype(np.float32), float(self.bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_train`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    picked = least_hashed(picked, F.xxhash64("doc_id"), max_train, "doc_id")
    # at most max_train rows of two numbers: a proven bound
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN, epochs: int = 5, seed: int = 7) -> Ftrl:
    """Fit on a bounded labelled sample; features are hashed on the executors, the pass over them is sequential."""
    model = Ftrl()
    bits = model.bits

    def start():
        hashes = _Hashes()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = [np.unique(hashes.features(t, bits)).astype(np.int32) for t in b.column("text").to_pylist()]
            return batch(doc_id=b.column("doc_id"), y=b.column("y"), x=(x, pa.list_(pa.int32())))

        return run

    # Arrow keeps the indices at 4 bytes each on their way and here
    chosen = training_rows(docs, labels, label, max_train)
    rows = map_batches(chosen, f"{ddl(chosen.select('doc_id'))}, y int, x array<int>", start).toArrow().combine_chunks()
    by_id = pc.sort_indices(rows.column("doc_id")).to_numpy() if rows.num_rows else np.zeros(0, int)
    x = rows.column("x").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    flat, ends, ys = x.flatten().to_numpy(), np.r_[0, np.cumsum(x.value_lengths().to_numpy())].astype(np.int64), rows.column("y").to_numpy()
    xs, ys = [flat[ends[k] : ends[k + 1]] for k in by_id], ys[by_id]
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(xs)):
            model.learn(xs[i], int(ys[i]))
    return model


def _scorer(spark, model: Ftrl):
    """A function for the executors that makes a function from texts to log odds; only non-zero weights travel."""
    at, w, bias = model.sparse()
    bits = model.bits
    sent = spark.sparkContext.broadcast((at, w))

    def make():
        at, w = sent.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = w
        hashes = _Hashes()

        def odds(text: str | None) -> float:
            x = hashes.features(text, bits)
            return float(dense[np.unique(x[dense[x] != 0])].astype(np.float64).sum()) + bias

        return odds

    return make


def score(docs: DataFrame, model: Ftrl) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text."""
    make = _scorer(docs.sparkSession, model)

    def start():
        odds = make()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            g = np.array([odds(t) for t in b.column("text").to_pylist()], float)
            return appended(b, ["doc_id", "held_out"], score=(1 / (1 + np.exp(-np.clip(g, -30, 30))), pa.float64()))

        return run

    narrow = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    scored = map_batches(narrow, f"{ddl(narrow.select('doc_id'))}, held_out boolean, score double", start)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the fitted model doesn't call toxic, with the columns they came with."""
    make = _scorer(docs.sparkSession, fit(docs, labels))

    def start():
        odds = make()
        return lambda b: b.filter(pa.array([odds(t) < 0 for t in b.column("text").to_pylist()], pa.bool_()))

    return map_batches(docs, ddl(docs), start)
