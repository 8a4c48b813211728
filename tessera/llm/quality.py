"""Quality: positive-unlabelled learning by the non-negative unbiased risk.

Trusted positives are labelled good rows outside the held-out fold; unlabelled are web texts whatever
their label. A first positive-against-unlabelled model gives an estimate of the class prior (the smallest
ratio of unlabelled to positive mass above any threshold, on rows it wasn't fitted to); the final model
minimises pi * R+(g) + max(0, Ru-(g) - pi * Rp-(g)) with the sigmoid loss, over one-hot quantile bins of
document statistics. Both samples are bounded (``max_train`` rows each) and chosen by a hash of the id.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; rows that repeat
are each scored, and of rows that repeat a doc_id the least text is learnt from; ids may have any type with an order; with no positives or no texts every score is 0.5; other columns are passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, batch, ddl, least_hashed, map_batches, raw_bytes
from tessera.llm.toxicity import held_out

MAX_TRAIN = 8192
BINS = 12

_CAPS, _SMALL = re.compile(rb"[A-Z]|\xc3[\x80-\x9e]"), re.compile(rb"[a-z]|\xc3[\x9f-\xbf]")
_ALPHA = re.compile(rb"[A-Za-z\x80-\xff]")


def statistics(text: str | None) -> list[float]:
    """Shares and log counts that tell prose from junk; all are 0 for an empty text."""
    b = raw_bytes(text)
    words = b.split()
    n, size = len(words), len(b)
    if not n:
        return [0.0] * 16
    count = lambda chars: size - len(b.translate(None, chars))
    caps, small = len(_CAPS.findall(b)), len(_SMALL.findall(b))
    lines = [x for x in b.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    chars = sum(map(len, words))
    bare = sum(1 for w in words if not _ALPHA.search(w))
    return [
        float(np.log1p(n)),
        chars / n,
        caps / (caps + small + 1),
        count(b"#*$%&|<>") / size,
        count(b"!?") / n,
        count(b".,;:") / n,
        count(b"0123456789") / size,
        distinct / n ** 0.85,
        (pairs + 1) / n,
        runs / n,
        bare / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        count(b"{}[]()=_/\\@") / size,
        max(map(len, words)) ** 0.5,
        (small + caps) / size,
    ]


@dataclass
class Model:
    """Additive model over binned statistics."""

    edges: np.ndarray  # statistic x (BINS - 1)
    weights: np.ndarray  # statistic x BINS
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = binned(x, self.edges)
        return _sigmoid(self.weights[np.arange(at.shape[1])[None, :], at].sum(1) + self.bias)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(x.shape[1])], 1)


def _descend(ap: np.ndarray, au: np.ndarray, prior: float | None, steps: int, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; without a prior, on plain logistic loss of positives against unlabelled."""
    d = ap.shape[1]
    flat = lambda a: (a + np.arange(d)[None, :] * BINS).ravel()
    fp, fu = flat(ap), flat(au)
    w, b = np.zeros(d * BINS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    spread = lambda f, g, k: np.bincount(f, np.repeat(g, d), d * BINS) / k
    for t in range(1, steps + 1):
        sp, su = _sigmoid(w[fp].reshape(-1, d).sum(1) + b), _sigmoid(w[fu].reshape(-1, d).sum(1) + b)
        if prior is None:
            gp, gu = (sp - 1) / 2, su / 2
        else:
            dp, du = sp * (1 - sp), su * (1 - su)
            if su.mean() >= prior * sp.mean():
                gp, gu = -2 * prior * dp, du
            else:  # step back from overfitting the unlabelled rows
                gp, gu = prior * dp, -du
        gw = spread(fp, gp, len(sp)) + spread(fu, gu, len(su)) + decay * w
        gb = gp.mean() + gu.mean()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * m / c1 / (np.sqrt(v / c2) + 1e-8)
        b -= rate * mb / c1 / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive mass above a threshold that at least half of the positives pass."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    ratios = [(unlabelled >= t).mean() / max((positive >= t).mean(), 1e-9) for t in at]
    return float(np.clip(min(ratios), 0.05, 0.98))


def fit_arrays(p: np.ndarray, u: np.ndarray, steps: int = 500) -> Model:
    """Fit on statistics of positives and of unlabelled texts."""
    d = len(statistics(None))
    if not len(p) or not len(u):
        return Model(np.zeros((d, BINS - 1)), np.zeros((d, BINS)), 0.0, 0.5)
    both = np.concatenate([p, u])
    tails = np.array([0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.995])
    edges = np.quantile(both, tails, axis=0).T.copy()
    ap, au = binned(p, edges), binned(u, edges)
    score = lambda a, w, b: w[a + np.arange(d)[None, :] * BINS].sum(1) + b
    w, b = _descend(ap[::2], au[::2], None, steps)
    prior = estimate_prior(score(ap[1::2], w, b), score(au[1::2], w, b))
    w, b = _descend(ap, au, prior, steps)
    return Model(edges, w.reshape(d, BINS), b, prior)


def _statistics_of():
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in b.column("text").to_pylist()]
        return batch(doc_id=b.column("doc_id"), p=b.column("p"), x=(x, pa.list_(pa.float64())))

    return run


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` positives and ``max_train`` unlabelled texts."""
    narrow = docs.select("doc_id", "text")
    positives = (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .select("doc_id")
        .distinct()
    )
    positives = least_hashed(positives, F.xxhash64("doc_id"), max_train, "doc_id")
    chosen = least_hashed(docs.select("doc_id").where(F.col("doc_id").isNotNull()), F.xxhash64("doc_id", F.lit(1)), max_train, "doc_id")
    ids = positives.withColumn("p", F.lit(1)).unionByName(chosen.distinct().withColumn("p", F.lit(0)))
    # at most 2 * max_train ids: a proven bound, and one text an id
    found = narrow.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
    rows = map_batches(found, f"{ddl(found.select('doc_id'))}, p int, x array<double>", _statistics_of).toArrow()
    rows = rows.take(pc.sort_indices(rows, [("p", "ascending"), ("doc_id", "ascending")]))
    p = rows.column("p").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(p), -1) if len(p) else np.zeros((0, len(statistics(None))))
    is_p = p == 1
    return fit_arrays(x[is_p], x[~is_p])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, over its whole text."""

    def start():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(b.num_rows, -1)
            return appended(b, ["doc_id", "held_out"], score=(model.score(x) if b.num_rows else [], pa.float64()))

        return run

    narrow = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    scored = map_batches(narrow, f"{ddl(narrow.select('doc_id'))}, held_out boolean, score double", start)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
