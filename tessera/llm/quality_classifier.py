"""Quality classifier: Naive Bayes support vectors.

Texts become sets of hashed n-gram indicators (words, neighbouring words, word
shapes, neighbouring shapes and repeats).  Each indicator is scaled by its
class log-count ratio, texts are scaled to unit length, and a linear
hinge-loss model is fitted by dual coordinate descent.  Margins become
probabilities by a logistic fit on a part of the sample that the model has not seen.

The model is fitted on a bounded sample of labelled rows (``most_rows``, a
parameter); scoring is one narrow pass over whole texts with a weight table of
fixed size.

Edge cases: null and empty texts have no indicator and get the score of the
intercept; ids may be of any type; a repeated label row counts once (its lowest
label), and of the rows of one id only one is learnt from (that with the
smallest hash of its text); rows without an id are scored, not learnt from; with
one class or no labelled row every score is the share of label 1 (0.5 without
rows); repeated rows are scored one by one; very long texts are scored whole; an
empty table gives an empty table; a column named like the result is replaced,
others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .runtime import lean, prepare, widened

BITS = 18
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = 65
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[48:58] = 48


def indicators(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sorted distinct ``text index << bits | bucket`` of a block."""
    s, e, doc = tb.words(data, at)
    if not len(s):
        return np.empty(0, np.int64)
    word = tb.hashes(data, s, e, tb.LOWER)
    # A shape is the class of the first byte, the class of the last two and the word's length class.
    c = SHAPE[data]
    shape = tb.mix(c[s].astype(tb.U) | (c[e - 1].astype(tb.U) << tb.U(8)) | (c[np.maximum(e - 2, s)].astype(tb.U) << tb.U(16)) | (np.minimum(e - s, 20).astype(tb.U) // tb.U(4) << tb.U(24)))
    streams = [(word, doc)]
    for salt, (h, first) in enumerate((tb.grams(word, doc, 2), tb.grams(shape, doc, 1), tb.grams(shape, doc, 2), tb.grams(shape, doc, 3)), 1):
        streams.append((tb.mix(h + tb.U(salt)), doc[first]))
    same = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    streams.append((np.full(len(same), tb.U(0x51ED270B)), doc[same]))
    keys = np.concatenate([(d << bits) | (tb.mix(h) >> tb.U(64 - bits)).astype(np.int64) for h, d in streams])
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log of the share of an indicator among class 1 over that among class 0, smoothed."""
    p, q = np.full(size, alpha), np.full(size, alpha)
    for x, label in zip(rows, y):
        (p if label else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of an L2-regularised hinge-loss model; the last is the intercept's."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    sign = np.where(y > 0, 1.0, -1.0)
    share = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
    bound = np.where(y > 0, 0.5 / share[0], 0.5 / share[1]) * cost
    norm = np.array([v @ v + 1.0 for v in values])
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = sign[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[x] += step * v
                w[-1] += step
                worst = max(worst, abs(new - alpha[i]))
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of P(1) over margins, by Newton steps with smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    """``weight`` and squared ``scale`` of each bucket, intercept, and the logistic fit."""

    def __init__(self, weight, square, intercept, slope, offset, bits=BITS):
        self.weight, self.square, self.intercept, self.slope, self.offset, self.bits = weight, square, intercept, slope, offset, bits

    @classmethod
    def constant(cls, share: float, bits: int = BITS) -> "Model":
        share = min(max(share, 1e-3), 1 - 1e-3)
        return cls(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))), bits)

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n, keys = len(at) - 1, indicators(data, at, self.bits)
        doc, bucket = keys >> self.bits, keys & ((1 << self.bits) - 1)
        total = np.bincount(doc, weights=self.weight[bucket], minlength=n)
        length = np.sqrt(np.bincount(doc, weights=self.square[bucket], minlength=n))
        return total / np.maximum(length, 1e-12) + self.intercept

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, at) + self.offset, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> Model:
    """A model from indicator sets and labels; every fifth row only calibrates."""
    y = np.asarray(y)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return Model.constant(float(y.mean()) if len(y) else 0.5, bits)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    size = 1 << bits
    train = [rows[i] for i in np.flatnonzero(~held)]
    ratio = log_count_ratio(train, y[~held], size)
    values = [(v := ratio[x]) / max(np.linalg.norm(v), 1e-12) for x in train]
    w = dual_descent(train, values, y[~held], size)
    part = rows if not held.any() else [rows[i] for i in np.flatnonzero(held)]
    margin = np.array([(w[x] @ (v := ratio[x])) / max(np.linalg.norm(v), 1e-12) + w[-1] for x in part])
    slope, offset = logistic_fit(margin, y if not held.any() else y[held])
    return Model((w[:-1] * ratio).astype(np.float32), (ratio**2).astype(np.float32), float(w[-1]), slope, offset, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, allowed=None, among=F.min, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, version, h, y, text) and ``also`` of the rows of at most ``most_rows`` labelled documents, chosen by a hash of the id.

    ``among`` settles repeated labels; ``version`` and ``h`` are hashes of the text and the id.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        chosen = chosen.where(allowed)
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(most_rows)
    chosen = chosen.groupBy("_id").agg(among("_y").alias("y"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.xxhash64("doc_id", F.lit(11)).alias("h"), "text", *also)
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "version", "h", "y", "text", *also)


def one_row_each(features: DataFrame, also: tuple[str, ...] = ()) -> list:
    """The sample on the driver in a fixed order: of the rows of one id only that with the smallest hash of its text, so no more rows than labels."""
    kept = features.groupBy("h", "doc_id").agg(F.min(F.struct("version", "y", "x", *also)).alias("r")).select("h", "r.*").collect()
    return sorted(kept, key=lambda r: (r.h, r.version, bytes(r.x)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 8000, allowed=None, bits: int = BITS) -> Model:
    """Fit on at most ``most_rows`` labelled rows; executors send indicator sets, at most ``2**bits`` numbers each, not texts."""
    prepare(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, at in tb.blocks(batch.column("text")):
                keys = indicators(data, at, bits)
                cut = np.searchsorted(keys, np.arange(j - i + 1) << bits)
                out += [(keys[a:b] & ((1 << bits) - 1)).astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "version", "h", "y")), pa.array(out, pa.binary())], ["doc_id", "version", "h", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = one_row_each(labelled_sample(docs, labels, label, most_rows, allowed).mapInArrow(lean(features), f"doc_id {kind}, version long, h long, y int, x binary"))
    return fit([np.frombuffer(r.x, np.uint32) for r in rows], np.array([int(r.y > 0) for r in rows]), bits)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with ``column``; the weight table of ``2**bits`` entries is broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    base = docs.select(*[c for c in docs.columns if c != column])
    schema = widened(base.schema, **{column: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sent.value.score(data, at) for _, _, data, at in tb.blocks(batch.column("text"))]
            found = np.concatenate(made) if made else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, column])

    return base.mapInArrow(lean(run), schema)
