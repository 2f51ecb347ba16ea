"""Toxicity by a convolutional text classifier.

Words are hashed into an embedding table; filters of widths 1 to 3 run over
the whole text, the largest value of each filter is kept, and a logistic layer
scores them.  Everything is trained in numpy on a bounded sample of labelled
rows.  The first embedding component starts from the class log-count ratio of
its bucket, so that training starts from what single words tell.

Thresholds are calibrated by language on a part of the sample that training
has not seen: each language gets the threshold with the fewest errors, and the
score is shifted so that this threshold reads 0.5.  The language is guessed
from the words of the text itself (by a table learnt from the sample), never
taken from a column.

Edge cases: null and empty texts are one window of padding and get its score;
ids may be of any type; a repeated label row counts once (its highest label), and
of the rows of one id only one is learnt from (that with the smallest hash of
its text); rows without an id are scored, not learnt from; with one class or no
labelled row every score is constant; repeated rows are scored one by one; very
long texts are scored whole; an empty table gives an empty table; a column named
like the result is replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .nets import Adam, add_rows
from .quality_classifier import labelled_sample, one_row_each
from .runtime import prepare, widened

BITS, DIM, REACH = 20, 8, 3
WIDTHS = (1,) * 12 + (2,) * 8 + (3,) * 8
STRIP = np.zeros(256, bool)
STRIP[33:48] = STRIP[58:65] = STRIP[91:97] = STRIP[123:127] = True


def word_buckets(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word, lower-cased and without ASCII punctuation; bucket 0 is padding's."""
    s, e, doc = tb.spans(~(tb.SPACE | STRIP)[data], at)
    h = tb.hashes(data, s, e, tb.LOWER)
    return np.maximum((h >> tb.U(64 - bits)).astype(np.int64), 1), doc


class Network:
    """Embeddings, filters, output layer, language table and thresholds."""

    def __init__(self, bits: int = BITS, seed: int = 21):
        rng = np.random.default_rng(seed)
        f = len(WIDTHS)
        self.bits = bits
        self.mask = (np.arange(REACH)[:, None] < np.array(WIDTHS)[None, :]).astype(np.float32)
        self.e = rng.normal(0, 0.01, (1 << bits, DIM)).astype(np.float32)
        self.e[0] = 0
        w = rng.normal(0, 0.2, (REACH, DIM, f)) * self.mask[:, None, :]
        w[0, 0, :6] = 0.5
        self.p = {"w": w.astype(np.float32), "b": np.zeros(f, np.float32), "o": np.where(np.arange(f) < 6, 0.3, rng.normal(0, 0.1, f)).astype(np.float32), "c": np.full(1, -1.0, np.float32)}
        self.languages = np.full(1 << bits, -1, np.int8)
        self.shift = np.zeros(1)
        self.slope = 1.0

    def convolve(self, bucket: np.ndarray) -> np.ndarray:
        """Filter values at each start in a padded row of words."""
        e = self.e[bucket]
        n = len(bucket) - REACH + 1
        cols = np.concatenate([e[j : j + n] for j in range(REACH)], axis=1)
        return cols @ self.p["w"].reshape(REACH * DIM, -1)

    def logits(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Raw log-odds of ``n`` texts, every word in turn."""
        count = np.bincount(doc, minlength=n)
        width = count + REACH
        start = np.concatenate([[0], np.cumsum(width)])
        padded = np.zeros(start[-1] + REACH, np.int64)
        padded[np.arange(len(bucket)) + REACH * doc] = bucket
        # A text's starts are its words and one of padding alone; starts in the rest of the padding see the next text.
        out = np.empty((n, len(WIDTHS)), np.float32)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(start, start[i] + 16384, "right")) - 1)
            conv = self.convolve(padded[start[i] : start[j] + REACH - 1])
            local = start[i : j + 1] - start[i]
            spoil = np.concatenate([local[1:] - k for k in range(1, REACH)])
            conv[spoil] = -np.inf
            out[i:j] = np.maximum.reduceat(conv, local[:-1], axis=0)
            i = j
        return np.maximum(out + self.p["b"], 0) @ self.p["o"] + self.p["c"][0]

    def language(self, bucket: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """The language number that most known words of a text speak for; 0 without any."""
        own = self.languages[bucket]
        seen = own >= 0
        k = len(self.shift)
        votes = np.bincount(doc[seen] * k + own[seen], minlength=n * k).reshape(n, k)
        return votes.argmax(axis=1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        bucket, doc = word_buckets(data, at, self.bits)
        z = self.slope * (self.logits(bucket, doc, n) - self.shift[self.language(bucket, doc, n)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def start_from_counts(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Log-ratios of the texts that hold a bucket, by class, as the first embedding component."""
        up, down = np.full(1 << self.bits, 0.5), np.full(1 << self.bits, 0.5)
        for x, label in zip(rows, y):
            (up if label else down)[np.unique(x)] += 1
        ratio = np.log(up / (y.sum() + 1)) - np.log(down / ((1 - y).sum() + 1))
        # Rare buckets tell little: shrink by the number of texts.
        n = up + down - 1
        self.e[:, 0] = np.where(n > 0, ratio * n / (n + 5), 0)
        self.e[0] = 0

    def train(self, rows: list[np.ndarray], y: np.ndarray, rounds: int = 6, batch: int = 32, seed: int = 22) -> None:
        rng, adam, p = np.random.default_rng(seed), Adam(0.01), self.p
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        square = np.zeros((1 << self.bits, 1), np.float32)
        for turn in range(rounds):
            adam.rate = 0.01 / (1 + turn)
            for take in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                padded = [np.concatenate([rows[i], np.zeros(REACH, np.int64)]) for i in take]
                spots, tops = [], []
                for x in padded:
                    conv = self.convolve(x)
                    at = conv.argmax(axis=0)
                    spots.append(x[at[:, None] + np.arange(REACH)])
                    tops.append(conv[at, np.arange(conv.shape[1])])
                ids, top = np.stack(spots), np.stack(tops) + p["b"]
                hidden = np.maximum(top, 0)
                prob = 1 / (1 + np.exp(-np.clip(hidden @ p["o"] + p["c"][0], -30, 30)))
                d = ((prob - y[take]) * weight[take] / len(take)).astype(np.float32)
                g = d[:, None] * p["o"][None, :] * (top > 0)
                grad_w = np.einsum("bf,bfjd->jdf", g, self.e[ids]) * self.mask[:, None, :]
                back = np.einsum("bf,jdf->bfjd", g, p["w"]).reshape(-1, DIM)
                adam.step(p, {"o": hidden.T @ d + 1e-4 * p["o"], "c": d.sum(keepdims=True), "b": g.sum(0), "w": grad_w})
                keys, grad = add_rows(self.e, ids.ravel(), back)
                real = keys > 0
                keys, grad = keys[real], grad[real]
                square[keys, 0] += (grad**2).mean(axis=1)
                self.e[keys] -= 0.05 * grad / (np.sqrt(square[keys]) + 1e-6)

    def learn_languages(self, rows: list[np.ndarray], lang: list[str | None]) -> None:
        """Buckets that stand in one language only, nearly always."""
        names = sorted({x for x in lang if x is not None})
        if not names:
            return
        counts = np.zeros((len(names), 1 << self.bits), np.float32)
        for x, name in zip(rows, lang):
            if name is not None:
                counts[names.index(name), np.unique(x)] += 1
        counts /= np.maximum(np.array([[sum(1 for x in lang if x == n)] for n in names]), 1)
        top, total = counts.max(axis=0), counts.sum(axis=0)
        self.languages = np.where((total > 0) & (top > 0.8 * total), counts.argmax(axis=0), -1).astype(np.int8)
        self.languages[0] = -1
        self.shift = np.zeros(len(names))

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """For each guessed language the threshold with the fewest errors (midway between two scores), shrunk to the common one where texts are few."""
        flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        z, lang = self.logits(flat, doc, len(rows)), self.language(flat, doc, len(rows))

        def best(z: np.ndarray, y: np.ndarray) -> float:
            order = np.argsort(z)
            z, y = z[order], y[order]
            errors = np.concatenate([[0], np.cumsum(y)]) + (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
            least = np.flatnonzero(errors == errors.min())
            k = int(least[len(least) // 2])
            low, high = z[k - 1] if k else z[0] - 1, z[k] if k < len(z) else z[-1] + 1
            return float((low + high) / 2)

        common = best(z, y)
        for k in range(len(self.shift)):
            mine = lang == k
            n = min(int(y[mine].sum()), int((1 - y[mine]).sum()))
            own = best(z[mine], y[mine]) if n >= 5 else common
            self.shift[k] = (n * own + 10 * common) / (n + 10)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 10_000, allowed=None, bits: int = BITS) -> Network:
    """A network fitted on at most ``most_rows`` labelled rows; executors send word buckets, not texts."""
    prepare(docs.sparkSession)
    docs = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    sample = labelled_sample(docs, labels, label, most_rows, allowed, F.max, ("lang",))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, at in tb.blocks(batch.column("text")):
                bucket, doc = word_buckets(data, at, bits)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                out += [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "version", "h", "y", "lang")), pa.array(out, pa.binary())], ["doc_id", "version", "h", "y", "lang", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = one_row_each(sample.withColumn("lang", F.col("lang").cast("string")).mapInArrow(features, f"doc_id {kind}, version long, h long, y int, lang string, x binary"), ("lang",))
    x = [np.frombuffer(r.x, np.uint32).astype(np.int64) for r in rows]
    return fit(x, np.array([int(r.y > 0) for r in rows]), [r.lang for r in rows], bits)


def fit(x: list[np.ndarray], y: np.ndarray, lang: list[str | None], bits: int = BITS) -> Network:
    """Train on four fifths, calibrate on the rest."""
    net = Network(bits)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        net.p["o"][:] = 0
        net.p["c"][:] = np.log(share / (1 - share))
        return net
    held = np.arange(len(x)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(x), bool)
        part = held
    else:
        part = ~held
    rows = [x[i] for i in np.flatnonzero(part)]
    net.start_from_counts(rows, y[part])
    net.train(rows, y[part])
    net.learn_languages(x, lang)
    net.calibrate([x[i] for i in np.flatnonzero(held)], y[held])
    return net


def score(docs: DataFrame, net: Network, column: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with ``column``; the tables of ``2**bits`` rows are broadcast."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(net)
    base = docs.select(*[c for c in docs.columns if c != column])
    schema = widened(base.schema, **{column: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sent.value.score(data, at) for _, _, data, at in tb.blocks(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made) if made else np.empty(0), pa.float64())], [*batch.schema.names, column])

    return base.mapInArrow(run, schema)
