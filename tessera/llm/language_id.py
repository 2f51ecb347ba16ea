"""Language identification by a byte convolutional network.

A text is read whole as windows of ``WINDOW`` bytes (letters lower-cased,
blanks and digits each made alike).  Byte embeddings, filters of several widths, max
pooling over the window and a softmax give language log-probabilities, which
are averaged over the windows of a text.  The network is trained in numpy by
Adam on a bounded sample of labelled texts, drawn for each language at a rate
that its count sets, so that rare languages are seen.

For scoring, the embedding and filter products are tabulated for byte pairs;
a position is then the sum of two table rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language or an id are not learnt from, and rows with equal id and
language only once; ids may be of any type; without any labelled row every text
is ``und``; with one language every other text is that; repeated rows are
predicted one by one; very long texts are read whole; an empty table gives an
empty table; columns named like the results are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .nets import Adam, log_softmax
from .runtime import prepare, widened

WINDOW = 128
WIDTHS = (2,) * 6 + (3,) * 12 + (4,) * 14
REACH, DIM = 4, 8
UNKNOWN = "und"

_BYTES = tb.LOWER.copy()
_BYTES[48:58] = 48
_BYTES[tb.SPACE] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
_ASCII_LETTER[65:91] = True


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by window, padded with zeros; text of each window): all bytes of every text."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    first = np.repeat(at[:-1], count) + WINDOW * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    spots = first[:, None] + np.arange(WINDOW)
    inside = spots < at[1:][doc][:, None]
    return np.where(inside, _BYTES[data[np.minimum(spots, max(len(data) - 1, 0))]] if len(data) else np.uint8(0), np.uint8(0)), doc


class Network:
    """Parameters and scoring; ``names`` are the learnt languages."""

    def __init__(self, names: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.names = names
        self.mask = (np.arange(REACH)[:, None] < np.array(WIDTHS)[None, :]).astype(np.float32)
        self.p = {
            "e": rng.normal(0, 0.3, (256, DIM)).astype(np.float32),
            "w": (rng.normal(0, 0.3, (REACH, DIM, len(WIDTHS))) * self.mask[:, None, :]).astype(np.float32),
            "b": np.zeros(len(WIDTHS), np.float32),
            "o": rng.normal(0, 0.2, (len(WIDTHS), len(names))).astype(np.float32),
            "c": np.zeros(len(names), np.float32),
        }

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums for byte pairs at places 0-1 and 2-3."""
        t = np.einsum("bd,jdf->jbf", self.p["e"], self.p["w"])
        return tuple((t[j][:, None] + t[j + 1][None, :]).reshape(65536, -1).astype(np.float32) for j in (0, 2))

    def pooled(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Largest filter value in each window, after bias and ramp."""
        out, (first, second) = np.empty((len(x), len(WIDTHS)), np.float32), tables
        for a in range(0, len(x), 64):
            part = np.zeros((len(x[a : a + 64]), WINDOW + REACH), np.int32)
            part[:, :WINDOW] = x[a : a + 64]
            pair = part[:, :-1] * 256 + part[:, 1:]
            value = first[pair[:, :WINDOW]]
            value += second[pair[:, 2 : WINDOW + 2]]
            value.max(axis=1, out=out[a : a + 64])
        return np.maximum(out + self.p["b"], 0)

    def log_probabilities(self, data: np.ndarray, at: np.ndarray, tables) -> np.ndarray:
        """Mean log-probabilities over the windows of each text."""
        n = len(at) - 1
        x, doc = windows(data, at)
        lp = log_softmax(self.pooled(x, tables) @ self.p["o"] + self.p["c"])
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        return np.stack([np.bincount(doc, weights=lp[:, k], minlength=n) / count for k in range(len(self.names))], axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 192, seed: int = 12) -> None:
        rng, adam, p = np.random.default_rng(seed), Adam(0.006), self.p
        f = len(WIDTHS)
        by_class = [np.flatnonzero(y == k) for k in range(len(self.names))]
        for step in range(steps):
            adam.rate = 0.006 * (1 - step / steps) + 0.0003
            # Every language as often as another.
            take = np.array([by_class[k][rng.integers(len(by_class[k]))] for k in rng.integers(len(by_class), size=batch)])
            z = np.zeros((batch, WINDOW + REACH), np.int64)
            z[:, :WINDOW] = x[take]
            e = p["e"][z]
            cols = np.concatenate([e[:, j : j + WINDOW] for j in range(REACH)], axis=2)
            conv = cols.reshape(-1, REACH * DIM) @ p["w"].reshape(REACH * DIM, f)
            conv = conv.reshape(batch, WINDOW, f)
            spot = conv.argmax(axis=1)
            top = np.take_along_axis(conv, spot[:, None], 1)[:, 0] + p["b"]
            hidden = np.maximum(top, 0)
            lp = log_softmax(hidden @ p["o"] + p["c"])
            d = np.exp(lp)
            d[np.arange(batch), y[take]] -= 1
            d /= batch
            g = (d @ p["o"].T) * (top > 0)
            ids = z[np.arange(batch)[:, None, None], spot[:, :, None] + np.arange(REACH)]
            grad_w = np.einsum("bf,bfjd->jdf", g, p["e"][ids]) * self.mask[:, None, :]
            back = np.einsum("bf,jdf->bfjd", g, p["w"])
            grad_e = np.stack([np.bincount(ids.ravel(), weights=back[..., k].ravel(), minlength=256) for k in range(DIM)], axis=1)
            adam.step(p, {"o": hidden.T @ d, "c": d.sum(0), "b": g.sum(0), "w": grad_w, "e": grad_e})


def labelled_windows(docs: DataFrame, allowed, label: str, text: str, each: int, most: int, windows_each: int, most_languages: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of at most ``most`` texts, about ``each`` a language, with the language number; see ``train``."""
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0) & F.col("doc_id").isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    counts = known.groupBy(F.col(label).alias("_l")).count().orderBy(F.desc("count"), "_l").limit(most_languages).collect()
    if not counts:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64), []
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["_l"], min(1.0, each / r["count"])) for r in counts], "_l string, _rate double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 20)) / (1 << 20)).alias("_u")
    chosen = known.select("doc_id", F.col(label).alias("_l"), uniform).join(F.broadcast(rates), "_l").where("_u < _rate").select(F.col("doc_id").alias("_d"), "_l").distinct().orderBy(F.xxhash64("_d"), "_d", "_l").limit(most)
    rows = docs.select("doc_id", F.col(text).alias("_t"), F.col(label).alias("_k"), F.xxhash64(text).alias("version"), F.xxhash64("doc_id", F.lit(42)).alias("h"))
    sample = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_d")) & (F.col("_k") == F.col("_l"))).select("doc_id", "version", "h", "_l", "_t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, data, at in tb.blocks(batch.column("_t")):
                x, doc = windows(data, at)
                ends = np.searchsorted(doc, np.arange(j - i + 1))
                for a, b in zip(ends[:-1], ends[1:]):
                    found.append(x[np.unique(np.linspace(a, b - 1, min(b - a, windows_each)).astype(int))].tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "version", "h", "_l")), pa.array(found, pa.binary())], ["doc_id", "version", "h", "l", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = sample.mapInArrow(cut, f"doc_id {kind}, version long, h long, l string, x binary").groupBy("h", "doc_id", "l").agg(F.min(F.struct("version", "x")).alias("r")).select("h", "l", "r.*").collect()
    made = sorted((r for r in made if len(r.x)), key=lambda r: (r.h, r.l, r.version, bytes(r.x)))
    names = sorted({r.l for r in made})
    number = {k: i for i, k in enumerate(names)}
    parts = [np.frombuffer(r.x, np.uint8).reshape(-1, WINDOW) for r in made]
    y = np.repeat([number[r.l] for r in made], [len(p) for p in parts]) if parts else np.empty(0, np.int64)
    return np.concatenate(parts) if parts else np.empty((0, WINDOW), np.uint8), y.astype(np.int64), names


def train(docs: DataFrame, allowed=None, label: str = "lang", text: str = "text", each: int = 800, most: int = 6000, windows_each: int = 24, most_languages: int = 256, steps: int = 1500) -> Network:
    """A network fitted in ``steps`` batches on a bounded sample of labelled texts.

    The bounds: about ``each`` texts a language and at most ``most`` in all, of
    each ``windows_each`` windows, spread evenly from its first to its last
    (all where it has no more), and the ``most_languages`` most frequent languages.
    """
    prepare(docs.sparkSession)
    x, y, names = labelled_windows(docs, allowed, label, text, each, most, windows_each, most_languages)
    net = Network(names or [UNKNOWN])
    if len(names) > 1:
        net.train(x, y, steps)
    return net


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found & (at[1:] > at[:-1])).tolist():
        found[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language; the network is of fixed size."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(net)
    base = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = widened(base.schema, lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables, names = net.tables(), np.array([*net.names, UNKNOWN], object)
        for batch in batches:
            names_of, scores = [], []
            for _, _, data, at in tb.blocks(batch.column(text)):
                p = np.exp(log_softmax(net.log_probabilities(data, at, tables)))
                known = has_letter(data, at) & (net.names != [UNKNOWN])
                best = p.argmax(axis=1)
                names_of += names[np.where(known, best, len(net.names))].tolist()
                scores.append(np.where(known, p[np.arange(len(p)), best], 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names_of, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)
