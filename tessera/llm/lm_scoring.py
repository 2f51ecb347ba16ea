"""Language-model scoring by a log-bilinear neural model.

Counts of all training words are gathered from the whole corpus.  The model's
symbols are the most frequent words, the end of a text, and form classes that
stand for all other words: such a word has the probability of its class times
its share of the class by count, so unseen words are scored too.

A position is predicted from the weighted sum of the vectors of the symbols
before it (log-bilinear).  Symbols are grouped by their neighbours into
clusters; the probability is that of the cluster times that of the symbol in
its cluster.  The counts of words and of pairs of neighbouring symbols cover
all training documents; they make the clusters, and the factors of their
log-ratios are the first vectors.  Then both parts are trained in numpy by
their exact gradients, on every position of every document, once, in ``rounds``
rounds: in each, every document gives the next share of its positions, every
partition of the documents trains on those it holds from the same weights, and
the weights are averaged by numbers of positions.  No text moves; the number of
symbols (``words``) is the size of the model.
Scoring is normalised exactly, by batched matrix products over cluster and
symbol tables.

Words outside the ``head_words`` most frequent ones, whose counts are sent to
every worker, are looked up by a shuffled join with the counts, so nothing that
grows with the vocabulary is broadcast.

Edge cases: a null or empty text has one token, the end; without training
documents N and V are 0 and every token has the base probability of an
unseen one; null ids are kept; repeated rows are counted and scored one by one;
ties of counts are broken by hash; very long texts are learnt from and scored
whole; an empty table gives an empty table; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .nets import Adam
from .runtime import materialise, prepare

FORMS, CONTEXT, DIM = 96, 4, 24
LN10 = float(np.log(10))
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:48] = PUNCTUATION[58:65] = PUNCTUATION[91:97] = PUNCTUATION[123:127] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, form class, text) of every word of a block."""
    s, e, doc = tb.words(data, at)
    if not len(s):
        return np.empty(0, tb.U), np.empty(0, np.int64), np.empty(0, np.int64)
    low = tb.LOWER[data]
    end = PUNCTUATION[low[e - 1]].astype(np.int64)
    last = np.maximum(e - 1 - end, s)
    form = low[last].astype(tb.U) | (low[np.maximum(last - 1, s)].astype(tb.U) << tb.U(8)) | (end.astype(tb.U) << tb.U(16))
    return tb.hashes(data, s, e, tb.LOWER), (tb.mix(form) % tb.U(FORMS)).astype(np.int64), doc


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, form, c): how often each word stands in the texts; summed by batch before the shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, form = [np.empty(0, tb.U)], [np.empty(0, np.int64)]
            for _, _, data, at in tb.blocks(batch.column(text)):
                a, b, _ = tokens(data, at)
                h.append(a)
                form.append(b)
            keys, first, count = np.unique(np.concatenate(h), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.concatenate(form)[first].astype(np.int32)), pa.array(count)], ["h", "form", "c"])

    return docs.select(text).mapInArrow(run, "h long, form int, c long").groupBy("h").agg(F.first("form").alias("form"), F.sum("c").alias("c"))


@dataclass
class Model:
    """Everything a worker needs; its size depends on the parameters only."""

    head: np.ndarray  # sorted hashes
    head_count: np.ndarray
    head_symbol: np.ndarray  # symbol of a head word, -1 if it is scored by its form
    words: int  # symbols that are words; then the end, then the forms
    mass: np.ndarray  # of each form
    total: int
    distinct: int
    end_count: int
    cluster: np.ndarray
    place: np.ndarray
    members: list[np.ndarray]
    p: dict[str, np.ndarray]

    @property
    def base_scale(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def symbols(self, h: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count; -1 for words outside the head)."""
        keys, inverse = np.unique(h, return_inverse=True)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, keys), len(self.head) - 1)
            hit = self.head[at] == keys
            symbol, count = np.where(hit, self.head_symbol[at], -1), np.where(hit, self.head_count[at], -1)
        else:
            symbol = count = np.full(len(keys), -1, np.int64)
        symbol, count = symbol[inverse], count[inverse]
        return np.where(symbol >= 0, symbol, self.words + 1 + form), count

    def texts(self, symbol: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols with the end of each text, their text, their place in it)."""
        count = np.bincount(doc, minlength=n)
        at = np.concatenate([[0], np.cumsum(count + 1)])
        full = np.full(at[-1], self.words, np.int64)
        full[np.arange(len(symbol)) + doc] = symbol
        own = np.repeat(np.arange(n), count + 1)
        return full, own, np.arange(len(full)) - at[:-1][own]

    def rows(self, symbol: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols with the end of each text, their text, symbols before them)."""
        full, own, spot = self.texts(symbol, doc, n)
        before = np.full((len(full), CONTEXT), self.words, np.int64)
        for k in range(CONTEXT):
            ok = np.flatnonzero(spot > k)
            before[ok, k] = full[ok - k - 1]
        return full, own, before

    def query(self, before: np.ndarray) -> np.ndarray:
        q = (self.p["r"] * self.p["a"][0]).take(before[:, 0], axis=0)
        for k in range(1, CONTEXT):
            q += (self.p["r"] * self.p["a"][k]).take(before[:, k], axis=0)
        return q

    def log_probability(self, full: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol, normalised over all."""
        out = np.empty(len(full), np.float64)
        for a in range(0, len(full), 16384):
            # By cluster, and positions in columns, where sums over symbols are fast.
            c = self.cluster[full[a : a + 16384]].astype(np.uint16)
            order = np.argsort(c, kind="stable")
            target, c = full[a : a + 16384][order], c[order].astype(np.int64)
            q = np.ascontiguousarray(self.query(before[a : a + 16384].take(order, axis=0)).T)
            got = _log_share(self.p["s"] @ q + self.p["t"][:, None], c)
            cut = np.searchsorted(c, np.arange(len(self.members) + 1)).tolist()
            for k, m in enumerate(self.members):
                i, j = cut[k], cut[k + 1]
                if i < j and len(m) > 1:
                    got[i:j] += _log_share(self.p["o"][m] @ q[:, i:j] + self.p["b"][m][:, None], self.place[target[i:j]])
            out[a : a + 16384][order] = got
        return out


def _log_share(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The log-softmax of each column at its ``row``."""
    x -= x.max(axis=0)
    own = x[row, np.arange(len(row))].astype(np.float64)
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def clusters(pairs: np.ndarray, count: int, most: int = 64, seed: int = 31) -> np.ndarray:
    """Cluster of each symbol, by spectral coordinates of its neighbours, cut to at most ``most`` members."""
    weight = np.sqrt(pairs + pairs.T)
    norm = np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh((weight / norm) @ (weight / norm).T)
    x = vectors[:, -8:] * np.sqrt(np.maximum(values[-8:], 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(15):
        near = np.argmax(x @ c.T, axis=1)
        for k in range(len(c)):
            if (near == k).any():
                c[k] = x[near == k].mean(axis=0)
    out, used = np.empty(len(x), np.int64), 0
    for k in range(len(c)):
        mine = np.flatnonzero(near == k)
        for part in np.array_split(mine, -(-len(mine) // most)) if len(mine) else []:
            out[part] = used
            used += 1
    return out


def start(model: Model, symbol_count: np.ndarray, pairs: np.ndarray, seed: int = 32) -> None:
    """Clusters and first weights of both levels from the corpus counts alone."""
    size, rng = len(symbol_count), np.random.default_rng(seed)
    model.cluster = clusters(pairs, max(2, int(np.sqrt(size))))
    k = int(model.cluster.max()) + 1
    model.members = [np.flatnonzero(model.cluster == c) for c in range(k)]
    model.place = np.empty(size, np.int64)
    for m in model.members:
        model.place[m] = np.arange(len(m))
    mass = np.bincount(model.cluster, weights=symbol_count, minlength=k)
    # How much more often than by chance a symbol follows another, shrunk where little is expected: factors are vectors.
    before, after = pairs.sum(axis=1), pairs.sum(axis=0)
    chance = np.outer(before, after) / max(pairs.sum(), 1)
    u, scale, v = np.linalg.svd(np.log((pairs + 5) / (chance + 5)))
    d = min(DIM, size)
    root = np.sqrt(scale[:d])
    noise = lambda n: rng.normal(0, 0.01, (n, DIM))
    r, o = noise(size), noise(size)
    r[:, :d] += u[:, :d] * root
    o[:, :d] += v[:d].T * root
    s = np.stack([np.average(o[m], axis=0, weights=symbol_count[m]) for m in model.members])
    model.p = {
        "r": r.astype(np.float32),
        "a": np.stack([np.full(DIM, 1 / (1 + i) ** 2) for i in range(CONTEXT)]).astype(np.float32),
        "s": s.astype(np.float32),
        "t": np.log(mass / mass.sum()).astype(np.float32),
        "o": o.astype(np.float32),
        "b": np.log(symbol_count / mass[model.cluster]).astype(np.float32),
    }


def _sums(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.zeros((size, values.shape[1]), np.float32)
    out[k[first]] = np.add.reduceat(values.take(order, axis=0), first, axis=0)
    return out


def descend(model: Model, full: np.ndarray, spot: np.ndarray, chosen: np.ndarray, rate: float, rng: np.random.Generator, batch: int = 4096, least: int = 256) -> None:
    """Training from the model's weights, once over the positions ``chosen`` of whole texts in a row (symbols, places in their text), by the exact gradients of both levels.

    Few positions go in batches of ``least``, so that there are steps enough.
    """
    size, k = len(model.cluster), len(model.members)
    # Members of a cluster stand together while the weights are trained.
    by_cluster = np.concatenate(model.members)
    p = model.p | {"o": model.p["o"][by_cluster], "b": model.p["b"][by_cluster]}
    edge = np.concatenate([[0], np.cumsum([len(m) for m in model.members])]).tolist()
    cluster = model.cluster.astype(np.min_scalar_type(k))
    adam = Adam(rate)
    n = max(1, len(chosen) // min(batch, max(least, len(chosen) // 200)))
    for step, take in enumerate(np.array_split(rng.permutation(chosen), n)):
        adam.rate = rate * max(0.05, 1 - step / n)
        c = cluster[full[take]]
        order = np.argsort(c, kind="stable")
        take, c = take[order], c[order].astype(np.int64)
        place, deep = model.place[full[take]], spot[take]
        context = [np.where(deep > i, full[np.maximum(take - i - 1, 0)], full.dtype.type(model.words)) for i in range(CONTEXT)]
        q = (p["r"] * p["a"][0]).take(context[0], axis=0)
        for i in range(1, CONTEXT):
            q += (p["r"] * p["a"][i]).take(context[i], axis=0)
        # Positions stand in columns, where sums over symbols are fast.
        m, at, q_t = len(take), np.arange(len(take)), np.ascontiguousarray(q.T)
        d = _softmax(p["s"] @ q_t + p["t"][:, None])
        d[c, at] -= 1
        back = d.T @ p["s"]
        grads = {"s": d @ q, "t": d.sum(axis=1), "o": np.zeros_like(p["o"]), "b": np.zeros_like(p["b"])}
        cut = np.searchsorted(c, np.arange(k + 1)).tolist()
        for x in range(k):
            a, b, i, j = cut[x], cut[x + 1], edge[x], edge[x + 1]
            if a < b and j - i > 1:
                o = p["o"][i:j]
                e = _softmax(o @ q_t[:, a:b] + p["b"][i:j, None])
                e[place[a:b], at[: b - a]] -= 1
                back[a:b] += e.T @ o
                grads["o"][i:j] = e @ q[a:b]
                grads["b"][i:j] = e.sum(axis=1)
        by_place = [_sums(x, back, size) for x in context]
        grads["r"] = sum(g * w for g, w in zip(by_place, p["a"]))
        grads["a"] = np.stack([(g * p["r"]).sum(axis=0) for g in by_place])
        adam.step(p, {name: (g / m + 1e-6 * p[name]).astype(np.float32) for name, g in grads.items()})
    for name in ("o", "b"):
        model.p[name][by_cluster] = p[name]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x *= 1 / x.sum(axis=0)
    return x


def symbol_pairs(docs: DataFrame, sent, size: int, text: str = "text") -> np.ndarray:
    """How often each symbol stands after each other one in all of ``docs``; summed by partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for i, j, data, at in tb.blocks(batch.column(text)):
                h, form, doc = tokens(data, at)
                full, _, spot = sent.value.texts(sent.value.symbols(h, form)[0], doc, j - i)
                before = np.where(spot > 0, np.roll(full, 1), sent.value.words)
                total += np.bincount(before * size + full, minlength=size * size)
        found = np.flatnonzero(total)
        for part in np.array_split(found, len(found) // 50_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "c"])

    # At most size * size rows, whatever the corpus.
    rows = docs.select(text).mapInArrow(run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("c").to_numpy()
    return out.reshape(size, size)


def averaged(docs: DataFrame, model: Model, symbol_count: np.ndarray, share: int, rate: float, turn: int, text: str = "text", most: int = 1 << 22) -> dict[str, np.ndarray]:
    """The weights after one round: each partition trains on every ``share``-th position of the texts it holds; the mean by positions.

    ``share`` turns in a row take every position once.  A worker holds about ``most`` positions at a time.
    """
    names = list(model.p)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    small = np.min_scalar_type(len(symbol_count))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = replace(sent.value, p={k: v.copy() for k, v in sent.value.p.items()})
        rng = np.random.default_rng((turn, TaskContext.get().partitionId()))
        full, spot, held, n = [], [], 0, 0

        def train() -> int:
            chosen = np.arange(turn % share, held, share)
            if len(chosen):
                descend(m, np.concatenate(full), np.concatenate(spot), chosen, rate, rng)
            full.clear()
            spot.clear()
            return len(chosen)

        for batch in batches:
            for i, j, data, at in tb.blocks(batch.column(text)):
                h, form, doc = tokens(data, at)
                symbol, _, place = m.texts(m.symbols(h, form)[0], doc, j - i)
                full.append(symbol.astype(small))
                spot.append(np.minimum(place, CONTEXT).astype(np.uint8))
                held += len(symbol)
                if held >= most:
                    n += train()
                    held = 0
        n += train()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([m.p[k].ravel() for k in names]).astype(np.float64).tobytes()]), pa.array([n])], ["w", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            for w, k in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist()):
                total, n = total + np.frombuffer(w) * k, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).tobytes()]), pa.array([n])], ["w", "n"])

    found = docs.select(text).mapInArrow(work, "w binary, n long").repartition(8).mapInArrow(add, "w binary, n long").collect()
    if not found:
        return model.p
    flat = sum(np.frombuffer(bytes(r.w)) * r.n for r in found) / sum(r.n for r in found)
    cut = np.cumsum([model.p[k].size for k in names])[:-1]
    return {k: x.reshape(model.p[k].shape).astype(np.float32) for k, x in zip(names, np.split(flat, cut))}


def fit(docs: DataFrame, text: str = "text", words: int = 927, head_words: int = 100_000, rounds: int = 2) -> tuple[Model, DataFrame]:
    """The model of the training documents ``docs``, and the table of all word counts; every position is learnt from in one of the ``rounds``."""
    spark = docs.sparkSession
    prepare(spark)
    counts = materialise(word_counts(docs, text))
    ends = docs.count()
    by_form = counts.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total = sum(r.c for r in by_form) + ends
    distinct = sum(r.v for r in by_form) + (ends > 0)
    top = counts.orderBy(F.desc("c"), "h").limit(head_words).toArrow()
    h, c = top.column("h").to_numpy().view(tb.U), top.column("c").to_numpy()
    form = top.column("form").to_numpy()
    own = min(words, len(h))
    symbol = np.where(np.arange(len(h)) < own, np.arange(len(h)), -1)
    mass = np.full(FORMS, 0.5)
    for r in by_form:
        mass[r.form] += r.c + 0.5 * r.v
    np.subtract.at(mass, form[:own], c[:own] + 0.5)
    order = np.argsort(h)
    model = Model(h[order], c[order], symbol[order], own, mass, total, distinct, ends, np.empty(0), np.empty(0), [], {})
    symbol_count = np.concatenate([c[:own] + 0.5, [ends + 0.5], mass])
    start(model, symbol_count, symbol_pairs(docs, spark.sparkContext.broadcast(model), len(symbol_count), text))
    for turn in range(rounds):
        model.p = averaged(docs, model, symbol_count, rounds, 0.02 / (1 + turn), turn, text)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        uid = TaskContext.get().partitionId() << 36
        scale = np.log10(m.base_scale)
        for batch in batches:
            for i, j, data, at in tb.blocks(batch.column(text)):
                n = j - i
                h, form, doc = tokens(data, at)
                symbol, count = m.symbols(h, form)
                full, own, before = m.rows(symbol, doc, n)
                lp = np.bincount(own, weights=m.log_probability(full, before), minlength=n) / LN10
                known = count >= 0
                value = np.log10(count[known] + 0.5)
                base = np.bincount(doc[known], weights=value - scale, minlength=n) + np.log10(m.end_count + 0.5) - scale
                shared = known & (symbol > m.words)
                lp += np.bincount(doc[shared], weights=np.log10(count[shared] + 0.5) - np.log10(m.mass[symbol[shared] - m.words - 1]), minlength=n)
                n_known = np.bincount(doc[known], minlength=n) + (m.end_count > 0)
                # Words outside the head, once for each text, for the join with the counts.
                rest = np.flatnonzero(~known)
                order = np.lexsort((h[rest], doc[rest]))
                rest = rest[order]
                new = np.concatenate([[True], (h[rest][1:] != h[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])]) if len(rest) else np.empty(0, bool)
                first = rest[new]
                times = np.diff(np.append(np.flatnonzero(new), len(rest)))
                lp -= np.bincount(doc[rest], weights=np.log10(m.mass[symbol[rest] - m.words - 1]), minlength=n)
                base -= np.bincount(doc[rest], minlength=n) * scale
                ids = uid + np.arange(n)
                uid += n
                k = len(first)
                nothing = pa.nulls(k, batch.column("doc_id").type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids, ids[doc[first]]])),
                        pa.concat_arrays([batch.column("doc_id").slice(i, n), nothing]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), h[first].view(np.int64)])),
                        pa.array(np.concatenate([np.bincount(doc, minlength=n) + 1, times])),
                        pa.array(np.concatenate([n_known, np.zeros(k, np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(k)])),
                        pa.array(np.concatenate([lp, np.zeros(k)])),
                        pa.array(np.concatenate([np.ones(n, bool), np.zeros(k, bool)])),
                    ],
                    ["uid", "doc_id", "h", "n", "known", "base", "lp", "whole"],
                )

    first = materialise(docs.select("doc_id", text).mapInArrow(run, f"uid long, doc_id {kind}, h long, n long, known long, base double, lp double, whole boolean"))
    tail = first.where(~F.col("whole")).select("uid", "h", "n").join(counts.select("h", "c"), "h", "left")
    value = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    tail = tail.groupBy("uid").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"))
    out = first.where("whole").select("uid", "doc_id", "n", "known", "base", "lp").join(tail, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("lp") + more).alias("score"))
