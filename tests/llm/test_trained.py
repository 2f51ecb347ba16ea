"""Trained operators: held-out accuracy, exact counts, normalisation, odd rows."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, lm_scoring, quality_classifier, registry, toxicity
from tessera.llm.runtime import fold

from ..conftest import DATA
from . import brute

SMALL = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, " \n"), (-4, "12 !!"), (-5, "der die das " * 20_000), (-6, "ÄÖ"), (-6, "ÄÖ")]


def odd(spark):
    return spark.createDataFrame([(a, b, 3, "x", 9.0) for a, b in ODD], "doc_id long, text string, n_tokens int, lang_pred string, score double")


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def test_folds(spark):
    got = read(spark, DATA, "documents").select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


@pytest.mark.parametrize("name,label,least", [("op10_quality_classifier", "quality", 0.95), ("op4_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = registry.QUERIES[name](spark, SMALL)
    assert got.count() == read(spark, SMALL, "documents").count()
    held = got.join(read(spark, SMALL, "labels"), "doc_id").where("held_out").toPandas()
    assert (held.predicted == held[label]).mean() >= least and held.score.between(0, 1).all()


def test_language(spark):
    docs = read(spark, SMALL, "documents")
    net = language_id.train(docs, fold("doc_id", 4) != 2, steps=300)
    got = language_id.predict(docs.where(fold("doc_id", 4) == 2), net).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    quality = quality_classifier.train(docs, labels)
    toxic = toxicity.train(docs, labels, bits=14)
    for scored in (quality_classifier.score(odd(spark), quality), toxicity.score(odd(spark), toxic)):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == -6}) == 1
    assert quality_classifier.score(odd(spark).limit(0), quality).count() == 0 and toxicity.score(odd(spark).limit(0), toxic).count() == 0
    net = language_id.train(docs, steps=60)
    got = {r.doc_id: r for r in language_id.predict(odd(spark), net).collect()}
    assert [got[-k].lang_pred for k in (1, 2, 3, 4)] == ["und"] * 4 and got[-5].lang_pred != "und" and got[-6].lang_pred != "und"
    assert "n_tokens" in got[-5].asDict() and language_id.predict(odd(spark).limit(0), net).count() == 0


def test_scores_equal_plain_loops(spark):
    """The batched forward passes of the trained models against loops over words, filters and places."""
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    rows = [*[(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(12).collect()], *[(d, t) for d, t in ODD if d != -5], (-7, "a")]
    few = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"])
    text = dict(rows)
    model, net, spoken = quality_classifier.train(docs, labels), toxicity.train(docs, labels, bits=14), language_id.train(docs, steps=60)
    for r in quality_classifier.score(few, model).collect():
        assert r.score == pytest.approx(brute.quality_score(model, text[r.doc_id]), abs=1e-5)
    for r in toxicity.score(few, net).collect():
        assert r.score == pytest.approx(brute.toxic_score(net, text[r.doc_id]), abs=1e-4)
    for r in language_id.predict(few, spoken).collect():
        if r.lang_pred != "und":
            p = brute.language_scores(spoken, text[r.doc_id])
            assert r.lang_pred == spoken.names[int(np.argmax(p))] and r.score == pytest.approx(np.exp(max(p)), abs=1e-4)


def test_training_rows_are_bounded_for_any_ids(spark, monkeypatch):
    """String ids, copies of every row, repeated and contradicting labels: no more rows are learnt from than the limit says."""
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    copies = named.crossJoin(spark.range(4).withColumnRenamed("id", "copy"))
    tags = labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    tags = tags.unionByName(tags).unionByName(tags.limit(3).withColumn("quality", 1 - F.col("quality")))
    seen = {}
    for module, name in ((quality_classifier, "quality"), (toxicity, "toxic")):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda x, y, *rest, fit=fit, name=name: (seen.__setitem__(name, len(y)), fit(x, y, *rest))[1])
    quality = quality_classifier.train(copies, tags, most_rows=40)
    toxic = toxicity.train(copies, tags, most_rows=40, bits=12)
    assert 0 < seen["quality"] <= 40 and 0 < seen["toxic"] <= 40
    assert quality_classifier.score(named, quality).count() == toxicity.score(named, toxic).count() == docs.count()
    x, y, names = language_id.labelled_windows(copies, None, "lang", "text", 5, 12, 3, 2)
    assert len(names) == 2 and 0 < len(x) == len(y) <= 12 * 3
    one = docs.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language_id.predict(one.limit(5), language_id.train(one)).collect()} == {"xx"}


def test_nothing_to_learn_from(spark):
    docs, none = odd(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, none)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(docs, toxicity.train(docs, none, bits=10)).collect()}) == 1
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(bare)).collect()} == {"und"}
    model, counts = lm_scoring.fit(docs.limit(0))
    rows = lm_scoring.score(docs, model, counts).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in rows)


def test_lm_counts(spark):
    docs = read(spark, DATA, "documents").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    model, counts = lm_scoring.fit(docs.where(fold("doc_id", 5) != 1), words=50, head_words=200)
    got = lm_scoring.score(docs, model, counts).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    c, ends = collections.Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update(brute.words((t or "").translate(brute.LOWER)))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    expected = {}
    for d, t in rows:
        w = brute.words((t or "").translate(brute.LOWER))
        base = sum(np.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[x] for x in w), ends])
        expected[d] = (len(w) + 1, sum(x in c for x in w) + 1, n, base)
    assert len(got) == len(rows)
    for r in got:
        a, b, m, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, m) and r.base_score == pytest.approx(base, rel=1e-9)


def test_lm_is_normalised(spark):
    docs = read(spark, DATA, "documents").select("doc_id", "text")
    model, counts = lm_scoring.fit(docs, words=40)
    size = model.words + 1 + lm_scoring.FORMS
    before = np.random.default_rng(1).integers(0, size, (3, lm_scoring.CONTEXT))
    for ctx in before:
        lp = model.log_probability(np.arange(size), np.repeat(ctx[None, :], size, axis=0))
        assert np.exp(lp).sum() == pytest.approx(1, abs=1e-4)
    # The shares of the words of a form, with one unseen word, add up to one.
    rows = counts.collect()
    head = dict(zip(model.head.tolist(), model.head_symbol.tolist()))
    mass = np.full(lm_scoring.FORMS, 0.5)
    for r in rows:
        if head.get(r.h & (2**64 - 1), -1) < 0:
            mass[r.form] += r.c + 0.5
    assert np.allclose(mass, model.mass)


def test_lm_beats_the_base(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text")
    model, counts = lm_scoring.fit(docs.where(fold("doc_id", 5) != 1), words=200)
    got = lm_scoring.score(docs.where(fold("doc_id", 5) == 1), model, counts).toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_lm_learns_from_all_documents(spark, monkeypatch):
    """Pairs of symbols are those of every document, and each round moves the weights by positions of all of them."""
    docs = read(spark, DATA, "documents").select("doc_id", "text")
    seen, first = [], []
    start = lm_scoring.start
    monkeypatch.setattr(lm_scoring, "start", lambda model, count, pairs: (seen.append(pairs), start(model, count, pairs), first.append(dict(model.p))))
    model, _ = lm_scoring.fit(docs, words=50)
    assert seen[0].sum() == model.total
    assert all(np.isfinite(w).all() for w in model.p.values()) and not np.allclose(model.p["r"], first[0]["r"])
    # The mean over partitions is by positions: with a rate of nothing it gives back the same weights.
    count = np.ones(model.words + 1 + lm_scoring.FORMS)
    same = lm_scoring.averaged(docs.repartition(5), model, count, 1, 0.0, 0)
    assert all(np.allclose(same[k], model.p[k], atol=1e-6) for k in same)


def test_lm_trains_on_every_position_once(spark, monkeypatch):
    """The rounds together take each position of each text once, also where a worker trains on a few at a time."""
    docs = read(spark, DATA, "documents").select("doc_id", "text").coalesce(1)
    model, _ = lm_scoring.fit(docs, words=50, rounds=1)
    size = len(model.cluster)

    def count(m, full, spot, chosen, rate, rng):
        m.p["b"] += np.bincount(full[chosen], minlength=size).astype(np.float32)

    monkeypatch.setattr(lm_scoring, "descend", count)
    seen = lm_scoring.symbol_pairs(docs, spark.sparkContext.broadcast(model), size).sum(axis=0)
    for rounds, most in ((1, 1 << 22), (2, 1 << 22), (3, 100_000)):
        model.p["b"] = np.zeros(size, np.float32)
        for turn in range(rounds):
            model.p = lm_scoring.averaged(docs, model, seen, rounds, 0.0, turn, most=most)
        assert model.total == seen.sum() and (model.p["b"] == seen).all()


def test_lm_gradients_are_exact(spark):
    """One step moves each weight against the slope of the mean log-probability, found by small changes."""
    docs = read(spark, DATA, "documents").select("doc_id", "text")
    model, _ = lm_scoring.fit(docs, words=20, rounds=0)
    rng = np.random.default_rng(5)
    model.p = {k: (w + rng.normal(0, 0.1, w.shape)).astype(np.float64) for k, w in model.p.items()}
    n = [30, 1, 50]
    doc = np.repeat(np.arange(3), n)
    full, _, before = model.rows(rng.integers(0, 20, sum(n)), doc, 3)
    spot = model.texts(np.zeros(sum(n), np.int64), doc, 3)[2]
    loss = lambda: -model.log_probability(full, before).mean()
    slopes = {}
    for k, w in model.p.items():
        for at in [tuple(rng.integers(0, x) for x in w.shape) for _ in range(12)]:
            was = w[at]
            w[at] = was + 1e-4
            up = loss()
            w[at] = was - 1e-4
            slopes[k, at] = (up - loss()) / 2e-4
            w[at] = was
    old = {k: w.copy() for k, w in model.p.items()}
    lm_scoring.descend(model, full.astype(np.uint16), np.minimum(spot, 4).astype(np.uint8), np.arange(len(full)), 1e-3, rng, batch=1000, least=1000)
    # A first step of Adam goes by the rate against the sign of the slope.
    for (k, at), slope in slopes.items():
        if abs(slope) > 1e-4:
            assert np.sign(old[k][at] - model.p[k][at]) == np.sign(slope), (k, at)
    assert sum(abs(x) > 1e-4 for x in slopes.values()) > 15


def test_lm_score_equals_plain_loops(spark):
    docs = read(spark, DATA, "documents").select("doc_id", "text")
    model, counts = lm_scoring.fit(docs.where(fold("doc_id", 5) != 1), words=50, head_words=200)
    table = {r.h & (2**64 - 1): r.c for r in counts.collect()}
    few = docs.orderBy("doc_id").limit(15).unionByName(odd(spark).select("doc_id", "text").where("doc_id != -5"))
    text = {r.doc_id: r.text for r in few.collect()}
    for r in lm_scoring.score(few, model, counts).collect():
        assert r.score == pytest.approx(brute.model_score(model, table, text[r.doc_id]), rel=1e-4)


def test_hinge_model_separates():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for i in range(200):
        y.append(i % 2)
        rows.append(np.unique(np.concatenate([rng.integers(0, 50, 8), [60 + i % 2]])).astype(np.uint32))
    model = quality_classifier.fit(rows, np.array(y), bits=7)
    assert model.weight[61] > 0 > model.weight[60]
