"""The pipeline stage by stage against what each operator says by brute force."""

import re
import tracemalloc
from pathlib import Path

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join, runtime
from tessera.llm.runtime import materialise

from ..conftest import DATA
from . import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    results = []
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, DATA))
        results.append(docs)
    classified, ruled, cut, single, packed = results
    for r in results[:-1]:
        assert r.columns == columns and [f.dataType for f in r.schema] == [f.dataType for f in before.schema]
    assert before.count() >= classified.count() >= ruled.count() >= cut.count() >= single.count() > 0
    for r in ruled.select("text").collect():
        n, _, _, _, again = brute.base_counts(r.text)
        assert n >= 50 and 100 * again <= 50 * n
    rows = [(r.doc_id, r.v, r.text) for r in ruled.select("doc_id", "text", F.xxhash64("text").alias("v")).collect()]
    expected = {d: t for d, t, _, gone in brute.line_dedup(rows, 8, 1000) if not gone or len(brute.words(t)) >= 8}
    assert {r.doc_id: r.text for r in cut.collect()} == expected and all(r.n_chars == len(r.text) for r in cut.collect())
    # Near copies are told by the texts before the cut.
    text = {r.doc_id: r.text for r in before.collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for *_, c in brute.similar([(d, text[d]) for d in expected])})
    tokens = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(tokens) == single.count() and all(r.n == r.t for r in tokens)


def test_run(spark):
    assert P.run(spark, DATA).count() > 0 and P.ORACLE_SQL is None
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "line dedup", "n-gram Jaccard join", "packing"]


GOOD = [" ".join(f"{a}{i}" for i in range(60)) for a in ("alpha", "beta", "gamma")]
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (None, GOOD[0]), (None, GOOD[0]), (None, None), (4, GOOD[1]), (4, GOOD[1]), (4, GOOD[2]), (5, GOOD[1]), (6, f"{GOOD[1]}\nand a few"),
    (7, " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000))), (8, GOOD[2] + " end"),
]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_odd_rows(spark, tmp_path, kind):
    """Nulls, blanks, long and repeated rows, ids of two texts, and columns named as the operators' own."""
    made = spark.createDataFrame([(d, t, "en", 0.5, "k", 7, -1) for d, t in ODD], "doc_id long, text string, lang string, score double, kept string, n_words int, n_chars int")
    docs = made.select(F.col("doc_id").cast(kind), "text", "lang", "score", "kept", "n_words", F.lit(3).alias("n_deleted"), F.lit("r").alias("row"), "n_chars", F.lit(1).alias("component_id"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], f"doc_id {kind}, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = P.classify(spark, docs, d)
    assert kept.schema == docs.schema and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    ruled = P.filter_rules(spark, docs, d)
    assert ruled.schema == docs.schema and {r.kept for r in ruled.collect()} == {"k"}
    assert sorted(str(r.doc_id) for r in ruled.collect()) == sorted(["None", "None", "4", "4", "4", "5", "6", "7", "8"])
    cut = materialise(P.dedup_lines(spark, docs, d))
    assert cut.schema == docs.schema and {(r.score, r.n_words, r.n_deleted, r.row) for r in cut.collect()} == {(0.5, 7, 3, "r")}
    # 5 is a copy of 4; of 6 only three words are left; the rows of 4 stay, and so do those without an id.
    assert sorted(str(r.doc_id) for r in cut.collect()) == sorted(["1", "2", "3", "None", "None", "None", "4", "4", "4", "7", "8"])
    single = P.dedup_near(spark, docs, d)
    assert single.columns == docs.columns
    named = sorted(str(r.doc_id) for r in single.collect())
    assert named.count("4") == 2 and not {"5", "6", "8"} & set(named) and {"1", "2", "3", "7"} <= set(named)
    packed = P.pack(spark, docs, d)
    assert packed.where("start = 0").count() == len(ODD)
    for _, stage in P.STAGES:
        none = stage(spark, docs.limit(0), d)
        assert none.count() == 0 and (stage is P.pack or none.columns == docs.columns)


def test_one_of_each_keeps_unlinked_rows_of_an_id(spark):
    docs = spark.createDataFrame([(1, "one text of its own here"), (1, "quite another one than that"), (2, "one text of its own here")], "doc_id long, text string")
    left = ngram_join.one_of_each(docs, ngram_join.similar(docs)).collect()
    assert sorted(r.text for r in left) == ["one text of its own here", "quite another one than that"]


def test_near_copies_by_texts_before_and_after_the_cut(spark, tmp_path):
    """1 and 2 are alike once their first lines are cut, 3 and 4 only before; 5, which links to 4 now, joins their group."""
    word = lambda a, k: " ".join(f"{a}{i}" for i in range(k))
    before = [(1, word("x", 60) + "\n" + word("p", 30)), (2, word("y", 60) + "\n" + word("p", 30) + " end"), (3, word("z", 60) + "\n" + word("q", 10)), (4, word("z", 60) + "\n" + word("r", 10)), (5, word("v", 60) + "\n" + word("r", 10)), (6, word("u", 30))]
    after = [(d, t if d in (3, 6) else t.split("\n")[1]) for d, t in before]
    spark.createDataFrame(before, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    single = P.dedup_near(spark, spark.createDataFrame(after, "doc_id long, text string"), str(tmp_path))
    assert {r.doc_id: r.text for r in single.collect()} == {d: t for d, t in after if d in (1, 3, 6)}


def test_workers_hold_little(spark, monkeypatch):
    """The n-gram passes over 8 MB of text stay below a bound, and a worker that waits for its next task has given the memory back."""
    taken = {}
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.setdefault(len(taken), run) and self)
    ngram_join._first_pass(docs, "text", 3)
    ngram_join._blocks_of(docs, "text", 3, 4, np.empty(0, np.uint64))
    names, rng = np.array([f"word{i}" for i in range(20_000)]), np.random.default_rng(3)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "version": list(range(2500)), "text": [" ".join(names[rng.integers(0, 20_000, 330)]) for _ in range(2500)]})
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    monkeypatch.setattr(ngram_join, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)}))
    for run in taken.values():
        runtime.give_back()
        before = held()
        assert sum(b.num_rows for b in run(iter([batch]))) > 0
        assert held() - before < 15
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < 34
