import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import evaluation, hierarchy, ingestion, ivfpq, metadata_index, splitters, text_metadata


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_metrics(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<float>, b array<float>")
    r = d.select(V.euclidean("a", "b").alias("e"), V.cosine("a", "b").alias("c"), V.dot_distance("a", "b").alias("d"), V.manhattan("a", "b").alias("m")).first()
    assert r.e > 0 and 0 <= r.c <= 2 and r.d == -32 and r.m == 9
    assert d.select(V.cosine("a", [0, 0, 0]).alias("c")).first().c == 1
    with pytest.raises(Exception):
        d.select(V.euclidean("a", [1.0])).collect()
    with pytest.raises(ValueError):
        V.distance("hamming", "a", "b")


def test_ivfpq(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(8 * i + j) for j in range(8)]) for i in range(100)], "vec_id long, embedding array<float>")
    config = ivfpq.IvfPqConfig(8, clusters=10, subvectors=4)
    index = ivfpq.create_index(spark, "ivf_pq", config)
    with pytest.raises(RuntimeError):
        index.search([0.0] * 8, 5)
    index.build(rows)
    found = index.search([50.0] * 8, 5).collect()
    assert index.is_built and len(found) == 5 and [r.distance for r in found] == sorted(r.distance for r in found)
    index.remove([found[0].id])
    index.save(str(tmp_path / "i"))
    again = ivfpq.IvfPq.load(spark, str(tmp_path / "i"))
    assert found[0].id not in [r.id for r in again.search([50.0] * 8, 5).collect()]
    again.add(rows.where(F.col("vec_id") == found[0].id))
    assert again.search([50.0] * 8, 5).first().id == found[0].id and again.stats()["vectors"] == 100
    with pytest.raises(ValueError):
        ivfpq.IvfPqConfig(10, subvectors=4)
    with pytest.raises(ValueError):
        again.search([1.0], 1)
    with pytest.raises(NotImplementedError):
        ivfpq.create_index(spark, "diskann", config)
    for metric in ("cosine", "dot", "manhattan"):
        made = ivfpq.IvfPq(spark, ivfpq.IvfPqConfig(8, clusters=4, subvectors=4, metric=metric)).build(rows)
        assert made.search([50.0] * 8, 3).count() == 3


def test_metadata_index(spark):
    d = spark.createDataFrame([(1, "rust programming language", "programming", 0.95), (2, "python scripting language", "scripting", 0.87), (0, "zero", "programming", 0.5), (40000, "far", "programming", 0.6), (-3, "below", "programming", 0.1)], "id long, text string, kind string, score double")
    index = metadata_index.MetadataIndex.build(d, "id", ["text"], ["kind"], ["score"])
    ids = lambda x: sorted(r[0] for r in x.collect())
    assert ids(index.text_search("text", "Rust")) == [1] and ids(index.text_search("text", "rust programming")) == []
    assert ids(index.text_search_all("text", "python language")) == [2] and index.text_search("none", "x") is None
    assert ids(index.categorical_filter("kind", "programming")) == [-3, 0, 1, 40000]
    assert ids(index.numerical_range("score", 0.88, 0.99)) == [1]
    assert index.combined_filter([]) is None and index.combined_filter([("text", "nope", "x")]) is None
    assert ids(index.combined_filter([("text", "text", "language"), ("range", "score", 0.9, 1.0)])) == [1]
    bitmap = index.categories["kind"]
    assert bitmap.count("programming").first().n == 4 and bitmap.contains("programming", 40000) and not bitmap.contains("programming", 2)
    inverted = index.texts["text"]
    assert ids(inverted.search_any(["rust", "python"])) == [1, 2] and ids(inverted.search_all([])) == []
    gone = spark.createDataFrame([("rust", 1)], "term string, doc_id long")
    assert ids(inverted.remove(gone).get("rust")) == [] and ids(inverted.remove(gone).add(gone).get("rust")) == [1]
    assert index.ranges["score"].bounds().first().asDict() == {"min": 0.1, "max": 0.95}


def test_hybrid_strategies(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0], i % 3) for i in range(60)], "vec_id long, embedding array<float>, kind int")
    exact = [r.id for r in metadata_index.hybrid_search(rows, F.col("kind") == 1, [10.0, 0.0], 5).collect()]
    assert exact == [10, 7, 13, 4, 16]
    assert [r.id for r in metadata_index.hybrid_search(rows, F.col("kind") == 1, [10.0, 0.0], 5, metadata_index.INTERLEAVED, over_fetch=1).collect()] == exact
    assert [r.id for r in metadata_index.hybrid_search(rows, F.col("kind") == 1, [10.0, 0.0], 5, metadata_index.SEARCH_THEN_FILTER).collect()] == exact


def test_splitters(spark):
    d = docs(spark, "x" * 1100 + "é", "", None)
    rows = splitters.create_splitter("hierarchical").split(d)
    assert {(r.level, r.n) for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()} == {(0, 2), (1, 3), (2, 9)}
    assert rows.select("id").distinct().count() == rows.count()
    short = splitters.PropositionSplitter().split(docs(spark, "Here stands a short text of two sentences. It stays one piece as it is below the limit.", "tiny", "no stop at the end"))
    assert {r.content for r in short.collect()} == {"Here stands a short text of two sentences. It stays one piece as it is below the limit.", "no stop at the end."}
    assert splitters.create_splitter("llm_rerank").split(d).count() == 2 and splitters.create_splitter("agentic").split(d).count() == 2
    with pytest.raises(ValueError):
        splitters.create_splitter("semantic")


def test_proposition_merge(spark):
    text = "a" * 4096 + "b" * 20 + " " * 4076 + "c" * 30
    found = [r.content for r in splitters.PropositionSplitter().split(docs(spark, text)).orderBy("chunk_index").collect()]
    assert found == ["a" * 4096 + ".", "b" * 20 + " " + "c" * 30 + "."]


def test_metadata(spark):
    d = docs(spark, "# My Title\n\nSome content here.", "# Only heading\n## Second\nLine\n====", "machine learning is transforming industries machine learning artificial intelligence", "")
    titles = [r.t for r in d.select(text_metadata.title(F.col("text")).alias("t"), "doc_id").orderBy("doc_id").collect()]
    assert titles[0] == "Some content here." and titles[1] == "Line" and titles[3] is None
    assert d.select(text_metadata.title(F.col("text"), F.lit("Given")).alias("t")).first().t == "Given"
    words = [r.word for r in text_metadata.keywords(d, 3).where("doc_id = 2").orderBy("rank").collect()]
    assert words[:2] == ["learning", "machine"]
    m = {r.doc_id: r.metadata for r in text_metadata.chunk_metadata(d).collect()}
    assert m[1].section_hierarchy == ["Only heading", "Second", "Line"] and m[3].keywords == []


def test_hierarchy(spark):
    d = spark.createDataFrame([(1, "a", "one two three four", 0), (1, "b", "one two three", 1), (1, "c", "one", 2), (1, "d", "five", 3), (2, "e", "one", 0)], "doc_id long, id string, content string, position long")
    edges = hierarchy.assign_parents(d)
    assert {(r.id, r.parent_id) for r in edges.collect()} == {("a", None), ("b", "a"), ("c", "b"), ("d", None), ("e", None)}
    assert {(r.id, r.ancestor, r.depth) for r in hierarchy.ancestors(edges).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    assert {r.id for r in hierarchy.descendants(edges, "a").collect()} == {"b", "c"} and [r.id for r in hierarchy.children(edges, "a").collect()] == ["b"]
    assert {r.id: r.depth for r in hierarchy.depths(edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0}
    context = {r.id: r.context for r in hierarchy.context(d, edges).collect()}
    assert context["b"] == "Parent context: one two three four\nChild chunks: 1\n\none two three" and context["d"] == "five"
    assert hierarchy.potential_parents(d).where("id = 'c'").count() == 3


def test_ancestors_of_any_depth(spark):
    deep = [(i, i + 1) for i in range(70)] + [(70, None)]
    ring = [(101, 102), (102, 103), (103, 101), (100, 101), (200, 200)]
    edges = spark.createDataFrame([*deep, *ring], "id long, parent_id long")
    got = sorted((r.id, r.ancestor, r.depth) for r in hierarchy.ancestors(edges).collect())
    around = [(100, 101, 1), (100, 102, 2), (100, 103, 3), *((101 + i, 101 + (i + k) % 3, k) for i in range(3) for k in (1, 2, 3)), (200, 200, 1)]
    assert got == sorted([*((i, j, j - i) for i in range(71) for j in range(i + 1, 71)), *around])
    assert {r.id: r.depth for r in hierarchy.depths(edges).collect()}[0] == 70 and hierarchy.descendants(edges, 70).count() == 70


def test_pipeline(spark):
    made = ingestion.PipelineBuilder().splitter(splitters.HierarchicalSplitter()).hierarchy().embedder(ingestion.mock_embedding).build().run(docs(spark, "x" * 300))
    rows = made.collect()
    assert len(rows) == 5 and all(len(r.embedding) == 384 for r in rows)
    with pytest.raises(ValueError):
        ingestion.PipelineBuilder().build()


def test_evaluation(spark):
    one = docs(spark, "This is a single sentence.", "a b. b c. c d.")
    got = {r.doc_id: r for r in evaluation.coherence(one, "text").collect()}
    assert got[0].internal == 1 and got[0].overall == 0.5 and abs(got[1].internal - 2 / 9) < 1e-9
    pair = spark.createDataFrame([("machine learning artificial intelligence", "artificial intelligence deep learning")], "a string, b string")
    assert abs(pair.select(evaluation.pair_overlap(F.col("a"), F.col("b"))).first()[0] - 0.6) < 1e-9
    aligned = spark.createDataFrame([("machine learning algorithms", ["machine learning algorithms work well"])], "q string, c array<string>")
    assert aligned.select(evaluation.query_alignment(F.col("q"), F.col("c"), 5)).first()[0] == 1
    report = evaluation.chunk_report(one, "text").first()
    assert report.n_chunks == 2 and 0 <= report.coherence <= 1 and evaluation.recommendations(report.coherence, report.consistency)
    assert evaluation.improvement(0, 5) == 0 and evaluation.improvement(2, 3) == 50


def test_stored_terms_without_a_shuffle(spark, tmp_path):
    """An index is written in sorted segments; a document that is there twice, or is added again, is found once."""
    d = spark.createDataFrame([(i % 40, f"the word{i % 7} this {'only' if i == 3 else ''}") for i in range(80)], "doc_id long, text string").repartition(3)
    made = metadata_index.InvertedIndex(metadata_index.text_terms(d, "doc_id", "text"))
    plan = metadata_index.text_terms(spark.range(9).select("id", F.lit("a b").alias("text")), "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    made.save(str(tmp_path / "terms"))
    ids = lambda x: sorted(r[0] for r in x.collect())
    for index in (made, metadata_index.InvertedIndex.load(spark, str(tmp_path / "terms")).add_text(d.limit(5), "doc_id", "text")):
        assert ids(index.get("the")) == ids(index.search_all(["the", "this"])) == list(range(40)) and ids(index.search_any(["only", "none"])) == [3]
