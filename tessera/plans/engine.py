"""Queries of the storage, vector, index, ingestion and evaluation operators over whole tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, hierarchy, ingestion, ivfpq, knn, metadata_index, splitters, text_metadata
from ..operators.worker import shared_dir
from ..sources import Catalog, WriteConfig
from ..sources import pruning as P
from ..sources.files import Files
from .tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return keep


def _shared(s: SparkSession) -> str:
    """A folder that all executors see, for tables that queries build."""
    return shared_dir(s)


def _orders(s: SparkSession, d: str) -> Catalog:
    """A catalog with ``orders`` written in ranges of the key, four fragments; built once for a folder."""
    path = f"{_shared(s)}/catalog-{hashlib.md5(os.path.realpath(d).encode()).hexdigest()[:12]}-{s.sparkContext.applicationId}"
    catalog = Catalog(s, path)
    if not catalog.table_exists("orders"):
        from ..sources.table import write_fragments

        rows = table(s, d, "orders")
        catalog.create_table("orders", rows.schema)
        ranged = rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")
        catalog.add_fragments("orders", write_fragments(catalog, ranged, rows.schema, WriteConfig()))
    return catalog


@query("SELECT COUNT(*) AS row_count, MIN(o_orderkey) AS low, MAX(o_orderkey) AS high, 0::BIGINT AS nulls FROM orders")
def fragment_stats(s, d):
    """The table's statistics put together from its fragments'."""
    catalog = _orders(s, d)
    found = [(f.row_count, f.columns["o_orderkey"]["min"], f.columns["o_orderkey"]["max"], f.columns["o_orderkey"]["null_count"]) for f in catalog.fragments("orders")]
    rows = s.createDataFrame(found, "n long, low long, high long, nulls long")
    return rows.agg(F.sum("n").alias("row_count"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= (SELECT MAX(o_orderkey) - 100 FROM orders)")
def pruned_scan(s, d):
    catalog = _orders(s, d)
    top = max(f.columns["o_orderkey"]["max"] for f in catalog.fragments("orders"))
    return catalog.scan("orders", [P.compare("o_orderkey", ">=", top - 100)], ["o_orderkey", "o_custkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def projected_scan(s, d):
    return _orders(s, d).reader("orders").read_columns("o_orderkey", "o_orderstatus")


@query("SELECT COUNT(*) AS row_count FROM orders")
def table_row_count(s, d):
    return s.createDataFrame([(_orders(s, d).row_count("orders"),)], "row_count long")


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
def compacted_scan(s, d):
    path = f"{_orders(s, d).path}-compacted"
    catalog = Catalog(s, path)
    if not catalog.table_exists("orders"):
        rows = table(s, d, "orders")
        catalog.create_table("orders", rows.schema)
        for k in (0, 1):
            catalog.writer("orders", WriteConfig(max_buffer_rows=10**9)).write(rows.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == k)).commit()
        catalog.compact("orders")
    return catalog.reader("orders").read_combined().groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def session_sql(s, d):
    from .session import Session

    session = Session(s, _orders(s, d).path)
    session.register_table("orders")
    made = session.execute("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority").frame
    return made


_QUERY = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT MIN(vec_id) FROM embeddings))"


def _first(s, d) -> list[float]:
    rows = table(s, d, "embeddings")
    return [float(x) for x in rows.orderBy("vec_id").select("embedding").first()[0]]


def _distances(metric: str, expression: str) -> None:
    @query(f"SELECT vec_id, ROUND({expression}, 4) + 0.0 AS distance FROM embeddings, {_QUERY} t")
    def run(s, d):
        q = _first(s, d)
        one = F.broadcast(s.createDataFrame([(q,)], "q array<double>"))  # one row
        return table(s, d, "embeddings").join(one).select("vec_id", (F.round(V.distance(metric, "embedding", "q"), 4) + 0.0).alias("distance"))

    Q[f"vec_{metric}"] = Q.pop("run")
    SQL[f"vec_{metric}"] = SQL.pop("run")


_distances("euclidean", "list_distance(embedding::DOUBLE[], q)")
_distances("cosine", "list_cosine_distance(embedding::DOUBLE[], q)")
_distances("dot", "-list_inner_product(embedding::DOUBLE[], q)")
_distances("manhattan", "list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: abs(p[1] - p[2])))")


@query(f"SELECT vec_id AS id, ROUND(list_distance(embedding::DOUBLE[], q), 4) AS distance FROM embeddings, {_QUERY} t ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def knn_exact(s, d):
    return knn.nearest(table(s, d, "embeddings"), _first(s, d), 10).withColumn("distance", F.round("distance", 4))


@query("""SELECT query_id, id, ROUND(distance, 4) AS distance, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
 ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY ROUND(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) t WHERE rank <= 5""")
def knn_batch(s, d):
    e = table(s, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = knn.nearest_many(e, queries, 5, digits=6)
    return found.select("query_id", "id", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT vec_id AS id, ROUND(list_cosine_distance(embedding::DOUBLE[], q), 4) + 0.0 AS distance FROM embeddings, {_QUERY} t WHERE label IN (1, 3) ORDER BY list_cosine_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def knn_filtered(s, d):
    found = metadata_index.hybrid_search(table(s, d, "embeddings"), F.col("label").isin(1, 3), _first(s, d), 10, metric="cosine")
    return found.withColumn("distance", F.round("distance", 4) + 0.0)


@query(f"SELECT vec_id AS id, ROUND(list_distance(embedding::DOUBLE[], q), 4) AS distance FROM embeddings, {_QUERY} t ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def ivfpq_search(s, d):
    """With every cell probed and enough candidates ranked exactly, the index gives the exact neighbours."""
    e = table(s, d, "embeddings")
    index = ivfpq.IvfPq(s, ivfpq.IvfPqConfig(64, clusters=16, subvectors=8, probes=16)).build(e)
    asked = s.createDataFrame([(0, _first(s, d))], "query_id long, query array<double>")
    return index.refined(e, asked, 10, 50).select("id", F.round("distance", 4).alias("distance"))


_WORDS = "regexp_split_to_array(lower(text), '\\s+')"


def _terms(s, d) -> metadata_index.InvertedIndex:
    """The inverted index of all texts, written once for a folder, each segment in the order of terms, so that a search reads few pages."""
    path = f"{_shared(s)}/terms-{hashlib.md5(os.path.realpath(d).encode()).hexdigest()[:12]}-{s.sparkContext.applicationId}"
    if not Files(s, path).exists("_SUCCESS"):
        metadata_index.InvertedIndex(metadata_index.text_terms(table(s, d, "documents"), "doc_id", "text")).save(path)
    return metadata_index.InvertedIndex.load(s, path)


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) t WHERE term IN ('worthless', 'clown')")
def text_any(s, d):
    return _terms(s, d).search_any(["worthless", "clown"])


@query(f"SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest({_WORDS}) AS term FROM documents) t WHERE term IN ('the', 'this') GROUP BY doc_id HAVING COUNT(*) = 2")
def text_all(s, d):
    return _terms(s, d).search_all(["the", "this"])


@query("SELECT lang AS value, COUNT(DISTINCT doc_id) AS n FROM documents GROUP BY lang")
def bitmap_count(s, d):
    return metadata_index.BitmapIndex.build(table(s, d, "documents"), "lang", "doc_id").counts()


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def bitmap_documents(s, d):
    return metadata_index.BitmapIndex.build(table(s, d, "documents"), "lang", "doc_id").documents("de")


@query("SELECT n_chars AS value, doc_id FROM documents WHERE n_chars BETWEEN 500 AND 900")
def range_query(s, d):
    return metadata_index.RangeIndex.build(table(s, d, "documents"), "n_chars", "doc_id").query(500, 900)


@query(f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 300 AND 3000 AND list_contains({_WORDS}, 'this')")
def combined_filter(s, d):
    index = metadata_index.MetadataIndex.build(table(s, d, "documents"), "doc_id", ["text"], ["lang"], ["n_chars"])
    return index.combined_filter([("category", "lang", "en"), ("range", "n_chars", 300, 3000), ("text", "text", "this")])


@query(f"""SELECT e.vec_id AS id, ROUND(list_distance(e.embedding::DOUBLE[], q), 4) AS distance FROM embeddings e JOIN documents ON doc_id = e.vec_id, {_QUERY} t
 WHERE n_chars BETWEEN 300 AND 3000 AND lang = 'en' ORDER BY list_distance(e.embedding::DOUBLE[], q), e.vec_id LIMIT 10""")
def hybrid_search(s, d):
    rows = table(s, d, "embeddings").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id") == F.col("vec_id"))
    return metadata_index.hybrid_search(rows, F.col("n_chars").between(300, 3000) & (F.col("lang") == "en"), _first(s, d), 10).withColumn("distance", F.round("distance", 4))


def _documents(s, d) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("language"))


@query("""WITH l AS (SELECT * FROM (VALUES (0, 1024, 'Small'), (1, 512, 'Medium'), (2, 128, 'Large')) v(level, size, granularity)),
 c AS (SELECT doc_id, level, granularity, size, text, UNNEST(RANGE(0, CAST(CEIL(LENGTH(text) / size) AS BIGINT))) AS i FROM documents, l)
 SELECT doc_id, level, granularity, CAST(i AS INTEGER) AS chunk_index, CAST(CEIL(LENGTH(text) / size) AS INTEGER) AS total_chunks, SUBSTR(text, i * size + 1, size) AS content FROM c""")
def split_hierarchical(s, d):
    return splitters.HierarchicalSplitter().split(_documents(s, d)).select("doc_id", "level", "granularity", "chunk_index", "total_chunks", "content")


_P = "regexp_replace(regexp_replace(p, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '')"


@query(f"""WITH e AS (SELECT doc_id, text, UNNEST(RANGE(0, CAST(CEIL(LENGTH(text) / 4096) AS BIGINT))) AS i FROM documents), t AS (SELECT doc_id, i, {_P.replace("p,", "SUBSTR(text, i * 4096 + 1, 4096),", 1)} AS p FROM e),
 f AS (SELECT doc_id, i, CASE WHEN RIGHT(p, 1) IN ('.', '!', '?', '。', '！', '？', ';', '；') THEN p ELSE p || '.' END AS content FROM t WHERE p <> ''), g AS (SELECT * FROM f WHERE LENGTH(content) > 8)
 SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(COUNT(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, content FROM g""")
def split_proposition(s, d):
    """Windows of 4,096 characters are never below the 40 that merging needs, so only trimming, ending and dropping show here."""
    return splitters.PropositionSplitter().split(_documents(s, d)).select("doc_id", "chunk_index", "total_chunks", "content")


@query("SELECT doc_id, text AS content, 'Medium' AS granularity FROM documents")
def split_rerank(s, d):
    return splitters.RerankSplitter().split(_documents(s, d)).select("doc_id", "content", "granularity")


_TRIM = "regexp_replace(regexp_replace({0}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"
_LINES = f"list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')})"


@query(f"""SELECT doc_id, COALESCE(list_filter(list_slice({_LINES}, 1, 5), lambda x: x <> '' AND NOT starts_with(x, '#') AND strlen(x) < 100)[1],
 {_TRIM.format(f"substr(list_filter({_LINES}, lambda x: starts_with(x, '# '))[1], 3)")}) AS title FROM documents""")
def extract_title(s, d):
    return table(s, d, "documents").select("doc_id", text_metadata.title(F.col("text")).alias("title"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents), c AS (SELECT doc_id, regexp_replace(regexp_replace(lower(w), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '') AS word FROM w WHERE strlen(w) > 4),
 n AS (SELECT doc_id, word, COUNT(*) AS count FROM c WHERE word <> '' GROUP BY doc_id, word), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY count DESC, word) AS rank FROM n) SELECT doc_id, word, count, rank FROM r WHERE rank <= 5""")
def extract_keywords(s, d):
    found = text_metadata.keywords(table(s, d, "documents"), 5)
    return found.select("doc_id", "word", "count", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT doc_id, list_aggregate(list_transform(list_filter({_LINES}, lambda x: regexp_matches(x, '^#{{1,3}} ')), lambda x: {_TRIM.format("regexp_replace(x, '^#{1,3} ', '')")}), 'string_agg', '|') AS headings FROM documents""")
def extract_sections(s, d):
    joined = F.array_join(text_metadata.sections(F.col("text")), "|")
    return table(s, d, "documents").select("doc_id", F.nullif(joined, F.lit("")).alias("headings"))


def _chunks(s, d) -> DataFrame:
    """Chunks of all documents with readable ids and places."""
    rows = splitters.HierarchicalSplitter().split(_documents(s, d))
    return rows.select("doc_id", F.concat_ws("-", "doc_id", "level", "chunk_index").alias("id"), "content", (F.col("level") * 1_000_000 + F.col("chunk_index")).alias("position"))


_CHUNKS = """l AS (SELECT * FROM (VALUES (0, 1024), (1, 512), (2, 128)) v(level, size)),
 e AS (SELECT doc_id, level, size, text, UNNEST(RANGE(0, CAST(CEIL(LENGTH(text) / size) AS BIGINT))) AS i FROM documents, l),
 c AS (SELECT doc_id, doc_id || '-' || level || '-' || i AS id, SUBSTR(text, i * size + 1, size) AS content, level * 1000000 + i AS position FROM e)"""


@query(f"""WITH {_CHUNKS}, m AS (SELECT a.doc_id, a.id, b.id AS parent_id, ROW_NUMBER() OVER (PARTITION BY a.doc_id, a.id ORDER BY strlen(b.content), b.position) AS r FROM c a JOIN c b ON a.doc_id = b.doc_id
 AND (strlen(b.content) > strlen(a.content) OR (strlen(b.content) = strlen(a.content) AND b.position > a.position)) AND contains(b.content, a.content))
 SELECT c.doc_id, c.id, m.parent_id FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.id = c.id AND r = 1""")
def chunk_parents(s, d):
    return hierarchy.assign_parents(_chunks(s, d))


@query("SELECT doc_id, ROUND(CAST(CAST(tanh(strlen(text) * sin(1.0) * 0.01) AS FLOAT) AS DOUBLE), 4) AS v1, ROUND(CAST(CAST(tanh(strlen(text) * sin(383.0) * 0.01) AS FLOAT) AS DOUBLE), 4) AS v383, 384 AS n FROM documents")
def mock_embedding(s, d):
    e = ingestion.mock_embedding(F.col("text"))
    return table(s, d, "documents").select("doc_id", e.alias("e")).select("doc_id", F.round(F.col("e")[1].cast("double"), 4).alias("v1"), F.round(F.col("e")[383].cast("double"), 4).alias("v383"), F.size("e").alias("n"))


@query(f"""WITH {_CHUNKS}, k AS (SELECT doc_id, id, content, SUBSTR(sha256(doc_id || '|hierarchical|' || level || '|' || i), 1, 32) AS name FROM (SELECT doc_id, level, i, doc_id || '-' || level || '-' || i AS id, SUBSTR(text, i * size + 1, size) AS content FROM e) x),
 m AS (SELECT a.doc_id, a.id, b.id AS parent_id, ROW_NUMBER() OVER (PARTITION BY a.doc_id, a.id ORDER BY strlen(b.content), b.position) AS r FROM c a JOIN c b ON a.doc_id = b.doc_id AND (strlen(b.content) > strlen(a.content) OR (strlen(b.content) = strlen(a.content) AND b.position > a.position)) AND contains(b.content, a.content))
 SELECT k.doc_id, k.name AS id, k.content, p.name AS parent_chunk_id, ROUND(CAST(CAST(tanh(strlen(k.content) * sin(1.0) * 0.01) AS FLOAT) AS DOUBLE), 4) AS v1, 384 AS n FROM k LEFT JOIN m ON m.doc_id = k.doc_id AND m.id = k.id AND r = 1 LEFT JOIN k p ON p.doc_id = m.doc_id AND p.id = m.parent_id""")
def ingest_pipeline(s, d):
    pipeline = ingestion.PipelineBuilder().splitter(splitters.HierarchicalSplitter()).embedder(ingestion.mock_embedding).hierarchy().build()
    made = pipeline.run(_documents(s, d))
    return made.select("doc_id", "id", "content", "parent_chunk_id", F.round(F.col("embedding")[1].cast("double"), 4).alias("v1"), F.size("embedding").alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS ss FROM conversations),
 k AS (SELECT conv_id, turn, ss, list_transform(ss, lambda x: list_distinct(regexp_split_to_array(x, '\\s+'))) AS sets FROM t),
 p AS (SELECT conv_id, turn, a.i AS i, b.i AS j, sets[a.i] AS x, sets[b.i] AS y FROM k, LATERAL (SELECT UNNEST(RANGE(1, len(ss) + 1)) AS i) a, LATERAL (SELECT UNNEST(RANGE(1, len(ss) + 1)) AS i) b WHERE a.i < b.i),
 m AS (SELECT conv_id, turn, AVG(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE)) AS c FROM p GROUP BY conv_id, turn)
 SELECT k.conv_id, k.turn, ROUND(COALESCE(c, 1.0), 6) AS internal, ROUND(COALESCE(c, 1.0) / 2, 6) AS overall FROM k LEFT JOIN m ON m.conv_id = k.conv_id AND m.turn = k.turn""")
def coherence(s, d):
    rows = evaluation.coherence(table(s, d, "conversations"), "text")
    return rows.select("conv_id", "turn", F.round("internal", 6).alias("internal"), F.round("overall", 6).alias("overall"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS s FROM conversations)
 SELECT a.conv_id, a.turn, ROUND(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) END, 6) AS overlap
 FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def lexical_overlap(s, d):
    c = table(s, d, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("following"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(evaluation.pair_overlap(F.col("text"), F.col("following")), 6).alias("overlap"))


@query("""WITH w AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM documents), q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM benchmark),
 r AS (SELECT query_id, id, len(list_intersect(q.s, w.s)) / CAST(len(w.s) AS DOUBLE) AS score FROM q, w WHERE len(list_intersect(q.s, w.s)) > 0),
 k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) SELECT query_id, id, ROUND(score, 6) AS score, rank FROM k WHERE rank <= 5""")
def word_retrieval(s, d):
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    chunks = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return evaluation.retrieve(queries, chunks).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), k AS (SELECT * FROM r WHERE rank <= 5),
 t AS (SELECT user_id AS query_id, event_id AS id FROM events WHERE event_type = 'purchase'), h AS (SELECT k.query_id, COUNT(t.id) AS hits, COUNT(*) AS n, MIN(CASE WHEN t.id IS NOT NULL THEN k.rank END) AS first FROM k LEFT JOIN t ON t.query_id = k.query_id AND t.id = k.id GROUP BY k.query_id),
 w AS (SELECT query_id, COUNT(*) AS wanted FROM t GROUP BY query_id) SELECT h.query_id, ROUND(COALESCE(hits / CAST(LEAST(wanted, 5) AS DOUBLE), 0), 6) AS recall, ROUND(COALESCE(hits / CAST(LEAST(n, 5) AS DOUBLE), 0), 6) AS precision, ROUND(COALESCE(1.0 / CAST(first AS DOUBLE), 0), 6) AS mrr FROM h LEFT JOIN w ON w.query_id = h.query_id""")
def retrieval_metrics(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "event_type", "value")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "id"))).where("rank <= 5").select("query_id", "id", "rank")
    made = evaluation.retrieval_metrics(ranked, e.where("event_type = 'purchase'").select("query_id", "id"), 5)
    return made.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query("SELECT COUNT(*) AS n_chunks, ROUND(AVG(strlen(text)), 4) AS mean_size, ROUND(stddev_pop(strlen(text)), 4) AS std_size, ROUND(1 / (1 + stddev_pop(strlen(text)) / AVG(strlen(text))), 6) AS consistency FROM conversations")
def chunk_report(s, d):
    made = evaluation.chunk_report(table(s, d, "conversations"), "text")
    return made.select("n_chunks", F.round("mean_size", 4).alias("mean_size"), F.round("std_size", 4).alias("std_size"), F.round("consistency", 6).alias("consistency"))
