"""Queries of catalog changes, pruning, sessions, profiles, chunk hierarchies and evaluation over whole tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluation, hierarchy, ivfpq, knn, metadata_index, splitters, text_metadata
from ..operators.worker import materialise, shared_dir
from ..sources import Catalog, WriteConfig
from ..sources import pruning as P
from ..streaming import events
from . import engine, profile
from .session import Session, execute_query
from .tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = " ".join(sql.split())
        return f

    return keep


def _new(s: SparkSession) -> Catalog:
    """An empty catalog of its own."""
    return Catalog(s, f"{shared_dir(s)}/catalog-{uuid.uuid4().hex}")


def _by_status(s: SparkSession, d: str) -> Catalog:
    """``orders`` with one fragment for each status, in the order of keys."""
    catalog, rows = _new(s), table(s, d, "orders")
    catalog.create_table("orders", rows.schema)
    for status in sorted(r[0] for r in rows.select("o_orderstatus").distinct().collect()):
        catalog.writer("orders", WriteConfig(max_buffer_rows=10**9)).write(rows.where(F.col("o_orderstatus") == status).orderBy("o_orderkey")).commit()
    return catalog


@query("""WITH t AS (SELECT o_orderstatus, o_orderkey, o_totalprice, LAG(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS last FROM orders)
 SELECT o_orderstatus AS status, COUNT(*) AS row_count, COUNT(DISTINCT o_orderstatus) = 1 AS status_constant, COUNT(DISTINCT o_orderkey) = 1 AS key_constant, true AS key_sorted,
 COUNT(CASE WHEN o_totalprice < last THEN 1 END) = 0 AS price_sorted, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM t GROUP BY o_orderstatus""")
def fragment_flags(s, d):
    """Statistics and flags of every fragment, as the manifest has them."""
    rows = []
    for f in _by_status(s, d).fragments("orders"):
        k, p, o = (f.columns[c] for c in ("o_orderkey", "o_totalprice", "o_orderstatus"))
        rows.append((o["min"], f.row_count, o["is_constant"], k["is_constant"], k["is_sorted"], p["is_sorted"], p["min"], p["max"]))
    return s.createDataFrame(rows, "status string, row_count long, status_constant boolean, key_constant boolean, key_sorted boolean, price_sorted boolean, low double, high double")


_BOUNDS = "b AS (SELECT o_orderstatus AS status, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus), v AS (SELECT lo AS x FROM b UNION SELECT hi FROM b UNION SELECT lo - 1 FROM b UNION SELECT hi + 1 FROM b)"
_OPS = {">": "hi > x", ">=": "hi >= x", "<": "lo < x", "<=": "lo <= x", "=": "lo <= x AND hi >= x", "!=": "NOT (lo = hi AND lo = x)", "mirrored <": "hi > x", "in": "(lo <= x AND hi >= x) OR (lo <= x + 1 AND hi >= x + 1)", "between": "hi >= x AND lo <= x + 5", "overlaps": "hi >= x AND lo <= x + 5", "is null": "false", "is not null": "true", "not": "true", "no statistics": "true"}


@query(f"WITH {_BOUNDS} " + " UNION ALL ".join(f"SELECT status, '{op}' AS op, x, {test} AS kept FROM b, v" for op, test in _OPS.items()))
def pruning_truth(s, d):
    """Every comparison at and around the bounds of every fragment: kept, or pruned by its statistics."""
    catalog = _by_status(s, d)
    schema, found = catalog.schema("orders"), catalog.fragments("orders")
    ends = {f.columns["o_orderkey"][e] for f in found for e in ("min", "max")}
    values = ends | {f.columns["o_orderkey"]["min"] - 1 for f in found} | {f.columns["o_orderkey"]["max"] + 1 for f in found}
    make = {
        **{op: (lambda x, op=op: P.compare("o_orderkey", op, x)) for op in (">", ">=", "<", "<=", "=", "!=")}, "mirrored <": lambda x: P.reversed_compare(x, "<", "o_orderkey"), "in": lambda x: P.one_of("o_orderkey", [x, x + 1]),
        "between": lambda x: P.between("o_orderkey", x, x + 5), "is null": lambda x: P.is_null("o_orderkey"), "is not null": lambda x: P.is_not_null("o_orderkey"), "not": lambda x: ~P.compare("o_orderkey", "=", x),
        "no statistics": lambda x: P.compare("unknown", "=", x),
    }
    rows = []
    for f in found:
        for x in values:
            for op, p in make.items():
                rows.append((f.columns["o_orderstatus"]["min"], op, x, not P.can_prune(p(x), f.row_count, f.columns, schema)))
            rows.append((f.columns["o_orderstatus"]["min"], "overlaps", x, P.overlaps_range("o_orderkey", x, x + 5, f.columns, schema)))
    return s.createDataFrame(rows, "status string, op string, x long, kept boolean")


@query("SELECT COUNT(DISTINCT o_orderstatus) AS fragments, COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END) AS kept, COUNT(*) AS all_rows, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS kept_rows, COUNT(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN 1 END) AS found FROM orders")
def sql_pruning(s, d):
    """A WHERE clause chooses the fragments that are opened."""
    session = Session(s, _by_status(s, d).path)
    session.register_all()
    made = session.execute("SELECT COUNT(*) AS found FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
    p = made.pruning["orders"]
    return made.frame.select(*[F.lit(x).cast("long").alias(n) for n, x in (("fragments", p.total_fragments), ("kept", p.remaining_fragments), ("all_rows", p.total_rows), ("kept_rows", p.remaining_rows))], "found")


@query("SELECT COUNT(*) AS before_rows, COUNT(CASE WHEN o_custkey % 2 = 0 THEN 1 END) AS after_rows, SUM(CASE WHEN o_custkey % 2 = 0 THEN o_orderkey END)::BIGINT AS key_sum, COUNT(DISTINCT o_custkey % 2) - 1 AS deleted_files, 0::BIGINT AS tables_left FROM orders")
def catalog_changes(s, d):
    """Add two fragments, remove one, vacuum its file, read the other, drop the table."""
    catalog, rows = _new(s), table(s, d, "orders")
    catalog.create_table("orders", rows.schema)
    for k in (0, 1):
        catalog.writer("orders", WriteConfig(max_buffer_rows=10**9)).write(rows.where(F.col("o_custkey") % 2 == k)).commit()
    before, (even, odd) = catalog.row_count("orders"), catalog.fragments("orders")
    catalog.remove_fragment("orders", odd.id)
    deleted = catalog.vacuum()
    left = catalog.reader("orders").read_fragment(even.id).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("k")).first()
    catalog.drop_table("orders")
    return s.createDataFrame([(before, left.n, left.k, deleted, len(catalog.list_tables()))], "before_rows long, after_rows long, key_sum long, deleted_files long, tables_left long")


@query("SELECT c.codec, n_nationkey, n_name FROM nation, (VALUES ('zstd'), ('lz4'), ('none'), ('time_series'), ('vectors')) c(codec)")
def codecs(s, d):
    """A table written with every codec and preset reads back the same."""
    rows, parts = table(s, d, "nation"), []
    configs = {c: WriteConfig(compression=c) for c in ("zstd", "lz4", "none")} | {"time_series": WriteConfig.time_series(), "vectors": WriteConfig.vectors()}
    for name, config in configs.items():
        catalog = _new(s)
        catalog.create_table("nation", rows.schema)
        catalog.writer("nation", config).write(rows).commit()
        parts.append(catalog.reader("nation").read_columns("n_nationkey", "n_name").select(F.lit(name).alias("codec"), "n_nationkey", "n_name"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT 'empty' AS what, COUNT(*) AS n FROM orders WHERE false UNION ALL SELECT 'limited', LEAST(COUNT(*), 7) FROM orders UNION ALL SELECT 'nothing left', COUNT(*) FROM orders WHERE o_orderkey < 0")
def scans(s, d):
    """Scans of a table without fragments, with a limit, and with no fragment left."""
    catalog, full = _new(s), engine._orders(s, d)
    catalog.create_table("orders", full.schema("orders"))
    made = {"empty": catalog.scan("orders"), "limited": full.scan("orders", limit=7), "nothing left": full.scan("orders", [P.compare("o_orderkey", "<", 0)])}
    return s.createDataFrame([(k, v.count()) for k, v in made.items()], "what string, n long")


@query("SELECT r_regionkey AS region, COUNT(*) AS n, MIN(n_name) AS first_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def session_statements(s, d):
    """CREATE TABLE, INSERT INTO ... SELECT and a join of two catalog tables, in SQL."""
    for name in ("nation", "region"):
        table(s, d, name).createOrReplaceTempView(f"{name}_source")
    session = Session(s, _new(s).path)
    session.execute("CREATE TABLE made_nation (k BIGINT NOT NULL, name STRING, region BIGINT)")
    session.execute("CREATE TABLE made_region (k BIGINT, name STRING)")
    session.execute("INSERT INTO made_nation SELECT n_nationkey, n_name, n_regionkey FROM nation_source")
    session.execute("INSERT INTO made_region SELECT r_regionkey, r_name FROM region_source")
    return session.execute("SELECT r.k AS region, COUNT(*) AS n, MIN(n.name) AS first_name FROM made_nation n JOIN made_region r ON n.region = r.k GROUP BY r.k").frame


@query("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_orderkey < 1000 GROUP BY o_orderstatus")
def one_shot_query(s, d):
    return execute_query(s, engine._orders(s, d).path, "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_orderkey < 1000 GROUP BY o_orderstatus").frame


@query("""SELECT COUNT(*) AS input_rows, COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) AS output_rows, COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) AS exported_rows, ROUND(COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) / COUNT(*)::DOUBLE, 6) AS selectivity,
 COUNT(*) AS scanned, 2 * COUNT(*) AS scanned_twice, true AS phases FROM orders""")
def profiled_query(s, d):
    """Rows, filter statistics, scan metrics and export of a profiled query."""
    run = lambda: profile.profile(table(s, d, "orders").where("o_totalprice > 100000").select("o_orderkey"))
    p, again = run(), run()
    stats = next(x for n in p.tree.walk() if (x := n.filter_stats()))
    session = profile.MetricsScope("session")
    session.read(p)
    fine = set(p.phases_ms) == set(profile.PHASES) and "selectivity" in profile.report(p) and set(profile.compare(p, again)) == {*profile.PHASES, "execution", "total"}
    row = (stats["input_rows"], stats["output_rows"], json.loads(profile.export_json(p))["row_count"], round(stats["selectivity"], 6), profile.MetricsScope().read(p)["numOutputRows_this_scan"], session.read(again)["numOutputRows_session_total"], fine)
    return s.createDataFrame([row], "input_rows long, output_rows long, exported_rows long, selectivity double, scanned long, scanned_twice long, phases boolean")


@query("SELECT h AS strategy, n_name, COUNT(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey, (VALUES ('BROADCAST'), ('MERGE'), ('SHUFFLE_HASH'), ('SHUFFLE_REPLICATE_NL')) v(h) GROUP BY h, n_name")
def join_strategies(s, d):
    """The same join by every physical strategy, chosen by hint."""
    a, b = table(s, d, "supplier"), table(s, d, "nation")
    parts = [a.join(b.hint(h), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n")).select(F.lit(h).alias("strategy"), "n_name", "n") for h in ("BROADCAST", "MERGE", "SHUFFLE_HASH", "SHUFFLE_REPLICATE_NL")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"SELECT vec_id, ROUND(list_cosine_similarity(embedding::DOUBLE[], q), 4) + 0.0 AS cosine, ROUND(list_distance(embedding::DOUBLE[], q), 4) + 0.0 AS euclid FROM embeddings, {engine._QUERY} t")
def vector_functions(s, d):
    """``cosine_similarity`` and ``euclidean_distance`` in SQL."""
    V.register(s)
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e.createOrReplaceTempView("vector_rows")
    s.createDataFrame([(engine._first(s, d),)], "q array<double>").createOrReplaceTempView("vector_query")
    return s.sql("SELECT /*+ BROADCAST(vector_query) */ vec_id, ROUND(cosine_similarity(e, q), 4) + 0.0 AS cosine, ROUND(euclidean_distance(e, q), 4) + 0.0 AS euclid FROM vector_rows, vector_query")


@query("SELECT lang AS value, COUNT(DISTINCT doc_id) AS n FROM documents WHERE lang IS NOT NULL AND NOT (doc_id % 5 = 2) GROUP BY lang")
def bitmap_changes(s, d):
    """Bit maps after documents were added and others removed."""
    rows = table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("value"), "doc_id")
    first = metadata_index.BitmapIndex.build(rows.where("doc_id % 3 = 0").withColumnRenamed("value", "lang"), "lang", "doc_id")
    return first.add(rows.where("doc_id % 3 <> 0")).remove(rows.where("doc_id % 5 = 2")).counts()


@query("SELECT g AS start, event_type, COUNT(*) AS n FROM (SELECT event_type, UNNEST([time_bucket(INTERVAL '30 minutes', ts::TIMESTAMP), time_bucket(INTERVAL '30 minutes', ts::TIMESTAMP) - INTERVAL '30 minutes']) AS g FROM events) t GROUP BY g, event_type")
def events_sliding(s, d):
    made = events.windowed(table(s, d, "events"), "1 hour", "30 minutes")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_PARENTS = f"""{engine._CHUNKS}, m AS (SELECT a.doc_id, a.id, b.id AS parent_id, ROW_NUMBER() OVER (PARTITION BY a.doc_id, a.id ORDER BY strlen(b.content), b.position) AS r FROM c a JOIN c b ON a.doc_id = b.doc_id
 AND (strlen(b.content) > strlen(a.content) OR (strlen(b.content) = strlen(a.content) AND b.position > a.position)) AND contains(b.content, a.content)),
 e2 AS (SELECT id, parent_id FROM m WHERE r = 1), w AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM e2 UNION ALL SELECT w.id, e2.parent_id, depth + 1 FROM w JOIN e2 ON e2.id = w.ancestor)"""
_RECURSIVE = f"WITH RECURSIVE {_PARENTS}"


@query(f"{_RECURSIVE} SELECT id, ancestor, depth FROM w")
def chunk_ancestors(s, d):
    return hierarchy.chunk_ancestors(engine._chunks(s, d))


@query(f"{_RECURSIVE} SELECT c.id, CAST(COALESCE(MAX(depth), 0) AS INTEGER) AS depth FROM c LEFT JOIN w ON w.id = c.id GROUP BY c.id")
def chunk_depths(s, d):
    return hierarchy.chunk_depths(engine._chunks(s, d))


@query(f"{_RECURSIVE} SELECT w.id, w.depth FROM w WHERE ancestor = (SELECT MIN(ancestor) FROM w)")
def chunk_descendants(s, d):
    edges = materialise(hierarchy.assign_parents(engine._chunks(s, d)))
    root = edges.agg(F.min("parent_id")).first()[0]  # every ancestor is some chunk's parent
    return hierarchy.descendants(edges, root)


@query(f"{_RECURSIVE}, n AS (SELECT parent_id AS id, COUNT(*) AS k FROM e2 GROUP BY parent_id) SELECT c.id, CASE WHEN e2.parent_id IS NULL AND k IS NULL THEN c.content ELSE concat_ws(chr(10), 'Parent context: ' || SUBSTR(p.content, 1, 200), 'Child chunks: ' || k) || chr(10) || chr(10) || c.content END AS context FROM c LEFT JOIN e2 ON e2.id = c.id LEFT JOIN c p ON p.id = e2.parent_id LEFT JOIN n ON n.id = c.id")
def chunk_context(s, d):
    return hierarchy.chunk_context(engine._chunks(s, d))


@query(f"WITH {engine._CHUNKS} SELECT a.doc_id, a.id, b.id AS parent_id, ROUND(strlen(a.content) / CAST(strlen(b.content) AS DOUBLE), 6) AS score FROM c a JOIN c b ON a.doc_id = b.doc_id AND strlen(a.content) <= strlen(b.content) AND contains(b.content, a.content)")
def chunk_potential_parents(s, d):
    return hierarchy.potential_parents(engine._chunks(s, d)).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, text AS content, 'Medium' AS granularity, 'agentic' AS kind FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, text, 'Medium', 'llm_rerank' FROM documents WHERE text IS NOT NULL")
def splitter_factory(s, d):
    docs = engine._documents(s, d)
    made = [splitters.create_splitter(k).split(docs).select("doc_id", "content", "granularity", F.lit(k).alias("kind")) for k in ("agentic", "llm_rerank")]
    return made[0].unionByName(made[1])


@query("SELECT doc_id, lang AS language FROM documents")
def extract_language(s, d):
    return text_metadata.chunk_metadata(table(s, d, "documents")).select("doc_id", "metadata.language")


@query("""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM benchmark), t AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM documents WHERE doc_id = (SELECT MIN(doc_id) FROM documents))
 SELECT item_id, ROUND(len(list_intersect(q.s, t.s)) / CAST(GREATEST(len(q.s), 1) AS DOUBLE), 6) AS alignment FROM q, t""")
def query_alignment(s, d):
    first = table(s, d, "documents").orderBy("doc_id").limit(1).select(F.array("text").alias("contents"))
    rows = table(s, d, "benchmark").select("item_id", "text").join(F.broadcast(first))  # one row
    return rows.select("item_id", F.round(evaluation.query_alignment(F.col("text"), F.col("contents"), 5), 6).alias("alignment"))


@query("SELECT COUNT(*) * 10 AS wanted, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ivfpq_recall(s, d):
    """Whether the index, refined by exact distances, finds 0.9 or more of the ten nearest, over every hundredth vector."""
    e = table(s, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    index = ivfpq.IvfPq(s, ivfpq.IvfPqConfig(64, clusters=16, subvectors=8, probes=14)).build(e)
    near, exact = index.refined(e, queries, 10, 20), knn.nearest_many(e, queries, 10)
    hits = exact.join(near.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return exact.groupBy().agg(F.count("*").alias("wanted")).join(hits.groupBy().agg(F.count("*").alias("found"))).select("wanted", (F.col("found") >= 0.9 * F.col("wanted")).alias("reached"))
