"""One query for each family of the SQL surface, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name with its oracle."""

    def keep(f):
        Q[f.__name__] = f
        SQL[f.__name__] = " ".join(sql.split())
        return f

    return keep


def _li(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem")


def _dec(c: str, p: int = 14, n: int = 2):
    return F.col(c).cast(f"decimal({p},{n})")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity * 2 AS DOUBLE) AS twice, CAST(l_shipdate AS DATE) AS ship FROM lineitem WHERE l_quantity > 45 AND l_shipdate < TIMESTAMP '1996-01-01'")
def scan_project(s, d):
    return _li(s, d).where((F.col("l_quantity") > 45) & (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("twice"), F.col("l_shipdate").cast("date").alias("ship"))


@query("SELECT p_partkey, p_name FROM part WHERE (p_brand = 'Brand#1' AND p_size < 10) OR (p_type = 'PROMO' AND p_size > 40)")
def filter_or(s, d):
    return table(s, d, "part").where(((F.col("p_brand") == "Brand#1") & (F.col("p_size") < 10)) | ((F.col("p_type") == "PROMO") & (F.col("p_size") > 40))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size BETWEEN 5 AND 12 AND p_type IN ('PROMO', 'SMALL') AND p_name LIKE '%o%' AND p_name NOT LIKE 'red%' AND p_brand <> 'Brand#7'")
def filter_between_in_like(s, d):
    return table(s, d, "part").where(F.col("p_size").between(5, 12) & F.col("p_type").isin("PROMO", "SMALL") & F.col("p_name").contains("o") & ~F.col("p_name").startswith("red") & (F.col("p_brand") != "Brand#7")).select("p_partkey", "p_name", "p_brand")


@query("SELECT DISTINCT event_type, CAST(user_id % 10 AS BIGINT) AS bucket FROM events")
def distinct_types(s, d):
    return table(s, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
def case_when(s, d):
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("band"))


@query("WITH t AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT k AS custkey, n FROM t WHERE n > (SELECT AVG(n) * 1.5 FROM t)")
def cte_reuse(s, d):
    per = table(s, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n"))
    mean = per.agg((F.avg("n") * 1.5).alias("m"))
    return per.join(F.broadcast(mean), F.col("n") > F.col("m")).select("custkey", "n")  # one row on the right


@query("SELECT 1 AS one, CAST(7 // 2 AS BIGINT) AS half, CAST(7 % 2 AS INTEGER) AS rest, 'x' || 'y' AS xy, CAST(NULL AS INTEGER) AS nothing")
def literal_select(s, d):
    return s.sql("SELECT 1 AS one, 7 DIV 2 AS half, 7 % 2 AS rest, 'x' || 'y' AS xy, CAST(NULL AS INT) AS nothing")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND o_totalprice > 100000")
def join_inner(s, d):
    far = table(s, d, "nation").where("n_regionkey = 1")
    people = table(s, d, "customer").join(far, F.col("c_nationkey") == F.col("n_nationkey"))
    return table(s, d, "orders").where("o_totalprice > 100000").join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(s, d):
    a, b = table(s, d, "nation").alias("a"), table(s, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


@query("SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def join_left_on_filter(s, d):
    big = table(s, d, "orders").where("o_totalprice > 200000")
    per = big.groupBy("o_custkey").agg(F.count("*").alias("n"))  # aggregated before the join
    return table(s, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(s, d):
    return table(s, d, "supplier").where("s_acctbal > 5000").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_name", "n_name")


@query("SELECT a.p_size AS left_size, b.p_size AS right_size FROM (SELECT DISTINCT p_size FROM part WHERE p_size < 30) a FULL JOIN (SELECT DISTINCT p_size FROM part WHERE p_size > 20) b ON a.p_size = b.p_size")
def join_full(s, d):
    sizes = table(s, d, "part").select("p_size").distinct()
    a, b = sizes.where("p_size < 30").withColumnRenamed("p_size", "left_size"), sizes.where("p_size > 20").withColumnRenamed("p_size", "right_size")
    return a.join(b, F.col("left_size") == F.col("right_size"), "full")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi_exists(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def join_semi_in(s, d):
    return table(s, d, "supplier").join(_li(s, d).where("l_quantity = 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT a.o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.o_totalprice > a.o_totalprice * 20)")
def join_semi_residual(s, d):
    a, b = table(s, d, "orders").alias("a"), table(s, d, "orders").alias("b")
    cond = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") != F.col("b.o_orderkey")) & (F.col("b.o_totalprice") > F.col("a.o_totalprice") * 20)
    return a.join(b, cond, "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')")
def join_anti_not_exists(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").where(F.col("o_orderpriority").startswith("1-")), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT COUNT(*) AS n FROM part WHERE p_partkey NOT IN (SELECT NULLIF(l_partkey, 7) FROM lineitem WHERE l_quantity > 49)")
def join_anti_null_aware(s, d):
    table(s, d, "part").createOrReplaceTempView("part")
    _li(s, d).createOrReplaceTempView("lineitem")
    return s.sql("SELECT COUNT(*) AS n FROM part WHERE p_partkey NOT IN (SELECT NULLIF(l_partkey, 7) FROM lineitem WHERE l_quantity > 49)")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 5")
def join_cross(s, d):
    return table(s, d, "region").crossJoin(table(s, d, "nation").where("n_nationkey < 5")).select("r_name", "n_name")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT * FROM (VALUES (1, 10), (11, 20), (21, 50)) b(lo, hi)) bands ON p_size BETWEEN lo AND hi")
def join_range(s, d):
    bands = s.createDataFrame([(1, 10), (11, 20), (21, 50)], "lo int, hi int")
    return table(s, d, "part").join(F.broadcast(bands), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "lo")


@query("SELECT event_id, (SELECT MAX(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id <= e.event_id))) AS last_purchase FROM events e WHERE event_type IN ('purchase', 'view')")
def join_asof(s, d):
    """The last purchase up to each view: one sort by user and time, no join."""
    rows = table(s, d, "events").where(F.col("event_type").isin("purchase", "view"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(before).alias("last_purchase"))


@query("SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 2 * AVG(CAST(i.o_totalprice AS DECIMAL(14,2))) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def scalar_subquery_correlated(s, d):
    o = table(s, d, "orders")
    mean = o.groupBy(F.col("o_custkey").alias("k")).agg((F.sum(_dec("o_totalprice")).cast("double") / F.count("*") * 2).alias("limit_price"))
    return o.join(mean, (F.col("o_custkey") == F.col("k")) & (F.col("o_totalprice") > F.col("limit_price"))).select("o_orderkey")


@query("SELECT l_returnflag, COUNT(*) AS n, CAST(MIN(l_quantity) AS DOUBLE) AS low, CAST(MAX(l_quantity) AS DOUBLE) AS high, CAST(SUM(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag")
def agg_basic(s, d):
    return _li(s, d).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.sum(_dec("l_quantity")).cast("double").alias("total"))


@query("SELECT COUNT(*) AS n, SUM(CASE WHEN l_quantity > 1000 THEN 1 END)::BIGINT AS none, MAX(CASE WHEN l_quantity > 1000 THEN l_quantity END) AS nothing FROM lineitem")
def agg_global(s, d):
    big = F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))
    return _li(s, d).agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_quantity") > 1000, 1)).alias("none"), F.max(big).alias("nothing"))


@query("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_distinct(s, d):
    return _li(s, d).groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT n, COUNT(*) AS users FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) t GROUP BY n")
def agg_two_level(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) * 2.0 / COUNT(DISTINCT o_custkey) FROM orders)")
def agg_having_subquery(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders")
    return s.sql("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) * 2.0D / COUNT(DISTINCT o_custkey) FROM orders)")


@query("SELECT event_type, SUM(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even, ROUND(CAST(SUM(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 6) AS share FROM events GROUP BY event_type")
def agg_conditional(s, d):
    even = F.count_if(F.col("user_id") % 2 == 0)
    return table(s, d, "events").groupBy("event_type").agg(even.alias("even"), F.round(even / F.count("*"), 6).alias("share"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(s, d):
    return _li(s, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(s, d):
    return _li(s, d).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def agg_grouping_sets(s, d):
    return table(s, d, "part").groupingSets([["p_brand"], ["p_type"], []], "p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS yr, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS mon, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def agg_expression_keys(s, d):
    return table(s, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("yr"), F.month("o_orderdate").cast("long").alias("mon")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, ROW_NUMBER() OVER w AS pos, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rnk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dense FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_rank(s, d):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("pos"), F.rank().over(v).cast("long").alias("rnk"), F.dense_rank().over(v).cast("long").alias("dense"))


@query("SELECT event_id, LAG(event_id) OVER w AS previous, LEAD(event_type) OVER w AS following, FIRST_VALUE(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_lag(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select("event_id", F.lag("event_id").over(w).alias("previous"), F.lead("event_type").over(w).alias("following"), F.first("event_id").over(w).alias("first"))


@query("SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(14,2))) OVER w AS DOUBLE) AS running, COUNT(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def window_frame(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return table(s, d, "events").select("event_id", F.sum(_dec("value")).over(w).cast("double").alias("running"), F.count("*").over(w).alias("n"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(s, d):
    return table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", F.col("o_totalprice").alias("price"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(s, d):
    return union_all(s, d).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def intersect(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k")))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def except_distinct(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(s, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("""SELECT p_partkey, UPPER(p_name) AS up, LOWER(p_brand) AS low, CAST(LENGTH(p_name) AS INTEGER) AS n, SUBSTRING(p_name, 2, 3) AS part, REPLACE(p_name, ' ', '_') AS joined, TRIM('  x ') || p_type AS tagged,
 REVERSE(p_name) AS back, LPAD(p_type, 10, '.') AS padded, CAST(STRPOS(p_name, ' ') AS INTEGER) AS gap, SPLIT_PART(p_name, ' ', 2) AS noun, REGEXP_REPLACE(p_name, '[aeiou]', '*', 'g') AS masked FROM part""")
def fn_string(s, d):
    n = F.col("p_name")
    return table(s, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower("p_brand").alias("low"), F.length(n).alias("n"), F.substring(n, 2, 3).alias("part"), F.replace(n, F.lit(" "), F.lit("_")).alias("joined"), F.concat(F.trim(F.lit("  x ")), "p_type").alias("tagged"),
        F.reverse(n).alias("back"), F.lpad("p_type", 10, ".").alias("padded"), F.instr(n, " ").alias("gap"), F.split_part(n, F.lit(" "), F.lit(2)).alias("noun"), F.regexp_replace(n, "[aeiou]", "*").alias("masked"),
    )


@query("""SELECT s_suppkey, ABS(s_acctbal) AS size, CAST(CEIL(s_acctbal) AS BIGINT) AS up, CAST(FLOOR(s_acctbal) AS BIGINT) AS down, ROUND(SQRT(ABS(s_acctbal)), 6) AS root, CAST(SIGN(s_acctbal) AS DOUBLE) AS sgn,
 ROUND(LN(ABS(s_acctbal) + 1), 6) AS ln1, ROUND(POWER(s_acctbal / 1000, 2), 6) AS sq, CAST(s_suppkey % 7 AS BIGINT) AS m, GREATEST(s_acctbal, 0.0) AS pos, LEAST(s_acctbal, 0.0) AS neg, -s_acctbal AS flipped FROM supplier""")
def fn_math(s, d):
    b = F.col("s_acctbal")
    return table(s, d, "supplier").select(
        "s_suppkey", F.abs(b).alias("size"), F.ceil(b).alias("up"), F.floor(b).alias("down"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), F.signum(b).alias("sgn"), F.round(F.log(F.abs(b) + 1), 6).alias("ln1"),
        F.round(F.pow(b / 1000, 2), 6).alias("sq"), (F.col("s_suppkey") % 7).alias("m"), F.greatest(b, F.lit(0.0)).alias("pos"), F.least(b, F.lit(0.0)).alias("neg"), (-b).alias("flipped"),
    )


@query("""SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS INTEGER) AS q, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS mon, CAST(o_orderdate AS DATE) + 30 AS due,
 CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age, STRFTIME(o_orderdate, '%Y-%m') AS ym, CAST(DAYOFYEAR(o_orderdate) AS INTEGER) AS doy, LAST_DAY(CAST(o_orderdate AS DATE)) AS last FROM orders""")
def fn_date(s, d):
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select("o_orderkey", F.year(day).alias("y"), F.quarter(day).alias("q"), F.trunc(day, "month").alias("mon"), F.date_add(day, 30).alias("due"), F.datediff(F.lit("2002-01-01").cast("date"), day).alias("age"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.dayofyear(day).alias("doy"), F.last_day(day).alias("last"))


@query("SELECT s_suppkey, COALESCE(NULLIF(s_nationkey, 3), -1) AS nation, NULLIF(s_nationkey, 3) IS NULL AS missing, CASE WHEN NULLIF(s_nationkey, 3) IS NULL THEN 'none' ELSE s_name END AS label, NULLIF(s_nationkey, 3) IS DISTINCT FROM 4 AS other FROM supplier")
def fn_null(s, d):
    n = F.nullif(F.col("s_nationkey"), F.lit(3))
    return table(s, d, "supplier").select("s_suppkey", F.coalesce(n, F.lit(-1)).alias("nation"), n.isNull().alias("missing"), F.when(n.isNull(), "none").otherwise(F.col("s_name")).alias("label"), (~n.eqNullSafe(F.lit(4))).alias("other"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def fn_json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k > 50")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS head, CAST(embedding[64] AS DOUBLE) AS tail FROM embeddings")
def fn_array(s, d):
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.size(e).alias("n"), e[0].cast("double").alias("head"), F.element_at(e, -1).cast("double").alias("tail"))


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS DATE) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def events_tumbling(s, d):
    from ..streaming.events import windowed

    made = windowed(table(s, d, "events"), "1 day")
    return made.select(F.col("start").cast("date").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL '6 hours' OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT user_id, ts, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM m) SELECT user_id, COUNT(*) AS n FROM g GROUP BY user_id, part""")
def events_session(s, d):
    from ..streaming.events import sessions

    return sessions(table(s, d, "events"), "6 hours").select("user_id", "n")
