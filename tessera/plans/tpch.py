"""The 22 decision-support queries, as SQL that Spark and DuckDB both run.

The tables at hand lack some columns and one table of the full schema; small
portable CTEs derive them (supply, ship mode, commit and receipt days) from
keys, the same way in both engines.  Money is summed in doubles and rounded to
cents at the end; columns keep their types up to the scan, so that filters are
pushed into it.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.worker import shared_dir
from ..sources.files import Files
from .tables import run_sql

LI = """li AS (SELECT l_orderkey ok, l_partkey pk, l_suppkey sk, l_linenumber ln, l_quantity qty, l_extendedprice price, l_discount disc, l_tax tax,
 l_extendedprice * (1 - l_discount) net, l_returnflag flag, l_linestatus status, l_shipdate ship,
 CAST((l_orderkey * 7 + l_linenumber * 3) % 61 AS INTEGER) commit_gap, CAST((l_orderkey * 5 + l_linenumber * 11) % 61 AS INTEGER) receipt_gap,
 CASE (l_orderkey * 5 + l_linenumber) % 7 WHEN 0 THEN 'MAIL' WHEN 1 THEN 'SHIP' WHEN 2 THEN 'AIR' WHEN 3 THEN 'REG AIR' WHEN 4 THEN 'RAIL' WHEN 5 THEN 'TRUCK' ELSE 'FOB' END mode,
 CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'DELIVER IN PERSON' WHEN 1 THEN 'COLLECT COD' WHEN 2 THEN 'NONE' ELSE 'TAKE BACK RETURN' END instruct
 FROM lineitem)"""
ORD = "od AS (SELECT o_orderkey ok, o_custkey ck, o_orderstatus ostatus, o_totalprice total, o_orderdate AS oday, o_orderpriority pri FROM orders)"
SUPPLY = """sup AS (SELECT pk, sk, (pk * 31 + sk * 17) % 9999 + 1 avail, CAST((pk * 7 + sk * 13) % 1000 + 1 AS DOUBLE) cost
 FROM (SELECT DISTINCT l_partkey pk, l_suppkey sk FROM lineitem) every_pair)"""


#: The supply pairs as a table of their own, see ``supply_table``.
STORED = "sup AS (SELECT pk, sk, avail, cost FROM supply_pairs)"
_PAIRS = SUPPLY[len("sup AS (") : -1]


def supply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (part, supplier) pairs with their derived columns, written once for a folder, ordered by part.

    The full schema has this table; here it is derived from ``lineitem`` when it is first asked for, as loading it would be.
    """
    path = f"{shared_dir(spark)}/supply-{hashlib.md5(os.path.realpath(sf_dir).encode()).hexdigest()[:12]}-{spark.sparkContext.applicationId}"
    files = Files(spark, path)
    if not files.exists("_SUCCESS"):
        run_sql(spark, sf_dir, _PAIRS).repartitionByRange("pk").sortWithinPartitions("pk", "sk").write.mode("overwrite").parquet(path)
    return spark.read.schema("pk long, sk long, avail long, cost double").parquet(path)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the queries; the supply pairs are read from their table instead of being derived in the query."""
    text = QUERIES[name]
    if SUPPLY in text:
        supply_table(spark, sf_dir).createOrReplaceTempView("supply_pairs")
        text = text.replace(SUPPLY, STORED)
    return run_sql(spark, sf_dir, text)


def money(x: str, digits: int = 4) -> str:
    """Sums of products of two cent values have four decimals: rounding to them hides the order of summation only."""
    return f"ROUND(CAST({x} AS DOUBLE), {digits})"


def build(*ctes: str, body: str) -> str:
    return (f"WITH {', '.join(ctes)} " if ctes else "") + " ".join(body.split())


QUERIES: dict[str, str] = {
    "tpch_q01": build(LI, body=f"""
        SELECT flag, status, {money('SUM(qty)')} AS sum_qty, {money('SUM(price)')} AS sum_price, {money('SUM(net)')} AS sum_net,
          {money('SUM(net * (1 + tax))', 2)} AS sum_charge, ROUND(CAST(SUM(qty) AS DOUBLE) / COUNT(*), 6) AS avg_qty,
          ROUND(CAST(SUM(price) AS DOUBLE) / COUNT(*), 6) AS avg_price, ROUND(CAST(SUM(disc) AS DOUBLE) / COUNT(*), 6) AS avg_disc, COUNT(*) AS n
        FROM li WHERE ship <= DATE '2001-08-01' GROUP BY flag, status ORDER BY flag, status"""),
    "tpch_q02": build(SUPPLY, body="""
        SELECT CAST(s_acctbal AS DOUBLE) AS balance, s_name, n_name, p_partkey, p_brand, CAST(cost AS DOUBLE) AS cost
        FROM part, sup, supplier, nation, region
        WHERE p_partkey = pk AND s_suppkey = sk AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND p_size <= 25 AND p_type LIKE '%M%' AND r_name = 'ASIA'
          AND cost = (SELECT MIN(c2.cost) FROM sup c2, supplier s2, nation n2, region r2
            WHERE c2.pk = p_partkey AND s2.s_suppkey = c2.sk AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'ASIA')
        ORDER BY balance DESC, n_name, s_name, p_partkey LIMIT 100"""),
    "tpch_q03": build(LI, ORD, body=f"""
        SELECT od.ok AS orderkey, {money('SUM(net)')} AS revenue, CAST(od.oday AS DATE) AS order_day
        FROM customer JOIN od ON c_custkey = ck JOIN li ON li.ok = od.ok
        WHERE c_mktsegment = 'BUILDING' AND od.oday < DATE '1998-03-15' AND ship > DATE '1998-03-15'
        GROUP BY od.ok, od.oday ORDER BY revenue DESC, orderkey LIMIT 10"""),
    "tpch_q04": build(LI, ORD, body="""
        SELECT pri AS priority, COUNT(*) AS n_orders FROM od
        WHERE oday >= DATE '1997-07-01' AND oday < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM li WHERE li.ok = od.ok AND commit_gap < receipt_gap)
        GROUP BY pri ORDER BY priority"""),
    "tpch_q05": build(LI, ORD, body=f"""
        SELECT n_name, {money('SUM(net)')} AS revenue
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN li ON sk = s_suppkey JOIN od ON od.ok = li.ok
          JOIN customer ON c_custkey = ck AND c_nationkey = s_nationkey
        WHERE r_name = 'ASIA' AND oday >= DATE '1997-01-01' AND oday < DATE '1999-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name"""),
    "tpch_q06": build(LI, body=f"""
        SELECT {money('SUM(price * disc)')} AS revenue FROM li
        WHERE ship >= DATE '1997-01-01' AND ship < DATE '1998-01-01' AND disc BETWEEN 0.05 AND 0.07 AND qty < 24"""),
    "tpch_q07": build(LI, ORD, body=f"""
        SELECT from_nation, to_nation, yr, {money('SUM(net)')} AS volume FROM (
          SELECT a.n_name AS from_nation, b.n_name AS to_nation, CAST(EXTRACT(YEAR FROM ship) AS BIGINT) AS yr, net
          FROM li JOIN supplier ON s_suppkey = sk JOIN od ON od.ok = li.ok JOIN customer ON c_custkey = ck JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
          WHERE ((a.n_regionkey = 1 AND b.n_regionkey = 2) OR (a.n_regionkey = 2 AND b.n_regionkey = 1)) AND ship BETWEEN DATE '1997-01-01' AND DATE '1998-12-31') moved
        GROUP BY from_nation, to_nation, yr ORDER BY from_nation, to_nation, yr"""),
    "tpch_q08": build(LI, ORD, body="""
        SELECT yr, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_3' THEN net ELSE 0.0 END) AS DOUBLE) / CAST(SUM(net) AS DOUBLE), 6) AS share FROM (
          SELECT CAST(EXTRACT(YEAR FROM oday) AS BIGINT) AS yr, net, s.n_name AS nation
          FROM part JOIN li ON pk = p_partkey JOIN supplier ON s_suppkey = sk JOIN od ON od.ok = li.ok JOIN customer ON c_custkey = ck
            JOIN nation c ON c.n_nationkey = c_nationkey JOIN region ON r_regionkey = c.n_regionkey JOIN nation s ON s.n_nationkey = s_nationkey
          WHERE r_name IN ('ASIA', 'EUROPE') AND oday BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND p_type = 'ECONOMY') sold
        GROUP BY yr ORDER BY yr"""),
    "tpch_q09": build(LI, ORD, SUPPLY, body=f"""
        SELECT nation, yr, {money('SUM(gain)')} AS profit FROM (
          SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM oday) AS BIGINT) AS yr, net - cost * qty AS gain
          FROM part JOIN li ON p_partkey = li.pk JOIN sup ON sup.pk = li.pk AND sup.sk = li.sk JOIN supplier ON s_suppkey = li.sk JOIN od ON od.ok = li.ok JOIN nation ON n_nationkey = s_nationkey
          WHERE p_name LIKE '%ring%') made
        GROUP BY nation, yr ORDER BY nation, yr DESC"""),
    "tpch_q10": build(LI, ORD, body=f"""
        SELECT c_custkey, c_name, {money('SUM(net)')} AS revenue, CAST(c_acctbal AS DOUBLE) AS balance, n_name
        FROM customer JOIN od ON ck = c_custkey JOIN li ON li.ok = od.ok JOIN nation ON n_nationkey = c_nationkey
        WHERE oday >= DATE '1997-10-01' AND oday < DATE '1998-01-01' AND flag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""),
    "tpch_q11": build(SUPPLY, body=f"""
        SELECT pk AS partkey, {money('SUM(cost * avail)')} AS value FROM sup JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1
        GROUP BY pk HAVING SUM(cost * avail) > (SELECT SUM(cost * avail) * 0.0001 FROM sup JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1) ORDER BY value DESC, partkey"""),
    "tpch_q12": build(LI, ORD, body="""
        SELECT mode, CAST(SUM(CASE WHEN pri LIKE '1-%' OR pri LIKE '2-%' THEN 1 ELSE 0 END) AS BIGINT) AS urgent, CAST(SUM(CASE WHEN pri NOT LIKE '1-%' AND pri NOT LIKE '2-%' THEN 1 ELSE 0 END) AS BIGINT) AS other
        FROM od JOIN li ON li.ok = od.ok
        WHERE mode IN ('MAIL', 'SHIP') AND commit_gap < receipt_gap AND commit_gap > 10 AND ship >= DATE '1997-01-01' AND ship < DATE '1998-01-01' GROUP BY mode ORDER BY mode"""),
    "tpch_q13": build(ORD, body="""
        SELECT n_orders, COUNT(*) AS n_customers FROM (
          SELECT c_custkey, COUNT(ok) AS n_orders FROM customer LEFT JOIN od ON ck = c_custkey AND pri NOT LIKE '1-%' GROUP BY c_custkey) per_customer
        GROUP BY n_orders ORDER BY n_customers DESC, n_orders DESC"""),
    "tpch_q14": build(LI, body="""
        SELECT ROUND(100.0 * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN net ELSE 0.0 END) AS DOUBLE) / CAST(SUM(net) AS DOUBLE), 6) AS promo_share
        FROM li JOIN part ON p_partkey = pk WHERE ship >= DATE '1997-09-01' AND ship < DATE '1997-10-01'"""),
    "tpch_q15": build(LI, "rev AS (SELECT sk, ROUND(SUM(net), 4) AS earned FROM li WHERE ship >= DATE '1997-01-01' AND ship < DATE '1997-04-01' GROUP BY sk)", body=f"""
        SELECT s_suppkey, s_name, {money('earned')} AS earned FROM supplier JOIN rev ON sk = s_suppkey WHERE earned = (SELECT MAX(earned) FROM rev) ORDER BY s_suppkey"""),
    "tpch_q16": build(SUPPLY, body="""
        SELECT p_brand, p_type, p_size, COUNT(DISTINCT sk) AS n_suppliers FROM sup JOIN part ON p_partkey = pk
        WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND sk NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY n_suppliers DESC, p_brand, p_type, p_size"""),
    "tpch_q17": build(LI, body="""
        SELECT ROUND(CAST(SUM(price) AS DOUBLE) / 7.0, 2) AS yearly FROM li JOIN part ON p_partkey = pk
        WHERE p_brand = 'Brand#23' AND p_size < 30 AND qty < (SELECT 0.4 * CAST(SUM(i.qty) AS DOUBLE) / COUNT(*) FROM li i WHERE i.pk = p_partkey)"""),
    "tpch_q18": build(LI, ORD, body=f"""
        SELECT c_name, c_custkey, od.ok AS orderkey, CAST(oday AS DATE) AS order_day, CAST(total AS DOUBLE) AS total, {money('SUM(qty)')} AS units
        FROM customer JOIN od ON ck = c_custkey JOIN li ON li.ok = od.ok
        WHERE od.ok IN (SELECT ok FROM li GROUP BY ok HAVING SUM(qty) > 300)
        GROUP BY c_name, c_custkey, od.ok, oday, total ORDER BY total DESC, orderkey LIMIT 100"""),
    "tpch_q19": build(LI, body=f"""
        SELECT {money('SUM(net)')} AS revenue FROM li JOIN part ON p_partkey = pk
        WHERE (p_brand = 'Brand#12' AND qty BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 15 AND mode IN ('AIR', 'REG AIR') AND instruct = 'DELIVER IN PERSON')
           OR (p_brand = 'Brand#23' AND qty BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 30 AND mode IN ('AIR', 'REG AIR') AND instruct = 'DELIVER IN PERSON')
           OR (p_brand = 'Brand#4' AND qty BETWEEN 20 AND 45 AND p_size BETWEEN 1 AND 45 AND mode IN ('AIR', 'REG AIR') AND instruct = 'DELIVER IN PERSON')"""),
    "tpch_q20": build(LI, SUPPLY, body="""
        SELECT s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
        WHERE n_regionkey = 2 AND s_suppkey IN (SELECT sk FROM sup WHERE pk IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
          AND avail > (SELECT 0.5 * CAST(SUM(i.qty) AS DOUBLE) FROM li i WHERE i.pk = sup.pk AND i.sk = sup.sk AND i.ship >= DATE '1996-01-01' AND i.ship < DATE '2000-01-01')) ORDER BY s_name"""),
    "tpch_q21": build(LI, ORD, body="""
        SELECT s_name, COUNT(*) AS waits FROM supplier JOIN li a ON a.sk = s_suppkey JOIN od ON od.ok = a.ok JOIN nation ON n_nationkey = s_nationkey
        WHERE ostatus = 'F' AND a.receipt_gap > a.commit_gap AND n_regionkey = 3
          AND EXISTS (SELECT 1 FROM li b WHERE b.ok = a.ok AND b.sk <> a.sk) AND NOT EXISTS (SELECT 1 FROM li c WHERE c.ok = a.ok AND c.sk <> a.sk AND c.receipt_gap > c.commit_gap)
        GROUP BY s_name ORDER BY waits DESC, s_name LIMIT 100"""),
    "tpch_q22": build(body="""
        SELECT code, COUNT(*) AS n_customers, ROUND(CAST(SUM(bal) AS DOUBLE), 2) AS balance FROM (
          SELECT SUBSTRING(c_name, CAST(LENGTH(c_name) AS INTEGER) - 1, 2) AS code, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer
          WHERE CAST(SUBSTRING(c_name, CAST(LENGTH(c_name) AS INTEGER) - 1, 2) AS INTEGER) IN (11, 19, 24, 28, 35, 42, 57)
            AND c_acctbal > (SELECT CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) FROM customer WHERE c_acctbal > 0.00)
            AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < TIMESTAMP '1995-06-01 00:00:00')) idle
        GROUP BY code ORDER BY code"""),
}
