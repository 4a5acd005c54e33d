"""The analytical statements of an observed workload, as Spark SQL over the driver's tables.

One text serves both engines: {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators import order

REVENUE = "l_extendedprice * (1 - l_discount)"
# Regions, nations and suppliers as one tree of categories; what a supplier sells is in its category.
TREE = """categories AS (
    SELECT r_regionkey AS id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM {region}
    UNION ALL SELECT 100 + n_nationkey, CAST(n_regionkey AS BIGINT), n_name FROM {nation}
    UNION ALL SELECT 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), s_name FROM {supplier}
), tree AS (
    SELECT id, id AS root_id, 0 AS depth, CAST(name AS VARCHAR(400)) AS path FROM categories WHERE parent_id IS NULL
    UNION ALL
    SELECT c.id, t.root_id, t.depth + 1, CAST(concat(t.path, ' > ', c.name) AS VARCHAR(400)) FROM categories c JOIN tree t ON c.parent_id = t.id
)"""

STATEMENTS = {
    "olap1_tree_revenue": f"""WITH RECURSIVE {TREE}, sold AS (
        SELECT l_suppkey, date_trunc('month', o_orderdate) AS month, sum(CAST({REVENUE} AS DECIMAL(18, 4))) AS revenue
        FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2
    ), per AS (
        SELECT r.name, s.month, sum(s.revenue) AS revenue FROM sold s JOIN tree t ON t.id = 1000 + s.l_suppkey JOIN categories r ON r.id = t.root_id GROUP BY r.name, s.month
    ) SELECT name AS root_category, CAST(CAST(month AS DATE) AS VARCHAR(10)) AS month, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (PARTITION BY name ORDER BY month) AS DOUBLE) AS running FROM per""",
    "olap2_spend_quintiles": f"""WITH spend AS (SELECT o_custkey, count(*) AS orders, sum({REVENUE}) AS monetary FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey GROUP BY o_custkey),
    tiled AS (SELECT *, ntile(5) OVER (ORDER BY monetary, o_custkey) AS quintile FROM spend)
    SELECT quintile, count(*) AS customers, round(avg(orders), 4) AS avg_orders, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY monetary), 2) AS median_spend,
        round(percentile_cont(0.95) WITHIN GROUP (ORDER BY monetary), 2) AS p95_spend FROM tiled GROUP BY quintile""",
    "olap3_grouping_sets": """SELECT n_name, c_mktsegment, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey
    GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), (c_mktsegment), ())""",
    "olap4_top_per_region": """SELECT r.r_name, t.c_name, t.c_acctbal FROM {region} r CROSS JOIN LATERAL (
        SELECT c_name, c_acctbal FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = r.r_regionkey
        ORDER BY c_acctbal DESC, c_name LIMIT 3
    ) t""",
    "olap5_above_average": """WITH x AS (
        SELECT c_custkey, n_name, c_acctbal, avg(c_acctbal) OVER (PARTITION BY n_name) AS mean FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
    ) SELECT c_custkey, n_name, c_acctbal, round(mean, 4) AS mean FROM x WHERE c_acctbal > mean ORDER BY c_acctbal DESC, c_custkey LIMIT 50""",
    "olap6_tree_paths": f"""WITH RECURSIVE {TREE}, sold AS (SELECT l_suppkey, count(*) AS lines FROM {{lineitem}} GROUP BY l_suppkey)
    SELECT t.depth, t.path, CAST(coalesce(sum(s.lines), 0) AS BIGINT) AS products FROM tree t LEFT JOIN sold s ON 1000 + s.l_suppkey = t.id GROUP BY t.depth, t.path""",
    "olap7_order_gaps": """WITH x AS (
        SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}
    ) SELECT o_custkey, count(*) FILTER (WHERE prev IS NOT NULL) AS gaps, max(datediff('day', prev, o_orderdate)) AS longest FROM x GROUP BY o_custkey""",
    "olap8_cube": """SELECT o_orderstatus, c_mktsegment, count(*) AS orders, round(avg(o_totalprice), 4) AS mean
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY CUBE (o_orderstatus, c_mktsegment)""",
    "olap9_monthly_rank": """WITH m AS (
        SELECT date_trunc('month', o_orderdate) AS month, c_mktsegment, sum(o_totalprice) AS total, count(DISTINCT o_custkey) AS customers
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2
    ), r AS (
        SELECT *, rank() OVER (PARTITION BY month ORDER BY total DESC) AS place, lag(total) OVER (PARTITION BY c_mktsegment ORDER BY month) AS prev FROM m
    ) SELECT CAST(CAST(month AS DATE) AS VARCHAR(10)) AS month, c_mktsegment, customers, round(total, 2) AS total, place, round(total / prev, 6) AS growth FROM r""",
}


def spend_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """olap2 without a window over all customers: tiles and percentiles come from global ranks."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    spend = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.expr(f"sum({REVENUE})").alias("monetary"))
    tiled = order.ntile(spend, 5, F.col("monetary"), F.col("o_custkey")).withColumnRenamed("tile", "quintile")
    per = tiled.groupBy("quintile").agg(F.count("*").alias("customers"), F.round(F.avg("orders"), 4).alias("avg_orders"))
    spread = order.interpolated_percentiles(tiled, "monetary", {"median_spend": 0.5, "p95_spend": 0.95}, "quintile")
    return per.join(spread, "quintile").withColumns({c: F.round(c, 2) for c in ("median_spend", "p95_spend")})


#: Statements that have a form of their own here.
FRAMES = {"olap2_spend_quintiles": spend_quintiles}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in FRAMES:
        return FRAMES[name](spark, sf_dir)
    text = STATEMENTS[name].replace("datediff('day', prev, o_orderdate)", "datediff(o_orderdate, prev)")
    tables = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def oracle(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", STATEMENTS[name])
