"""Relational queries that the toolkit must answer, as text that Spark and standard SQL share.

Where the two dialects differ, ``SPARK`` has Spark's text for a key and ``STANDARD`` the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans.guard import check_commands, check_tables
from tablewright.plans.walk import parse
from tablewright.sources.registry import SQL_SETTINGS, settings

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SHARED: dict[str, str] = {
    "project_columns": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "project_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_quantity * 2 + 1, 2) AS twice, l_linenumber % 3 AS rest FROM lineitem",
    "project_star": "SELECT * FROM nation",
    "filter_compare": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderkey <> 7 AND o_custkey < 1000",
    "filter_and_or": "SELECT p_partkey, p_size FROM part WHERE (p_size > 40 OR p_brand = 'Brand#11') AND NOT (p_size = 45)",
    "filter_like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%S%' AND p_name NOT LIKE 'x%'",
    "filter_in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12",
    "filter_null": "SELECT e.event_id, c.c_custkey FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 9000 WHERE c.c_custkey IS NULL",
    "filter_not_null": "SELECT event_id, event_type FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL",
    "filter_date": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'",
    "filter_literals": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5e5 AND o_orderkey > -1",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "quoted_identifiers": 'SELECT "n_name" AS "nation name" FROM "nation"',
    "comments_and_case": "select /* a comment */ R_NAME AS r_name -- and another\n from region",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_filter": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 100000",
    "join_using": "SELECT o_orderkey, n FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) t USING (o_orderkey)",
    "join_multiway": "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000",
    "join_right": "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "join_full": "SELECT c.c_custkey AS customer_key, s.s_suppkey AS supplier_key FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 40",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
    "join_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "join_anti_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "join_theta": "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)",
    "correlated_scalar": "SELECT c.c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c",
    "derived_table": "SELECT c_mktsegment, max(n) AS most FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY c_mktsegment",
    "cte_single": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus",
    "cte_multi": "WITH c AS (SELECT c_custkey, c_nationkey FROM customer), n AS (SELECT n_nationkey, n_name FROM nation) SELECT n.n_name, count(*) AS n FROM c JOIN n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "cte_recursive": "WITH RECURSIVE r(k) AS (SELECT 0 UNION ALL SELECT k + 1 FROM r WHERE k < 4) SELECT r.k AS k, r_name FROM r JOIN region ON r_regionkey = r.k",
    "agg_group_sum": "SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag",
    "agg_multi": "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global_count": "SELECT count(*) AS n, count(value) AS with_value FROM events",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_approx_distinct": "SELECT event_type, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type",
    "agg_stddev": "SELECT event_type, round(stddev_samp(value), 6) AS deviation, round(var_pop(value), 4) AS variance FROM events GROUP BY event_type",
    "win_sum_partition": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders",
    "win_row_number": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders",
    "win_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS dense FROM part",
    "win_lag": "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events",
    "win_rows_frame": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events",
    "win_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM orders",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ntile": "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter FROM supplier",
    "order_by": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 10",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 6000",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substr(p_type, 2, 4) AS s, replace(p_brand, '#', '-') AS r, trim(concat(' ', p_name, ' ')) AS t, CAST(length(p_name) AS BIGINT) AS n FROM part",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders",
    "fn_math": "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) < 0.02 AS near, round(sqrt(l_extendedprice), 6) AS root, CAST(floor(l_extendedprice) AS BIGINT) AS low, CAST(ceil(l_extendedprice) AS BIGINT) AS high, round(ln(l_quantity), 6) AS logarithm, round(power(l_quantity, 2), 2) AS square FROM lineitem",
    "fn_null": "SELECT event_id, coalesce(value, 0.0) AS v, nullif(event_type, 'click') AS t, greatest(event_id, user_id) AS g, least(event_id, user_id) AS s FROM events",
}

SPARK: dict[str, str] = {
    "fn_array": "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS head, label FROM embeddings",
    "fn_json": "SELECT event_id, get_json_object(props, '$.k') AS k, props IS NOT NULL AS has_props FROM events",
    "fn_date_trunc": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS month, count(*) AS n, min(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE))) AS days FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "fn_regexp": "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, split(p_type, ' ')[0] AS first_word FROM part",
    "fn_map": "SELECT o_orderpriority, CAST(size(map_keys(map_from_entries(collect_set(struct(o_orderstatus, 1))))) AS BIGINT) AS states FROM orders GROUP BY o_orderpriority",
    "fn_explode": "SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(x AS DOUBLE), 5) + 0.0D AS x FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x",
    "fn_higher_order": "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x), 4) AS squares FROM embeddings",
}
STANDARD: dict[str, str] = {
    "fn_array": "SELECT vec_id, len(embedding)::BIGINT AS n, round(embedding[1]::DOUBLE, 5) AS head, label FROM embeddings",
    "fn_json": "SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS has_props FROM events",
    "fn_date_trunc": "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, count(*) AS n, min(date_diff('day', o_orderdate::DATE, DATE '2000-01-01'))::INTEGER AS days FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "fn_regexp": "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, string_split(p_type, ' ')[1] AS first_word FROM part",
    "fn_map": "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_orderpriority",
    "fn_explode": "SELECT vec_id, i::BIGINT AS pos, round(embedding[i + 1]::DOUBLE, 5) + 0.0 AS x FROM embeddings, range(len(embedding)) t(i)",
    "fn_higher_order": "SELECT vec_id, round(list_sum([x::DOUBLE * x for x in embedding]), 4) AS squares FROM embeddings",
}


def answer(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """A query over the tables of a folder, checked as the toolkit checks it; only the tables it names are opened."""
    plan = parse(spark, query)
    check_commands(plan)
    used = check_tables(plan, TABLES)
    for name in used:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    with settings(spark, SQL_SETTINGS):
        return spark.sql(query)
