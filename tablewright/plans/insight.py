"""Queries that show profiles, features and trees as tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.features import encode, encoders, filter_features, infer_task
from tablewright.operators.preview import sample
from tablewright.operators.profile import nearest_ranks, profile
from tablewright.operators.tree import Tree, analyze, best_splits, grow, leaf_floor
from tablewright.sources.registry import ROW


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbers(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = profile(_read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_linenumber"))
    rows = [(c, s.count, s.null_count, s.unique_count, *(round(float(x), 6) for x in (s.min, s.max, s.mean, s.std, s.p25, s.p50, s.p75))) for c, s in found.items()]
    return _numbers(spark, rows, "name string, n long, nulls long, uniques long, low double, high double, mean double, std double, p25 double, p50 double, p75 double")


def profile_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = profile(_read(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return _numbers(spark, [(c, s.count, s.null_count, s.unique_count, s.min, s.max) for c, s in found.items()], "name string, n long, nulls long, uniques long, low string, high string")


def profile_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = profile(_read(spark, sf_dir, "orders").select("o_orderdate"))
    s = found["o_orderdate"]
    return _numbers(spark, [(s.count, s.unique_count, s.min[:19], s.max[:19], s.p50[:19])], "n long, uniques long, low string, high string, p50 string")


def profile_unique_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "events").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("t"))
    s = profile(frame)[0]["t"]
    return _numbers(spark, [(s.count, s.null_count, s.unique_count)], "n long, nulls long, uniques long")


def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = nearest_ranks(_read(spark, sf_dir, "orders"), ["o_totalprice"], marks)["o_totalprice"]
    return _numbers(spark, list(zip(marks, got)), "mark double, value double")


def derive_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.agent.toolkit import DataFrameToolkit

    kit = DataFrameToolkit()
    orders = kit.register_dataframe("orders", _read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"))
    first = kit.execute_sql(query=f"SELECT o_custkey, sum(o_totalprice) AS total FROM {orders.id} GROUP BY o_custkey", result_name="totals")
    second = kit.execute_sql(query=f"SELECT CAST(o_custkey AS BIGINT) AS o_custkey, round(total, 2) AS total FROM {first.id} WHERE total > 1000000", result_name="large")
    return kit.get_dataframe(second.id)


def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "part").withColumn("none", F.lit(None).cast("string")).withColumn("same", F.lit(1))
    columns = ["p_name", "p_brand", "p_type", "p_size", "none", "same", "p_partkey"]
    kept, excluded = filter_features(frame, columns)
    return _numbers(spark, [(c, c in kept, excluded.get(c, "")) for c in columns], "name string, kept boolean, reason string")


def encode_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))
    return encode(frame, encoders(frame, ["segment"])).select("c_custkey", F.col("x0").alias("code"))


def encode_epoch_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return encode(frame, encoders(frame, ["o_orderdate"])).select("o_orderkey", F.col("x0").alias("micros"))


def task_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "lineitem")
    return _numbers(spark, [(c, infer_task(frame, c)) for c in ("l_linenumber", "l_quantity", "l_returnflag", "l_orderkey")], "name string, task string")


def _gini_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'N', 'R')")
    return frame.select(F.col("l_quantity").alias("x0"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("x1"), F.lit(1).cast("long").alias("n"), *((F.col("l_returnflag") == c).cast("long").alias(f"c{k}") for k, c in enumerate("ANR")))


def _one_split(spark: SparkSession, rows: DataFrame, sums: list[str]) -> DataFrame:
    n = rows.count()
    found = best_splits(rows.withColumn("node", F.lit(1)), 2, sums, leaf_floor(n, 5), [1])[1]
    return _numbers(spark, [(found.feature, round(found.threshold, 6), found.missing_left, round(found.gain / n, 6))], "feature int, threshold double, missing_left boolean, gain double")


def cart_best_split_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_split(spark, _gini_rows(spark, sf_dir), ["c0", "c1", "c2"])


def _price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "lineitem")
    mean = frame.agg(F.avg("l_extendedprice")).first()[0]
    return frame.select(F.col("l_quantity").alias("x0"), F.col("l_discount").alias("x1"), F.lit(1).cast("long").alias("n"), (F.col("l_extendedprice") - mean).alias("c0"), F.col("l_extendedprice").alias("y"))


def cart_best_split_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _one_split(spark, _price_rows(spark, sf_dir), ["c0"])
    return found.select("feature", "threshold")


def leaf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _price_rows(spark, sf_dir)
    tree = Tree()
    tree.splits[1] = best_splits(rows.withColumn("node", F.lit(1)), 2, ["c0"], leaf_floor(rows.count(), 5), [1])[1]
    return rows.groupBy(tree.node().alias("node")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("mean"), F.round(F.stddev_pop("y"), 4).alias("std"))


def tree_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "lineitem").select("l_quantity", "l_linestatus", "l_shipdate")
    found = analyze(frame, ["l_quantity", "l_shipdate"], "l_linestatus", max_depth=1)
    return _numbers(spark, [(found.sample_count, found.leaf_count, round(found.metrics["accuracy"], 6))], "n long, leaves int, accuracy double")


def tree_r2_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(_read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), None, "l_extendedprice", max_depth=1)
    return _numbers(spark, [(round(found.metrics["r_squared"], 6), round(found.metrics["rmse"], 3))], "r_squared double, rmse double")


def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_acctbal", "n_name", "n_regionkey", "c_mktsegment")
    found = analyze(frame, None, "n_regionkey")
    return _numbers(spark, [(i, " and ".join(map(str, r.predicates)), str(r.prediction), r.samples) for i, r in enumerate(found.rules)], "leaf int, rule string, prediction string, samples long")


def tree_depth_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _price_rows(spark, sf_dir).persist()
    tree = grow(rows, 2, ["c0"], leaf_floor(rows.count(), 5), 6)
    found = rows.groupBy(tree.node().alias("node")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 2).alias("mean"))
    rows.unpersist()
    return found


def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _read(spark, sf_dir, "orders").select("o_orderkey").withColumn(ROW, F.monotonically_increasing_id())
    return sample(numbered, 25, seed=7).select("o_orderkey")


def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.agent.toolkit import DataFrameToolkit

    kit = DataFrameToolkit()
    nation = _read(spark, sf_dir, "nation")
    base = kit.register_dataframe("nation", nation)
    kit.execute_sql(query=f"SELECT n_regionkey, count(*) AS n FROM {base.id} GROUP BY n_regionkey", result_name="by_region")
    again = DataFrameToolkit.from_state(kit.export_state(), {"nation": nation})
    return again.get_dataframe("by_region")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_numeric, profile_string, profile_timestamp, profile_unique_with_null, percentile_nearest, derive_two_step, feature_filter, encode_ordinal, encode_epoch_micros, task_inference,
        cart_best_split_gini, cart_best_split_variance, leaf_stats, tree_accuracy, tree_r2_rmse, tree_rules, tree_depth_six, sample_exact_n, state_round_trip,
    )
}


def _numeric(table: str, column: str) -> str:
    parts = ", ".join(f"round(max(x) FILTER (WHERE i = floor((n - 1) * {p} + 0.5)), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return (
        f"SELECT '{column}' AS name, count(x) AS n, 0::BIGINT AS nulls, count(DISTINCT x) AS uniques, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, {parts} "
        f"FROM (SELECT {column}::DOUBLE AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n FROM {table})"
    )


_SPLIT = """
    g AS (SELECT f, v, sum(n) AS n, {sums} FROM long GROUP BY f, v),
    a AS (SELECT f, sum(n) AS an, {alls}, coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS mn, {nones} FROM g GROUP BY f),
    o AS (SELECT f, v, lead(v) OVER w AS nv, sum(n) OVER w AS ln, {runs} FROM g WHERE v IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY v)),
    c AS (SELECT o.f AS f, v + (nv - v) / 2 AS t, TRUE AS ml, ln + mn AS ln, an, {left_in} FROM o JOIN a ON o.f = a.f WHERE nv IS NOT NULL
          UNION ALL SELECT o.f, v + (nv - v) / 2, FALSE, ln, an, {left_out} FROM o JOIN a ON o.f = a.f WHERE nv IS NOT NULL AND mn > 0),
    s AS (SELECT f, t, ml, an, round({gain}, 9) AS gain FROM c WHERE ln >= greatest(5, floor(0.02 * an)) AND an - ln >= greatest(5, floor(0.02 * an))),
    best AS (SELECT * FROM s ORDER BY gain DESC, f, t, ml DESC LIMIT 1)"""


def _split(columns: list[str]) -> str:
    each = lambda text: ", ".join(text.format(c=c) for c in columns)
    gain = " + ".join(f"l{c} * l{c} / ln + (a{c} - l{c}) * (a{c} - l{c}) / (an - ln) - a{c} * a{c} / an" for c in columns)
    return _SPLIT.format(
        sums=each("sum({c})::DOUBLE AS {c}"), alls=each("sum({c}) AS a{c}"), nones=each("coalesce(sum({c}) FILTER (WHERE v IS NULL), 0) AS m{c}"), runs=each("sum({c}) OVER w AS l{c}"),
        left_in=each("l{c} + m{c} AS l{c}, a{c} AS a{c}"), left_out=each("l{c}, a{c}"), gain=gain,
    )


_PRICE_LONG = """p AS (SELECT l_quantity AS x0, l_discount AS x1, l_extendedprice - avg(l_extendedprice) OVER () AS c0, l_extendedprice AS y FROM lineitem),
    long AS (SELECT 0 AS f, x0 AS v, 1 AS n, c0 FROM p UNION ALL SELECT 1, x1, 1, c0 FROM p),"""


def price_split(rows: str) -> str:
    """The best split (f, t, ml, gain) of some rows of p, whose least leaf is a share of all of p."""
    text = _split(["c0"]).replace("floor(0.02 * an)", "floor(0.02 * (SELECT count(*) FROM p))")
    return f"WITH r AS (SELECT * FROM {rows}), long AS (SELECT 0 AS f, x0 AS v, 1 AS n, c0 FROM r UNION ALL SELECT 1, x1, 1, c0 FROM r),{text} SELECT f, t, ml, gain FROM best"


ORACLES: dict[str, str] = {
    "profile_numeric": " UNION ALL ".join(_numeric("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_linenumber")),
    "profile_string": " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS uniques, min({c}) AS low, max({c}) AS high FROM customer" for c in ("c_name", "c_mktsegment")),
    "profile_timestamp": "SELECT count(x) AS n, count(DISTINCT x) AS uniques, strftime(min(x), '%Y-%m-%d %H:%M:%S') AS low, strftime(max(x), '%Y-%m-%d %H:%M:%S') AS high, strftime(max(x) FILTER (WHERE i = floor((n - 1) * 0.5 + 0.5)), '%Y-%m-%d %H:%M:%S') AS p50 FROM (SELECT o_orderdate AS x, row_number() OVER (ORDER BY o_orderdate) - 1 AS i, count(*) OVER () AS n FROM orders)",
    "profile_unique_with_null": "SELECT count(t) AS n, count(*) - count(t) AS nulls, count(DISTINCT t) + max((t IS NULL)::BIGINT) AS uniques FROM (SELECT CASE WHEN event_type <> 'click' THEN event_type END AS t FROM events)",
    "percentile_nearest": "SELECT mark, max(x) FILTER (WHERE i = floor((n - 1) * mark + 0.5)) AS value FROM (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS mark) GROUP BY mark",
    "derive_two_step": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000",
    "feature_filter": "WITH n AS (SELECT count(*) AS n, count(DISTINCT p_name) AS a, count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t FROM part) SELECT 'p_name' AS name, a <= 0.9 * n AS kept, CASE WHEN a > 0.9 * n THEN 'over nine tenths of the rows have a label of their own' ELSE '' END AS reason FROM n UNION ALL SELECT 'p_brand', b <= 0.9 * n, CASE WHEN b > 0.9 * n THEN 'over nine tenths of the rows have a label of their own' ELSE '' END FROM n UNION ALL SELECT 'p_type', t <= 0.9 * n, CASE WHEN t > 0.9 * n THEN 'over nine tenths of the rows have a label of their own' ELSE '' END FROM n UNION ALL SELECT 'p_size', TRUE, '' UNION ALL SELECT 'none', FALSE, 'no value in any row' UNION ALL SELECT 'same', FALSE, 'the same in every row' UNION ALL SELECT 'p_partkey', TRUE, ''",
    "encode_ordinal": "WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS g FROM customer) SELECT c_custkey, (dense_rank() OVER (ORDER BY g NULLS LAST) - 1)::DOUBLE AS code FROM s",
    "encode_epoch_micros": "SELECT o_orderkey, epoch_us(o_orderdate)::DOUBLE AS micros FROM orders",
    "task_inference": " UNION ALL ".join(f"SELECT '{c}' AS name, CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) < 0.05 * count(*) THEN 'classification' ELSE 'regression' END AS task FROM lineitem" for c in ("l_linenumber", "l_orderkey")) + " UNION ALL SELECT 'l_quantity', 'regression' UNION ALL SELECT 'l_returnflag', 'classification'",
    "cart_best_split_gini": "WITH r AS (SELECT l_quantity AS x0, CASE WHEN l_linenumber <> 3 THEN l_discount END AS x1, (l_returnflag = 'A')::BIGINT AS c0, (l_returnflag = 'N')::BIGINT AS c1, (l_returnflag = 'R')::BIGINT AS c2 FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')), long AS (SELECT 0 AS f, x0 AS v, 1 AS n, c0, c1, c2 FROM r UNION ALL SELECT 1, x1, 1, c0, c1, c2 FROM r)," + _split(["c0", "c1", "c2"]) + " SELECT f AS feature, round(t, 6) AS threshold, ml AS missing_left, round(gain / an, 6) AS gain FROM best",
    "cart_best_split_variance": f"WITH {_PRICE_LONG}{_split(['c0'])} SELECT f AS feature, round(t, 6) AS threshold FROM best",
    "leaf_stats": f"WITH {_PRICE_LONG}{_split(['c0'])} SELECT CASE WHEN CASE WHEN f = 0 THEN x0 ELSE x1 END <= t THEN 2 ELSE 3 END AS node, count(*) AS n, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS std FROM p, best GROUP BY 1",
    "tree_accuracy": "WITH r AS (SELECT l_quantity AS x0, epoch_us(l_shipdate)::DOUBLE AS x1, (l_linestatus = 'F')::BIGINT AS c0, (l_linestatus = 'O')::BIGINT AS c1 FROM lineitem), long AS (SELECT 0 AS f, x0 AS v, 1 AS n, c0, c1 FROM r UNION ALL SELECT 1, x1, 1, c0, c1 FROM r)," + _split(["c0", "c1"]) + ", leaf AS (SELECT sum(c0) AS a, sum(c1) AS b FROM r LEFT JOIN best ON TRUE GROUP BY coalesce(CASE WHEN f = 0 THEN x0 ELSE x1 END <= t, TRUE)) SELECT sum(a + b)::BIGINT AS n, count(*)::INTEGER AS leaves, round(sum(greatest(a, b)) / sum(a + b), 6) AS accuracy FROM leaf",
    "tree_r2_rmse": "WITH p AS (SELECT l_quantity AS x0, l_extendedprice - avg(l_extendedprice) OVER () AS c0, l_extendedprice AS y FROM lineitem), long AS (SELECT 0 AS f, x0 AS v, 1 AS n, c0 FROM p)," + _split(["c0"]) + ", leaf AS (SELECT y, avg(y) OVER (PARTITION BY x0 <= t) AS m, avg(y) OVER () AS w FROM p, best) SELECT round(1 - sum((y - m) * (y - m)) / sum((y - w) * (y - w)), 6) AS r_squared, round(sqrt(avg((y - m) * (y - m))), 3) AS rmse FROM leaf",
    "state_round_trip": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey",
}
