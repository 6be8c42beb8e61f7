"""Queries that show refusals, previews, restoration and rules as tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.rules import DecisionTreeResult
from tablewright.operators.features import encode, encoders, kind_of
from tablewright.operators.preview import preview
from tablewright.operators.tree import analyze
from tablewright.plans.errors import QueryError
from tablewright.plans.guard import validate
from tablewright.plans.insight import price_split
from tablewright.sources.registry import Snapshot

KNOWN = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_name", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"]}

#: A query and what the guard must say of it: the kind of error, or the tables that it reads.
VERDICTS: list[tuple[str, str]] = [
    ("SELECT o_orderkey FROM orders", "orders"),
    ("SELECT c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "orders, customer"),
    ("SELECT o_orderkey AS k FROM orders UNION SELECT c_custkey FROM customer", "orders, customer"),
    ("WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k FROM t", "orders"),
    ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", "customer, orders"),
    ("SELEC o_orderkey FROM orders", "SQLSyntaxError"),
    ("SELECT o_orderkey FROM orders WHERE", "SQLSyntaxError"),
    ("SELECT k FROM (SELECT o_custkey AS k FROM orders GROUP) t", "SQLSyntaxError"),
    ('SELECT "where".o_orderkey FROM orders AS "where" WHERE "where".o_custkey > 1', "orders"),
    ("", "SQLSyntaxError"),
    ("DROP TABLE orders", "SQLBlacklistedCommand"),
    ("DELETE FROM orders", "SQLBlacklistedCommand"),
    ("INSERT INTO orders VALUES (1, 2, 3)", "SQLBlacklistedCommand"),
    ("UPDATE orders SET o_custkey = 1", "SQLBlacklistedCommand"),
    ("CREATE TABLE t AS SELECT * FROM orders", "SQLBlacklistedCommand"),
    ("TRUNCATE TABLE orders", "SQLBlacklistedCommand"),
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM orders", "SQLBlacklistedCommand"),
    ("SELECT k FROM (SELECT reflect('java.lang.System', 'nanoTime') AS k FROM orders) t", "SQLBlacklistedCommand"),
    ("SELECT input_file_name() FROM orders", "SQLBlacklistedCommand"),
    ("SELECT 1 AS one", "SQLTableError"),
    ("SELECT x FROM missing", "SQLTableError"),
    ("SELECT x FROM orders JOIN missing ON TRUE", "SQLTableError"),
    ("DROP TABLE missing", "SQLBlacklistedCommand"),
    ("SELECT missing FROM orders", "SQLColumnError"),
    ("SELECT o.missing FROM orders o", "SQLColumnError"),
    ("SELECT missing FROM nothing", "SQLTableError"),
    ("SELECT k FROM (SELECT o_custkey AS j FROM orders) t", "SQLColumnError"),
    ("SELECT a.c_custkey FROM customer a JOIN customer b ON c_custkey = b.c_custkey", "SQLColumnError"),
]

#: A query and all that is wrong with its columns, by their names.
COLUMN_FAULTS: list[tuple[str, str]] = [
    ("SELECT one, o_orderkey, two FROM orders WHERE three > 1", "one, three, two"),
    ("SELECT o.one, c.two FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "c.two, o.one"),
    ("WITH t AS (SELECT o_custkey AS k FROM orders) SELECT k, one FROM t", "one"),
    ("SELECT t.k, t.one, two FROM (SELECT o_custkey AS k FROM orders) t", "t.one, two"),
    ("SELECT c_name FROM customer WHERE c_custkey IN (SELECT one FROM orders)", "one"),
    ("SELECT c_nationkey AS k FROM customer ORDER BY k", ""),
]

#: A query, and the line, column and text at which the parser stops.
SYNTAX: list[tuple[str, int, int, str]] = [
    ("SELEC o_orderkey FROM orders", 1, 1, "SELEC"),
    ("SELECT o_orderkey\nFROM orders\nWHERE AND o_custkey = 1", 3, 11, "o_custkey"),
    ("SELECT (o_orderkey FROM orders", 1, 20, "FROM"),
    ("SELECT o_orderkey\nFROM orders WHERE", 2, 13, "WHERE"),
]

TYPES: list[tuple[str, str]] = [
    ("tinyint", "numeric"), ("bigint", "numeric"), ("double", "numeric"), ("decimal(38,4)", "numeric"), ("boolean", "boolean"), ("string", "categorical"), ("date", "datetime"), ("timestamp", "datetime"), ("timestamp_ntz", "datetime"),
    ("interval day to second", "duration"), ("binary", "excluded"), ("array<int>", "excluded"), ("map<string,int>", "excluded"), ("struct<a:int>", "excluded"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _verdict(spark: SparkSession, query: str, **about: object) -> str:
    try:
        return ", ".join(validate(spark, query, KNOWN, **about))
    except QueryError as error:
        return error.kind


def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(q, _verdict(spark, q)) for q, _ in VERDICTS], "query string, verdict string")


def guard_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "SELECT o_orderkey FROM orders"
    return spark.createDataFrame([(", ".join(x), _verdict(spark, query, blacklist=x)) for x in ([], ["DROP"], ["select"], ["SELECT", "SHOW"])], "blacklist string, verdict string")


def guard_column_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for query, _ in COLUMN_FAULTS:
        try:
            validate(spark, query, KNOWN)
            rows.append((query, ""))
        except QueryError as error:
            rows.append((query, ", ".join(sorted(x.split("'")[1] for x in error.details["errors"]))))
    return spark.createDataFrame(rows, "query string, faults string")


def guard_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for query, *_ in SYNTAX:
        try:
            validate(spark, query, KNOWN)
        except QueryError as error:
            told = error.details["errors"][0]
            rows.append((query, told["line"], told["col"], told["highlight"], told["start_context"] + told["highlight"] + told["end_context"] == query))
    return spark.createDataFrame(rows, "query string, line int, col int, highlight string, whole boolean")


def feature_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(name, kind_of(spark.range(0).select(F.lit(None).cast(name).alias("x")).schema["x"].dataType)) for name, _ in TYPES]
    return spark.createDataFrame(kinds, "dtype string, kind string")


def encode_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderdate - TIMESTAMP_NTZ '1995-01-01 00:00:00'").alias("age"))
    return encode(frame, encoders(frame, ["age"])).select("o_orderkey", F.col("x0").alias("micros"))


def preview_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Snapshot(_read(spark, sf_dir, "nation").orderBy("n_nationkey"))
    try:
        lines = preview(table, ["n_nationkey", "n_name"], 5).split("\n")
    finally:
        table.release()
    return spark.createDataFrame(list(enumerate(lines)), "line int, shown string")


def preview_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Snapshot(_read(spark, sf_dir, "orders").select("o_orderkey"))
    try:
        drawn = [int(x.strip("| ")) for x in preview(table, None, 25, sampled=True, seed=7).split("\n")[2:]]
        again = [int(x.strip("| ")) for x in preview(table, None, 25, sampled=True, seed=7).split("\n")[2:]]
        members = table.frame.where(F.col("o_orderkey").isin(drawn)).count()
    finally:
        table.release()
    return spark.createDataFrame([(len(drawn), len(set(drawn)), members, drawn == again)], "n long, different long, members long, repeatable boolean")


def restore_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tablewright.agent.toolkit import DataFrameToolkit

    region = _read(spark, sf_dir, "region")
    kit = DataFrameToolkit()
    base = kit.register_dataframe("region", region)
    kit.execute_sql(query=f"SELECT count(*) AS n FROM {base.id}", result_name="counted")
    state = kit.export_state()
    doubled = region.unionAll(region)
    cases = {
        "same": {"region": region}, "by id": {base.id: region}, "none given": {}, "unknown name": {"region": region, "nation": region}, "given twice": {"region": region, base.id: region},
        "other rows": {"region": doubled}, "other columns": {"region": region.withColumnRenamed("r_name", "name")}, "other values": {"region": region.withColumn("r_name", F.upper(F.concat("r_name", F.lit("x"))))},
    }
    rows = []
    for name, given in cases.items():
        try:
            rows.append((name, len(DataFrameToolkit.from_state(state, given).references)))
        except ValueError:
            rows.append((name, None))
    return spark.createDataFrame(rows, "given string, restored int")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with nulls in a text and in a number."""
    some = F.col("c_custkey") % 7 != 0
    return _read(spark, sf_dir, "customer").select("c_nationkey", F.when(some, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))


def tree_rules_part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row, missing values included, fits one rule, and every rule as many rows as it says."""
    frame = _segments(spark, sf_dir)
    found = analyze(frame, ["segment", "balance"], "c_nationkey", task="regression", max_depth=3)
    fits = []
    for r in found.rules:
        test = F.lit(True)
        for p in r.predicates:
            test = test & p.column(frame.schema[p.variable].dataType)
        fits.append(test.cast("int"))
    counts = frame.agg(F.count(F.lit(1)).alias("n"), F.sum((sum(fits[1:], fits[0]) == 1).cast("long")).alias("in_one"), *(F.sum(x).alias(f"r{i}") for i, x in enumerate(fits))).first()
    agreeing = all(counts[f"r{i}"] == r.samples for i, r in enumerate(found.rules))
    return spark.createDataFrame([(counts["n"], counts["in_one"], agreeing)], "n long, in_one_rule long, sizes_agree boolean")


def _price_tree(spark: SparkSession, sf_dir: str) -> DecisionTreeResult:
    frame = _read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    return analyze(frame, ["l_quantity", "l_discount"], "l_extendedprice", max_depth=2)


def tree_depth_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _price_tree(spark, sf_dir)
    return spark.createDataFrame([(r.samples, round(r.prediction, 2), round(r.std, 2)) for r in found.rules], "samples long, prediction double, std double")


def tree_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _price_tree(spark, sf_dir)
    return spark.createDataFrame([(k, round(v, 3)) for k, v in found.feature_importances.items()], "feature string, share double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        guard_verdicts, guard_blacklist, guard_column_faults, guard_syntax, feature_kinds, encode_duration, preview_markdown, preview_sample_size, restore_refusals, tree_rules_part_rows, tree_depth_two, tree_importances,
    )
}


def _literal(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({names})"


#: Two levels of splits over prices: best1 at the root, best2 and best3 below it, each row's leaf in placed.
_TWO_LEVELS = f"""
    WITH p AS (SELECT l_quantity AS x0, l_discount AS x1, l_extendedprice - avg(l_extendedprice) OVER () AS c0, l_extendedprice AS y FROM lineitem),
    best1 AS ({price_split("p")}),
    q AS (SELECT p.*, CASE WHEN CASE WHEN f = 0 THEN x0 ELSE x1 END <= t THEN 2 ELSE 3 END AS node FROM p, best1),
    best2 AS ({price_split("q WHERE node = 2")}),
    best3 AS ({price_split("q WHERE node = 3")}),
    below AS (SELECT 2 AS node, * FROM best2 UNION ALL SELECT 3, * FROM best3),
    placed AS (SELECT q.*, CASE WHEN f = 0 THEN x0 ELSE x1 END <= t AS side FROM q LEFT JOIN below ON q.node = below.node)"""

ORACLES: dict[str, str] = {
    "guard_verdicts": _values(VERDICTS, "query, verdict"),
    "guard_blacklist": _values([("", "orders"), ("DROP", "orders"), ("select", "SQLBlacklistedCommand"), ("SELECT, SHOW", "SQLBlacklistedCommand")], "blacklist, verdict"),
    "guard_column_faults": _values(COLUMN_FAULTS, "query, faults"),
    "guard_syntax": _values([(*x, True) for x in SYNTAX], "query, line, col, highlight, whole"),
    "feature_kinds": _values(TYPES, "dtype, kind"),
    "encode_duration": "SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01'))::DOUBLE AS micros FROM orders",
    "preview_markdown": """
        WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS n FROM nation),
        s AS (SELECT *, '| ' || n_nationkey || ' | ' || n_name || ' |' AS shown FROM r)
        SELECT 0 AS line, '| n_nationkey | n_name |' AS shown UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 5, '| … | … |'
        UNION ALL SELECT (i + 1)::INTEGER, shown FROM s WHERE i <= 3 UNION ALL SELECT (7 - (n - i))::INTEGER, shown FROM s WHERE n - i < 2""",
    "preview_sample_size": "SELECT least(25, count(*)) AS n, least(25, count(*)) AS different, least(25, count(*)) AS members, TRUE AS repeatable FROM orders",
    "restore_refusals": _values(
        [("same", 2), ("by id", 2), ("none given", None), ("unknown name", None), ("given twice", None), ("other rows", None), ("other columns", None), ("other values", None)], "given, restored"
    ),
    "tree_rules_part_rows": "SELECT count(*) AS n, count(*) AS in_one_rule, TRUE AS sizes_agree FROM customer",
    "tree_depth_two": f"{_TWO_LEVELS} SELECT count(*) AS samples, round(avg(y), 2) AS prediction, round(stddev_pop(y), 2) AS std FROM placed GROUP BY node, side",
    "tree_importances": f"""{_TWO_LEVELS},
        gains AS (SELECT f, gain FROM best1 UNION ALL SELECT f, gain FROM below)
        SELECT CASE WHEN f = 0 THEN 'l_quantity' ELSE 'l_discount' END AS feature, round(sum(gain) / (SELECT sum(gain) FROM gains), 3) AS share FROM gains GROUP BY f HAVING round(sum(gain) / (SELECT sum(gain) FROM gains), 4) > 0""",
}
