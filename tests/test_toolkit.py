"""Registration, guarded SQL, previews, state, tools and modules."""

import datetime
import io
import logging

import pytest
from pydantic import ValidationError

from tablewright import DataFrameToolkit, DecisionTreeModule, ToolModule, enable_logging
from tablewright.agent.logs import LoggingHandle, logger
from tablewright.agent.tools import Tool
from tablewright.functions.nearly import nearly_equal
from tablewright.plans.errors import QueryColumnError, QueryCommandError, QuerySyntaxError, QueryTableError
from tablewright.plans.guard import validate
from tablewright.sources.models import ColumnSummary, DataFrameReference, DataFrameToolkitState, ToolCallError, is_table_id
from tablewright.sources.registry import DataFrameContext
from tablewright.sources.state import dependency_order


@pytest.fixture
def kit(spark):
    made = DataFrameToolkit()
    yield made
    for reference in made.references:
        made.unregister_dataframe(reference.name)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ann", 90), (2, "Bo", 85), (3, "Cy", 70), (4, None, 95), (5, "Di", 60)], "id long, name string, score long")


def test_register_and_look_up(kit, people):
    r = kit.register_dataframe("people", people, description="scores", column_descriptions={"score": "points"})
    assert is_table_id(r.id) and r.is_base and (r.num_rows, r.num_columns) == (5, 3)
    assert r.column_summaries["score"].description == "points"
    assert kit.get_dataframe_id("people") == r.id
    assert kit.get_dataframe_reference(r.id) == kit.get_dataframe_reference("people") == r
    assert kit.get_dataframe("people").count() == 5
    assert kit.get_dataframe_id(r.id).error_type == "InvalidArgument"
    assert kit.get_dataframe_id("none").error_type == "DataFrameNotFound"


def test_bad_registrations(kit, people, spark):
    kit.register_dataframe("people", people)
    with pytest.raises(ValueError, match="exists"):
        kit.register_dataframe("people", people)
    with pytest.raises(ValueError, match="looks like"):
        kit.register_dataframe("df_0123abcd", people)
    with pytest.raises(ValueError, match="lacks"):
        kit.register_dataframe("other", people, column_descriptions={"nope": "?"})
    with pytest.raises(ValueError):
        kit.register_dataframes({"fresh": people, "people": people})
    assert [r.name for r in kit.references] == ["people"]
    with pytest.raises(KeyError):
        kit.unregister_dataframe("none")


def test_context_is_a_container(spark, people):
    context = DataFrameContext()
    context.register("df_00000001", people).register_many({"df_00000002": people})
    assert len(context) == 2 and "df_00000001" in context and context.dataframe_ids == ("df_00000001", "df_00000002")
    assert context.execute_sql("SELECT count(*) AS n FROM df_00000002").first()["n"] == 5
    with pytest.raises(ValueError):
        context.register_many({"df_00000002": people})
    with pytest.raises(TypeError):
        context.register("df_00000003", [1])
    assert len(context.unregister(["df_00000001"])) == 1
    with pytest.raises(KeyError):
        context.get_dataframe("df_00000001")
    assert len(context.clear()) == 0


def test_results_are_tables_with_lineage(kit, people):
    base = kit.register_dataframe("people", people)
    good = kit.execute_sql(query=f"SELECT * FROM {base.id} WHERE score >= 85", result_name="good", result_description="the best")
    assert (good.num_rows, good.parent_ids, good.description) == (3, [base.id], "the best")
    top = kit.execute_sql(query=f"SELECT max(score) AS m FROM {good.id} g JOIN {base.id.upper()} b USING (score)", result_name="top")
    assert set(top.parent_ids) == {base.id, good.id} and kit.get_dataframe(top.id).first()["m"] == 95
    assert kit.execute_sql(query=f"SELECT * FROM {base.id} WHERE score > 1000", result_name="empty").num_rows == 0
    assert kit.execute_sql(query="SELECT 1", result_name="good").error_type == "DuplicateName"
    assert kit.execute_sql(query="SELECT 1", result_name="df_00000000").error_type == "InvalidArgument"


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("", "SQLSyntaxError"), ("  ", "SQLSyntaxError"), ("SELEC x", "SQLSyntaxError"), ("SELECT 1; SELECT 2", "SQLSyntaxError"), ("SELECT * FROM {t} WHERE id IN (1,", "SQLSyntaxError"),
        ("DROP TABLE {t}", "SQLBlacklistedCommand"), ("drop view {t}", "SQLBlacklistedCommand"), ("DELETE FROM {t}", "SQLBlacklistedCommand"), ("INSERT INTO {t} SELECT * FROM {t}", "SQLBlacklistedCommand"),
        ("WITH c AS (SELECT 1 AS x) INSERT INTO {t} SELECT * FROM c", "SQLBlacklistedCommand"), ("UPDATE {t} SET id = 1", "SQLBlacklistedCommand"), ("TRUNCATE TABLE {t}", "SQLBlacklistedCommand"),
        ("ALTER TABLE {t} ADD COLUMNS (z int)", "SQLBlacklistedCommand"), ("CREATE TABLE z AS SELECT * FROM {t}", "SQLBlacklistedCommand"), ("SHOW TABLES", "SQLBlacklistedCommand"), ("SELECT * FROM range(3), {t}", "SQLBlacklistedCommand"),
        ("MERGE INTO {t} a USING {t} b ON a.id = b.id WHEN MATCHED THEN DELETE", "SQLBlacklistedCommand"),
        ("SELECT 1", "SQLTableError"), ("SELECT * FROM other", "SQLTableError"), ("SELECT * FROM {t} WHERE id IN (SELECT x FROM hidden)", "SQLTableError"), ("SELECT * FROM parquet.`/etc`", "SQLTableError"), ("SELECT * FROM default.{t}", "SQLTableError"),
        ("SELECT nope FROM {t}", "SQLColumnError"), ("SELECT a.nope FROM {t} a", "SQLColumnError"), ("SELECT id FROM {t} a JOIN {t} b ON a.id = b.id", "SQLColumnError"),
        ("SELECT name + 1 AS x FROM {t}", "SQLExecutionError"), ("SELECT 1 / (id - id) AS x FROM {t}", "SQLExecutionError"), ("SELECT id, id FROM {t}", "SQLExecutionError"),
    ],
)
def test_refusals(kit, people, query, kind):
    t = kit.register_dataframe("people", people).id
    found = kit.execute_sql(query=query.format(t=t), result_name="r")
    assert isinstance(found, ToolCallError) and found.error_type == kind, found
    assert len(kit.references) == 1


@pytest.mark.parametrize(
    "query",
    [
        "SELECT ID, Score * 2 AS twice FROM {t} ORDER BY twice", 'SELECT "name" FROM {t}', "WITH c AS (SELECT id FROM {t}) SELECT * FROM c", "SELECT x.id FROM (SELECT id FROM {t}) x", "SELECT id FROM {t} WHERE EXISTS (SELECT 1 FROM {t} b WHERE b.id = {t}.id)",
        "SELECT id, row_number() OVER (ORDER BY score DESC) AS nth FROM {t}", "SELECT name FROM {t} UNION SELECT name FROM {t}", "SELECT id FROM {t} -- a comment\n", "SELECT count(*) AS n FROM {t} HAVING count(*) > 1", "SELECT * FROM {t} LIMIT 2 OFFSET 1",
        "WITH RECURSIVE r(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM r WHERE k < 3) SELECT r.k, id FROM r JOIN {t} ON id = r.k", "SELECT name, count(*) AS n FROM {t} GROUP BY ROLLUP (name)",
    ],
)
def test_accepted(kit, people, query):
    t = kit.register_dataframe("people", people).id
    found = kit.execute_sql(query=query.format(t=t), result_name="r")
    assert isinstance(found, DataFrameReference), found


def test_all_column_errors_are_told_in_order_of_kinds(spark):
    known = {"users": ["id", "name"], "orders": ["id", "user_id"]}
    with pytest.raises(QueryColumnError) as told:
        validate(spark, "SELECT u.nope, missing, id FROM users u JOIN orders o ON u.id = o.bad", known)
    assert len(told.value.details["errors"]) == 4
    assert validate(spark, "SELECT USERS.ID, user_id FROM users JOIN orders ON users.id = orders.user_id", known) == ["users", "orders"]
    with pytest.raises(QueryTableError):
        validate(spark, "SELECT nope FROM users, other", known)
    with pytest.raises(QueryCommandError):
        validate(spark, "DELETE FROM other", known)
    with pytest.raises(QuerySyntaxError):
        validate(spark, "DELETE FRM other", known)
    assert validate(spark, "WITH users AS (SELECT id AS k FROM orders) SELECT k FROM users", known) == ["orders"]


def test_previews(kit, spark):
    rows = spark.range(20).selectExpr("id", "CAST(id AS DOUBLE) AS v", "id % 2 = 0 AS even", "CASE WHEN id = 0 THEN NULL ELSE 'a|b' END AS s").coalesce(1)
    kit.register_dataframe("t", rows)
    lines = kit.view_as_markdown_table(identifier="t", num_rows=5).split("\n")
    assert len(lines) == 2 + 5 + 1 and lines[0] == "| id | v | even | s |" and lines[2] == "| 0 | 0.0 | true | null |" and "…" in lines[5] and lines[-1].startswith("| 19 ")
    assert len(kit.view_as_markdown_table(identifier="t", num_rows=50).split("\n")) == 22
    a, b = (kit.view_as_markdown_table(identifier="t", num_rows=4, sample=True, seed=3) for _ in range(2))
    assert a == b and len(a.split("\n")) == 6 and "…" not in a
    assert kit.view_as_markdown_table(identifier="t", columns=["id", "id"]).error_type == "DuplicateColumns"
    assert kit.view_as_markdown_table(identifier="t", columns=["no"]).error_type == "InvalidColumns"
    for bad in ({"num_rows": 0}, {"seed": 1}, {"columns": []}):
        assert kit.view_as_markdown_table(identifier="t", **bad).error_type == "InvalidArgument"
    kit.register_dataframe("none", spark.createDataFrame([], "a long, b long"))
    assert kit.view_as_markdown_table(identifier="none") == "| a | b |\n| --- | --- |"


def test_state_round_trip_and_tampering(kit, people, spark):
    base = kit.register_dataframe("people", people)
    a = kit.execute_sql(query=f"SELECT id, score FROM {base.id} WHERE score > 60", result_name="a")
    b = kit.execute_sql(query=f"SELECT id FROM {a.id} WHERE score > 80", result_name="b")
    c = kit.execute_sql(query=f"SELECT count(*) AS n FROM {a.id} JOIN {b.id} USING (id)", result_name="c")
    state = DataFrameToolkitState.model_validate_json(kit.export_state().model_dump_json())
    for key in ("people", base.id):
        again = DataFrameToolkit.from_state(state, {key: people})
        assert [r.id for r in again.references if r.name == "c"] == [c.id]
        assert again.get_dataframe("c").first()["n"] == 3
    for wrong, why in (({}, "missing"), ({"x": people}, "no base"), ({"people": people, base.id: people}, "twice"), ({"people": people.limit(4)}, "rows"), ({"people": people.selectExpr("id", "name", "CAST(score AS DOUBLE) AS score")}, "dtype"), ({"people": people.select("name", "id", "score")}, "columns")):
        with pytest.raises(ValueError, match=why):
            DataFrameToolkit.from_state(state, wrong)
    state.references[2].column_summaries["id"].max = 99.0
    with pytest.raises(ValueError, match="max"):
        DataFrameToolkit.from_state(state, {"people": people})


def _reference(n, parents=()):
    return DataFrameReference(id=f"df_0000000{n}", name=f"t{n}", num_rows=0, num_columns=0, column_names=[], column_summaries={}, parent_ids=[f"df_0000000{p}" for p in parents], source_query="q" if parents else None)


def test_dependency_order():
    diamond = [_reference(4, (2, 3)), _reference(3, (1,)), _reference(2, (1,)), _reference(1)]
    order = [r.name for r in dependency_order(diamond)]
    assert order[0] == "t1" and order[-1] == "t4"
    with pytest.raises(ValueError, match="cycle"):
        dependency_order([_reference(1, (2,)), _reference(2, (1,))])
    with pytest.raises(ValueError, match="unknown"):
        dependency_order([_reference(1, (9,))])
    with pytest.raises(ValidationError):
        DataFrameReference(id="df_00000001", name="x", num_rows=0, num_columns=0, column_names=[], column_summaries={}, source_query="q")


@pytest.mark.parametrize(("a", "b", "same"), [(1, 1.0, True), (1.0, 1 + 1e-12, True), (1.0, 1.1, False), (float("nan"), float("nan"), True), (float("inf"), float("inf"), True), (float("inf"), -float("inf"), False), (None, None, True), (None, 0, False), (True, 1, False), ("a", "a", True), ("1", 1, False)])
def test_near_equality(a, b, same):
    assert nearly_equal(a, b) is same and nearly_equal(b, a) is same


def test_profile(kit, spark):
    day = datetime.date(2024, 1, 2)
    rows = [(5, 1.5, "b", True, day, [1]), (15, float("nan"), "a", None, None, [1]), (25, 2.5, None, False, day, None), (35, None, "a", True, day, [2]), (45, 4.0, "c", True, day, [1]), (55, 5.0, "d", True, day, [1])]
    r = kit.register_dataframe("t", spark.createDataFrame(rows, "`a b` long, x double, s string, f boolean, d date, l array<int>")).column_summaries
    n = r["a b"]
    assert (n.count, n.mean, n.min, n.max, n.p25, n.p50, n.p75, n.dtype) == (6, 30.0, 5.0, 55.0, 15.0, 35.0, 45.0, "bigint")
    assert (r["x"].count, r["x"].null_count, r["x"].unique_count, r["x"].max) == (5, 1, 6, 5.0)
    assert (r["s"].unique_count, r["s"].min, r["s"].max, r["s"].mean) == (5, "a", "d", None)
    assert r["f"].mean == 0.8 and r["d"].p50 == "2024-01-02" and r["d"].std == 0.0
    assert (r["l"].count, r["l"].null_count, r["l"].min) == (5, 1, None)
    empty = kit.register_dataframe("e", spark.createDataFrame([], "a long, s string")).column_summaries["a"]
    assert (empty.count, empty.unique_count, empty.min, empty.p50) == (0, 0, None, None)
    assert ColumnSummary.model_validate_json(n.model_dump_json()) == n


class Shouting:
    system_prompt = "Shout."

    def __init__(self, context):
        self.context = context

    def get_tools(self):
        return [Tool(self.shout)]

    def shout(self, text: str, times: int = 1) -> str:
        """Say it loudly."""
        return text.upper() * times


def test_tools_and_prompts(kit, people):
    assert [t.name for t in kit.get_core_tools()] == ["get_dataframe_id", "get_dataframe_reference", "list_dataframes", "execute_sql", "view_as_markdown_table"]
    tools = {t.name: t for t in kit.get_tools(Shouting, DecisionTreeModule, Shouting, exclude={"list_dataframes"})}
    assert "list_dataframes" not in tools and {"shout", "analyze_with_decision_tree"} <= set(tools)
    assert tools["shout"].invoke({"text": "a", "times": 2}) == "AA" and tools["shout"].description == "Say it loudly." and "text" in tools["shout"].args
    with pytest.raises(ValidationError):
        tools["shout"].invoke({"times": 2})
    kit.register_dataframe("people", people)
    assert tools["execute_sql"].invoke({"query": "SELECT 1", "result_name": "x"}).error_type == "SQLTableError"
    prompt = kit.get_system_prompt(Shouting, exclude={"execute_sql"})
    assert "## Shouting" in prompt and "not available: execute_sql" in prompt
    assert "Shouting" not in kit.get_system_prompt(Shouting, exclude={"shout"})
    assert isinstance(kit._module(Shouting), ToolModule) and kit._module(Shouting) is kit._module(Shouting)
    with pytest.raises(TypeError):
        kit.get_tools(dict)
    context = kit._module(Shouting).context
    assert not hasattr(context, "unregister_dataframe") and len(context.references) == 1
    assert context.register_dataframe("copy", people).name == "copy" and context.register_dataframe("copy", people).error_type == "DuplicateName"


def test_logging_is_silent_until_enabled(kit):
    out = io.StringIO()
    kit.list_dataframes()
    with enable_logging(sink=out) as handle:
        assert LoggingHandle.get_active_handle_count() == 1 and not logger.disabled
        kit.list_dataframes()
        handle.disable()
        handle.disable()
    assert "TOOL_CALL list_dataframes" in out.getvalue() and logger.disabled and logging.getLevelName(25) == "TOOL_CALL"


def test_file_scans_stay_in_their_files(kit, people, tmp_path, spark):
    people.write.parquet(str(tmp_path / "people"))
    files = spark.read.parquet(str(tmp_path / "people"))
    base = kit.register_dataframe("files", files.where("score > 60").select("id", "score"))
    other = kit.register_dataframe("grouped", files.groupBy("name").count())
    snapshot = kit._registry.context.snapshot
    assert not snapshot(base.id).kept and snapshot(other.id).kept
    plan = kit.get_dataframe("files").where("score > 90").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(score,90)" in plan and "InMemoryTableScan" not in plan
    assert kit.execute_sql(query=f"SELECT max(score) AS m FROM {base.id}", result_name="m").num_rows == 1
    assert len(kit.view_as_markdown_table(identifier="files").split("\n")) == 6


def test_stream_batches_become_tables(kit, spark, tmp_path):
    from tablewright.streaming.replay import register_batches

    spark.range(10).write.parquet(str(tmp_path / "in"))
    query = register_batches(kit, spark.readStream.schema("id long").parquet(str(tmp_path / "in")), "batch", str(tmp_path / "state"))
    assert query.awaitTermination(60)
    assert kit.get_dataframe("batch_0").count() == 10


KNOWN = {"users": ["id", "name"], "orders": ["id", "user_id", "total"]}


@pytest.mark.parametrize(
    "query",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM users", "SELECT id FROM users WHERE reflect('java.lang.System', 'exit', 1) = 'x'", "SELECT id FROM users ORDER BY try_reflect('a', 'b')",
        "SELECT transform(array(1), x -> java_method('a', 'b')) FROM users", "SELECT (SELECT max(reflect('a', 'b')) FROM orders) FROM users", "WITH t AS (SELECT input_file_name() AS f FROM users) SELECT f FROM t",
        "SELECT IDENTIFIER('java_method')('a', 'b') FROM users", "SELECT count(*) FROM users GROUP BY java_method('a', 'b')", "SELECT sum(id) FILTER (WHERE reflect('a', 'b') = 'x') FROM users", "SELECT current_user() FROM users", "SELECT nobody_knows(id) FROM users",
        "SELECT spark_catalog.default.f(id) FROM users", "SELECT u.id FROM users u JOIN orders o ON java_method('a', 'b') = 'x'",
    ],
)
def test_functions_that_reach_beyond_the_tables_are_refused(spark, query):
    with pytest.raises(QueryCommandError):
        validate(spark, query, KNOWN)


def test_a_named_window_hides_nothing(spark):
    kit = DataFrameToolkit()
    table = kit.register_dataframe("t", spark.createDataFrame([(1, 2)], "a int, b int")).id
    for query in (f"SELECT sum(a) OVER w AS s FROM {table} WINDOW w AS (PARTITION BY java_method('java.lang.System', 'getProperty', 'user.home'))", f"SELECT a FROM {table} LATERAL VIEW explode(array(reflect('java.lang.System', 'getProperty', 'user.home'))) e AS x"):
        assert kit.execute_sql(query=query, result_name="r").error_type == "SQLBlacklistedCommand"
    assert kit.execute_sql(query=f"SELECT sum(a) OVER w AS s, upper(string(b)) AS u FROM {table} WINDOW w AS (PARTITION BY b)", result_name="fine").num_rows == 1


def test_callers_can_forbid_commands(spark):
    assert validate(spark, "SELECT id FROM users", KNOWN, blacklist=["drop"]) == ["users"]
    with pytest.raises(QueryCommandError, match="SELECT"):
        validate(spark, "SELECT id FROM users", KNOWN, blacklist=["Select"])
    with pytest.raises(QueryCommandError):
        validate(spark, "DROP TABLE users", KNOWN, blacklist=[])


def test_syntax_errors_tell_the_place(spark):
    with pytest.raises(QuerySyntaxError) as told:
        validate(spark, "SELECT id\nFROM users WHER id = 3", KNOWN)
    (error,) = told.value.details["errors"]
    assert set(error) == {"description", "line", "col", "start_context", "highlight", "end_context"}
    assert error["line"] == 2 and error["start_context"] + error["highlight"] + error["end_context"] == "SELECT id\nFROM users WHER id = 3" and error["highlight"] == "id" and error["col"] == 17


def test_all_column_errors_with_derived_tables_and_ctes(spark):
    for query, wrong in [
        ("WITH t AS (SELECT id AS k, nope FROM users) SELECT k, missing, t.worse FROM t JOIN orders ON orders.bad = t.k", ["nope", "missing", "t.worse", "orders.bad"]),
        ("SELECT d.n, d.x, y FROM (SELECT name AS n FROM users) d", ["d.x", "y"]),
        ("SELECT d.id, total FROM (SELECT * FROM orders) d WHERE z = 1", ["z"]),
        ("SELECT a.name, id FROM users a JOIN (SELECT id, user_id FROM orders) b ON a.id = b.user_id", ["id"]),
        ("WITH a AS (SELECT id FROM users), b AS (SELECT a.*, 1 AS one FROM a) SELECT id, one, two FROM b", ["two"]),
    ]:
        with pytest.raises(QueryColumnError) as told:
            validate(spark, query, KNOWN)
        assert [e.split("'")[1] for e in told.value.details["errors"]] == wrong or sorted(e.split("'")[1] for e in told.value.details["errors"]) == sorted(wrong), told.value
    for query in ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n, id FROM r, users", "SELECT x.k FROM (SELECT id AS k FROM users UNION ALL SELECT user_id FROM orders) x WHERE k > 1 ORDER BY k", "SELECT name, p FROM users LATERAL VIEW explode(array(1)) e AS p", "SELECT upper(name) AS u FROM users GROUP BY u HAVING count(*) > 1 ORDER BY u"):
        assert "users" in validate(spark, query, KNOWN)


def test_names_of_the_package():
    import tablewright

    for name in tablewright.__all__:
        assert getattr(tablewright, name) is not None
    assert issubclass(tablewright.QueryColumnError, tablewright.QueryError)
