"""Spark's parsed plans as plain Python, read from the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tablewright.plans.errors import QuerySyntaxError
from tablewright.sources.registry import SQL_SETTINGS, settings

#: Nodes of parsed plans that only read.
READING = {
    "Aggregate", "AliasedQuery", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "Offset", "OneRowRelation", "Pivot", "Project", "Sample",
    "Sort", "SubqueryAlias", "Union", "UnionLoop", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedPivot", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedWith", "Unpivot", "UnpivotTransformer", "Window", "WithWindowDefinition", "Deduplicate", "Tail", "LocalRelation", "UnresolvedOrdinal", "UnresolvedGroupBy",
}


#: Expressions, unresolved or resolved, by which a query could run code, read files or tell of the session.
REFUSED_EXPRESSIONS = {
    "ExpressionWithUnresolvedIdentifier", "CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "ScalaUDF", "PythonUDF", "PythonUDAF", "ScalaAggregator", "ScalaUDAF",
    "ApplyFunctionExpression", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAFFunction", "HiveGenericUDTF", "ScalarSubqueryReference", "UnresolvedTableValuedFunction",
}


@dataclass
class Node:
    """A plan node: its class, children, plans of subqueries in its expressions, and what else the checks need."""

    kind: str
    children: list[Node] = field(default_factory=list)
    subqueries: list[Node] = field(default_factory=list)
    ctes: list[tuple[str, Node]] = field(default_factory=list)
    table: tuple[str, ...] = ()
    alias: str = ""
    columns: list[tuple[str, ...]] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    #: Names that a projection gives, in order: "*" for all of its sources, ("a", "*") for those of one, None if it has none.
    gives: list[str | tuple[str, str] | None] = field(default_factory=list)
    functions: list[tuple[str, ...]] = field(default_factory=list)

    def everything(self) -> Iterator[Node]:
        yield self
        for x in [*self.children, *self.subqueries, *(plan for _, plan in self.ctes)]:
            yield from x.everything()


def _items(seq: object) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _simple(obj: object) -> str:
    return obj.getClass().getSimpleName().rstrip("$")


def _expressions(expression: object, node: Node, columns: bool = True) -> None:
    kind = _simple(expression)
    if kind == "UnresolvedAttribute" and columns:
        node.columns.append(tuple(str(x) for x in _items(expression.nameParts())))
    elif kind == "Alias" and columns:
        node.outputs.append(expression.name())
    elif kind == "UnresolvedFunction":
        node.functions.append(tuple(str(x).lower() for x in _items(expression.nameParts())))
    elif kind == "UnresolvedGenerator":
        node.functions.append((str(expression.name().funcName()).lower(),))
    elif kind in REFUSED_EXPRESSIONS:
        node.functions.append((kind,))
    # a lambda's variables aren't columns, but its functions count
    for child in _items(expression.children()):
        _expressions(child, node, columns and kind != "LambdaFunction")


def _gives(expression: object) -> str | tuple[str, str] | None:
    kind = _simple(expression)
    if kind == "UnresolvedStar":
        target = expression.target()
        return "*" if target.isEmpty() else (str(_items(target.get())[-1]), "*")
    if kind == "UnresolvedAttribute":
        return str(_items(expression.nameParts())[-1])
    return str(expression.name()) if kind == "Alias" else None


def _node(plan: object) -> Node:
    node = Node(_simple(plan))
    if node.kind == "UnresolvedRelation":
        node.table = tuple(str(x) for x in _items(plan.multipartIdentifier()))
    elif node.kind == "SubqueryAlias":
        node.alias = str(plan.alias())
    elif node.kind == "UnresolvedWith":
        node.ctes = [(str(x._1()), _node(x._2())) for x in _items(plan.cteRelations())]
    for expression in [plan.generator()] if node.kind == "Generate" else _items(plan.expressions()):  # a generator's outputs are no references
        _expressions(expression, node)
    if node.kind in ("Project", "Aggregate"):
        node.gives = [_gives(x) for x in _items(plan.projectList() if node.kind == "Project" else plan.aggregateExpressions())]
    node.children = [_node(x) for x in _items(plan.children())]
    node.subqueries = [_node(x) for x in _items(plan.subqueries())]
    return node


def parse(spark: SparkSession, query: str) -> Node:
    """The parsed plan of one statement; QuerySyntaxError if there is none."""
    if not query or not query.strip():
        raise QuerySyntaxError("the query is empty", errors=[])
    try:
        with settings(spark, SQL_SETTINGS):
            plan = _node(spark._jsparkSession.sessionState().sqlParser().parsePlan(query))
    except ParseException as error:
        raise QuerySyntaxError(f"the query cannot be parsed: {_first_line(error)}", errors=[syntax_details(query, str(error))]) from None
    except AnalysisException as error:
        raise QuerySyntaxError(_first_line(error), errors=[syntax_details(query, str(error))]) from None
    except Exception as error:  # py4j wraps what the converter doesn't know
        if "ParseException" in str(error):
            raise QuerySyntaxError(_first_line(error), errors=[syntax_details(query, str(error))]) from None
        raise
    _check_clauses(plan, query)
    return plan


#: Words that begin a clause. Spark takes them for a table's alias where the clause that they begin is missing.
CLAUSES = frozenset({"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "ON", "USING", "JOIN", "FROM", "SELECT", "UNION", "INTERSECT", "EXCEPT"})


def _check_clauses(plan: Node, query: str) -> None:
    for node in plan.everything():
        if node.kind != "SubqueryAlias" or node.alias.upper() not in CLAUSES:
            continue
        places = [m for m in re.finditer(rf"""(["`]?)\b{node.alias}\b""", query, re.IGNORECASE)]
        if any(not m[1] for m in places) and not any(m[1] for m in places):
            before = query[: places[-1].start()]
            at = f"(line {before.count(chr(10)) + 1}, pos {len(before) - before.rfind(chr(10)) - 1})"
            message = f"nothing follows {node.alias.upper()}"
            raise QuerySyntaxError(f"the query cannot be parsed: {message} {at}", errors=[syntax_details(query, f"{message} {at}")])


#: Characters of context that are told on either side of a syntax error.
CONTEXT = 40


def _first_line(error: object) -> str:
    return next((x for x in str(error).splitlines() if x.strip()), "")


def syntax_details(query: str, message: str) -> dict[str, object]:
    """description, line, col (from 1), start_context, highlight and end_context of a parser's message."""
    found = re.search(r"\(line (\d+), pos (\d+)\)", message)
    description = re.sub(r"\s*\(line \d+, pos \d+\)|\s*SQLSTATE: \w+", "", _first_line(message)).strip()
    lines = query.splitlines(keepends=True) or [""]
    line, column = (int(found[1]), int(found[2])) if found else (len(lines), len(lines[-1].rstrip()))
    at = min(len(query), sum(map(len, lines[: line - 1])) + column)
    mark = re.compile(r"\w+|\S").match(query, at)
    end = mark.end() if mark else at
    return {"description": description, "line": line, "col": column + 1, "start_context": query[max(0, at - CONTEXT) : at], "highlight": query[at:end], "end_context": query[end : end + CONTEXT]}


def refused_expressions(frame: DataFrame) -> list[str]:
    """Expressions of an analysed query that it may not use, but for those inside the tables that it reads."""
    found: list[str] = []

    def of(expression: object) -> None:
        kind = _simple(expression)
        if kind in REFUSED_EXPRESSIONS:
            found.append(kind)
        for child in _items(expression.children()):
            of(child)

    def visit(plan: object) -> None:
        if _simple(plan) == "View":
            return
        for expression in _items(plan.expressions()):
            of(expression)
        for child in [*_items(plan.children()), *_items(plan.subqueries()), *_items(plan.innerChildren())]:
            visit(child)

    visit(frame._jdf.queryExecution().analyzed())
    return found


def known_functions(spark: SparkSession) -> frozenset[str]:
    """Names of Spark's own functions."""
    names = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin().listFunction()
    return frozenset(str(x.funcName()).lower() for x in _items(names))


def tables(node: Node, hidden: frozenset[str] = frozenset()) -> list[tuple[str, ...]]:
    """Names of the relations that a plan reads, without those that a WITH clause in scope defines."""
    found = []
    if node.kind == "UnresolvedWith":
        names = hidden
        recursive = hidden | {n.lower() for n, _ in node.ctes}
        for name, plan in node.ctes:
            own = {x.table[0].lower() for x in plan.everything() if len(x.table) == 1} & {name.lower()}
            found += tables(plan, names | (own if _recursive(plan) else set()))
            names = names | {name.lower()}
        hidden = recursive
    elif node.kind == "UnresolvedRelation" and not (len(node.table) == 1 and node.table[0].lower() in hidden):
        found.append(node.table)
    for x in [*node.children, *node.subqueries]:
        found += tables(x, hidden)
    return found


def _recursive(plan: Node) -> bool:
    return any(x.kind in ("Union", "UnionLoop") for x in plan.everything())
