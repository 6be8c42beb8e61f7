"""A Spark-native toolkit for exploring tables: guarded SQL, profiles, lineage, previews and decision-tree insight."""

from importlib import import_module

_PLACES = {"DataFrameToolkit": "tablewright.agent.toolkit", "DecisionTreeModule": "tablewright.agent.insight", "ToolModule": "tablewright.agent.tools", "enable_logging": "tablewright.agent.logs"}
_PLACES |= dict.fromkeys(["QueryError", "QuerySyntaxError", "QueryCommandError", "QueryTableError", "QueryColumnError", "QueryExecutionError"], "tablewright.plans.errors")
_PLACES |= {"ToolCallError": "tablewright.sources.models", "validate": "tablewright.plans.guard"}

__all__ = sorted(_PLACES)


def __getattr__(name: str) -> object:
    """Import on first use, so that executors load only what their tasks need."""
    if name in _PLACES:
        return getattr(import_module(_PLACES[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
