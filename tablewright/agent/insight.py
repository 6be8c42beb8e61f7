"""The decision-tree module."""

from __future__ import annotations

from tablewright.agent.logs import TOOL_CALL, logger
from tablewright.agent.tools import Tool, ToolModuleContext
from tablewright.functions.rules import DecisionTreeResult
from tablewright.operators.tree import LEAF_FLOOR, MAX_DEPTH, analyze
from tablewright.sources.models import ToolCallError


class DecisionTreeModule:
    """Adds analyze_with_decision_tree."""

    def __init__(self, context: ToolModuleContext) -> None:
        self._context = context
        self._tools = [Tool(self.analyze_with_decision_tree)]

    @property
    def system_prompt(self) -> str:
        return (
            "- **analyze_with_decision_tree**: explain a target column by rules over other columns. It picks classification or "
            "regression by itself, keeps the tree shallow, and returns one rule per leaf, feature importances and training metrics. "
            "Use it to find what drives a column, then check a rule with execute_sql. Leave out identifiers and columns that restate the target."
        )

    def get_tools(self) -> list[Tool]:
        return list(self._tools)

    def analyze_with_decision_tree(
        self, *, dataframe: str, target: str, features: list[str] | None = None, max_depth: int = MAX_DEPTH, min_samples_leaf: int = LEAF_FLOOR, task: str | None = None
    ) -> DecisionTreeResult | ToolCallError:
        """Fit a decision tree that predicts one column of a registered table from others, and tell it as rules.

        dataframe: name or id. features: columns to use, all suitable ones by default. max_depth: 1 to 6.
        min_samples_leaf: least rows of a leaf. task: classification or regression; by default the target decides.
        """
        logger.log(TOOL_CALL, "analyze_with_decision_tree(%s, %s)", dataframe, target)
        frame = self._context.get_dataframe(dataframe)
        if isinstance(frame, ToolCallError):
            return frame
        try:
            return analyze(frame, features, target, task=task, max_depth=max_depth, min_samples_leaf=min_samples_leaf)
        except ValueError as error:
            logger.warning("analyze_with_decision_tree: %s", error)
            return ToolCallError(error_type="InvalidArgument", message=str(error))
