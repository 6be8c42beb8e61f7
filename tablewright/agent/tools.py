"""Tools as language-model agents call them, and modules that add more."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pydantic import BaseModel, create_model
from pyspark.sql import DataFrame

from tablewright.sources.models import DataFrameReference, ToolCallError


class Tool:
    """A function with a name, a description and a schema of its arguments."""

    def __init__(self, function: Callable[..., Any], name: str | None = None, description: str | None = None) -> None:
        self.function = function
        self.name = name or function.__name__
        self.description = description or inspect.getdoc(function) or ""
        hints = typing.get_type_hints(function)
        fields = {k: (hints.get(k, Any), ... if p.default is p.empty else p.default) for k, p in inspect.signature(function).parameters.items()}
        self.args_schema: type[BaseModel] = create_model(f"{self.name}_args", **fields)

    @property
    def args(self) -> dict[str, Any]:
        return self.args_schema.model_json_schema().get("properties", {})

    def invoke(self, arguments: dict[str, Any] | None = None) -> Any:
        """Call the function with checked arguments by name."""
        checked = self.args_schema.model_validate(arguments or {})
        return self.function(**{k: getattr(checked, k) for k in type(checked).model_fields})

    def __repr__(self) -> str:
        return f"Tool({self.name!r})"


class ToolModuleContext:
    """What a module may do: look up tables and register results; it cannot remove any."""

    def __init__(self, references: Callable[[], tuple[DataFrameReference, ...]], get: Callable[[str], DataFrame | ToolCallError], reference: Callable[[str], DataFrameReference | ToolCallError], register: Callable[..., DataFrameReference | ToolCallError]) -> None:
        self._references, self._get, self._reference, self._register = references, get, reference, register

    @property
    def references(self) -> tuple[DataFrameReference, ...]:
        return self._references()

    def get_dataframe(self, identifier: str) -> DataFrame | ToolCallError:
        return self._get(identifier)

    def get_dataframe_reference(self, identifier: str) -> DataFrameReference | ToolCallError:
        return self._reference(identifier)

    def register_dataframe(
        self, name: str, dataframe: DataFrame, *, description: str | None = None, parent_ids: list[str] | None = None, source_query: str | None = None, column_descriptions: dict[str, str] | None = None
    ) -> DataFrameReference | ToolCallError:
        return self._register(name, dataframe, description=description, parent_ids=parent_ids, source_query=source_query, column_descriptions=column_descriptions)


@runtime_checkable
class ToolModule(Protocol):
    """A class made with a ToolModuleContext that has a system prompt and tools."""

    @property
    def system_prompt(self) -> str: ...

    def get_tools(self) -> list[Tool]: ...
