"""What the toolkit knows about tables: identifiers, column summaries, references, state."""

from __future__ import annotations

import re
import secrets
from typing import Annotated

from pydantic import AfterValidator, BaseModel, Field, model_validator

_ID = re.compile(r"df_[0-9a-f]{8}")


def new_table_id() -> str:
    return f"df_{secrets.token_hex(4)}"


def is_table_id(text: str) -> bool:
    return _ID.fullmatch(text) is not None


def _checked_id(text: str) -> str:
    if not is_table_id(text):
        raise ValueError(f"{text!r} is not a table id: df_ and 8 lower-case hex digits")
    return text


DataFrameId = Annotated[str, AfterValidator(_checked_id)]


class ColumnSummary(BaseModel):
    """One column's profile. Statistics that a type does not have are None; dates and texts report theirs as text."""

    description: str = ""
    dtype: str
    count: int
    null_count: int
    unique_count: int
    min: float | str | None = None
    max: float | str | None = None
    mean: float | str | None = None
    std: float | str | None = None
    p25: float | str | None = None
    p50: float | str | None = None
    p75: float | str | None = None


class DataFrameReference(BaseModel):
    """A registered table. Bases have neither parents nor a query, derivatives both."""

    id: DataFrameId
    name: str
    description: str = ""
    num_rows: int
    num_columns: int
    column_names: list[str]
    column_summaries: dict[str, ColumnSummary]
    parent_ids: list[DataFrameId] = Field(default_factory=list)
    source_query: str | None = None

    @property
    def is_base(self) -> bool:
        return not self.parent_ids

    @model_validator(mode="after")
    def _all_or_nothing(self) -> DataFrameReference:
        if bool(self.parent_ids) != (self.source_query is not None):
            raise ValueError("a derivative needs both parent_ids and source_query, a base has neither")
        return self


class DataFrameToolkitState(BaseModel):
    """Everything needed to restore a toolkit but the base tables' data."""

    references: list[DataFrameReference] = Field(default_factory=list)


class ToolCallError(BaseModel):
    """A tool's answer when its input is at fault: returned, not raised."""

    error_type: str = Field(min_length=1)
    message: str = Field(min_length=1)
    details: dict = Field(default_factory=dict)
