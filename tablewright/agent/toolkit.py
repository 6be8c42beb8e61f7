"""The toolkit: registered tables, guarded SQL over them, previews, state, and tools for agents."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewright.agent.logs import TOOL_CALL, logger
from tablewright.agent.tools import Tool, ToolModule, ToolModuleContext
from tablewright.functions.nearly import REL_TOL
from tablewright.operators.preview import DEFAULT_ROWS, preview
from tablewright.operators.profile import reference_of
from tablewright.plans.errors import QueryError
from tablewright.plans.guard import analyse
from tablewright.sources.models import DataFrameReference, DataFrameToolkitState, ToolCallError, is_table_id
from tablewright.sources.registry import DataFrameRegistry, Snapshot
from tablewright.sources.state import restore
from tablewright.sources.together import together

CORE_PROMPT = """You can explore tables with these tools; they live in Spark and never enter this conversation as a whole.

- **list_dataframes**: all tables with their ids, columns and statistics.
- **get_dataframe_id**: the id of a table by its name; SQL uses ids as table names.
- **get_dataframe_reference**: one table's columns and statistics, by name or id.
- **execute_sql**: run a read-only SELECT over table ids; the result is a new table with an id of its own.
- **view_as_markdown_table**: a few rows of a table.

List the tables first, take their ids, query by id, and look at results only as far as you need."""


class DataFrameToolkit:
    """Tables by name and id. Names are yours, ids (df_ and 8 hex digits) are what SQL calls them."""

    def __init__(self, registry: DataFrameRegistry | None = None) -> None:
        self._registry = registry if registry is not None else DataFrameRegistry()
        self._tools = [Tool(f) for f in (self.get_dataframe_id, self.get_dataframe_reference, self.list_dataframes, self.execute_sql, self.view_as_markdown_table)]
        self._modules: dict[type, ToolModule] = {}
        self._context = ToolModuleContext(lambda: self.references, self._frame, self._find, self._register_result)

    # tools and prompts

    def get_core_tools(self) -> list[Tool]:
        return list(self._tools)

    def get_tools(self, *module_classes: type, exclude: set[str] | None = None) -> list[Tool]:
        """Core tools and those of modules, each once and in order, without the excluded ones; a new list each time."""
        found = {t.name: t for t in self._tools}
        for module in map(self._module, dict.fromkeys(module_classes)):
            for t in module.get_tools():
                found.setdefault(t.name, t)
        return [t for name, t in found.items() if name not in (exclude or set())]

    def get_system_prompt(self, *module_classes: type, exclude: set[str] | None = None) -> str:
        """What to tell an agent about its tools; a module all of whose tools are excluded isn't mentioned."""
        exclude = exclude or set()
        parts = [CORE_PROMPT]
        if gone := sorted(exclude & {t.name for t in self._tools}):
            parts.append(f"\nNote: these tools are not available: {', '.join(gone)}")
        for kind in dict.fromkeys(module_classes):
            module = self._module(kind)
            names = {t.name for t in module.get_tools()}
            if not names - exclude:
                continue
            parts.append(f"\n## {kind.__name__}\n\n{module.system_prompt}")
            if gone := sorted(names & exclude):
                parts.append(f"\nNote: these tools are not available: {', '.join(gone)}")
        return "\n".join(parts)

    def _module(self, kind: type) -> ToolModule:
        if kind not in self._modules:
            try:
                module = kind(self._context)
            except TypeError as error:
                raise TypeError(f"{kind.__name__} must be made with one ToolModuleContext: {error}") from error
            if not isinstance(module, ToolModule):
                raise TypeError(f"{kind.__name__} is no tool module: it needs system_prompt and get_tools")
            self._modules[kind] = module
        return self._modules[kind]

    # registration

    @property
    def references(self) -> tuple[DataFrameReference, ...]:
        return tuple(self._registry.references.values())

    def _check_name(self, name: str) -> ToolCallError | None:
        if is_table_id(name):
            return ToolCallError(error_type="InvalidArgument", message=f"{name!r} looks like a table id; choose another name", details={"name": name})
        if any(r.name == name for r in self.references):
            return ToolCallError(error_type="DuplicateName", message=f"a table named {name!r} exists", details={"name": name})
        return None

    def _prepare(self, name: str, frame: DataFrame, **about: object) -> tuple[DataFrameReference, Snapshot]:
        if not isinstance(frame, DataFrame):
            raise TypeError(f"a Spark DataFrame is needed, not {type(frame).__name__}")
        if len({c.lower() for c in frame.columns}) != len(frame.columns):
            raise ValueError(f"column names of {name!r} are not unique: {', '.join(frame.columns)}")
        kept = Snapshot(frame)
        try:
            return reference_of(name, kept.frame, **about), kept
        except BaseException:
            kept.release()
            raise

    def register_dataframe(self, name: str, dataframe: DataFrame, *, description: str | None = None, column_descriptions: dict[str, str] | None = None) -> DataFrameReference:
        """Keep a snapshot of a table, profile it and make it available to SQL under a new id."""
        return self.register_dataframes({name: dataframe}, descriptions={name: description} if description else None, column_descriptions={name: column_descriptions} if column_descriptions else None)[0]

    def register_dataframes(self, dataframes: Mapping[str, DataFrame], *, descriptions: Mapping[str, str] | None = None, column_descriptions: Mapping[str, dict[str, str]] | None = None) -> list[DataFrameReference]:
        """Register all of the tables or, if one is at fault, none."""
        for name in dataframes:
            if error := self._check_name(name):
                raise ValueError(error.message)
        ready: dict[str, tuple[DataFrameReference, Snapshot]] = {}

        def prepare(name: str, frame: DataFrame) -> None:
            ready[name] = self._prepare(name, frame, description=(descriptions or {}).get(name), column_descriptions=(column_descriptions or {}).get(name))

        try:
            together([partial(prepare, name, frame) for name, frame in dataframes.items()])
        except BaseException:
            for _, kept in ready.values():
                kept.release()
            raise
        for name in dataframes:
            self._registry.register(*ready[name])
        return [ready[name][0] for name in dataframes]

    def _register_result(self, name: str, dataframe: DataFrame, **about: object) -> DataFrameReference | ToolCallError:
        if error := self._check_name(name):
            return error
        reference, kept = self._prepare(name, dataframe, **about)
        self._registry.register(reference, kept)
        return reference

    def unregister_dataframe(self, name: str) -> None:
        """Forget a table by its name; KeyError if there is none. Derivatives stay, but a later restore needs it."""
        found = next((r for r in self.references if r.name == name), None)
        if found is None:
            raise KeyError(f"no table is named {name!r}")
        self._registry.unregister(found.id)

    # look-up

    def _find(self, identifier: str) -> DataFrameReference | ToolCallError:
        found = self._registry.references.get(identifier) or next((r for r in self.references if r.name == identifier), None)
        if found is not None:
            return found
        names, ids = [r.name for r in self.references], [r.id for r in self.references]
        return ToolCallError(error_type="DataFrameNotFound", message=f"no table {identifier!r}; names: {', '.join(names) or 'none'}; ids: {', '.join(ids) or 'none'}", details={"identifier": identifier, "available_names": names, "available_ids": ids})

    def _frame(self, identifier: str) -> DataFrame | ToolCallError:
        found = self._find(identifier)
        return found if isinstance(found, ToolCallError) else self._registry.context.get_dataframe(found.id)

    def get_dataframe(self, identifier: str) -> DataFrame:
        """A registered table by name or id; KeyError if there is none."""
        found = self._frame(identifier)
        if isinstance(found, ToolCallError):
            raise KeyError(found.message)
        return found

    def get_dataframe_id(self, name: str) -> str | ToolCallError:
        """The id of a table by its name, for use in SQL."""
        logger.log(TOOL_CALL, "get_dataframe_id(%s)", name)
        if is_table_id(name):
            return ToolCallError(error_type="InvalidArgument", message=f"{name!r} is an id already; give a name", details={"name": name})
        found = self._find(name)
        return found if isinstance(found, ToolCallError) else found.id

    def get_dataframe_reference(self, identifier: str) -> DataFrameReference | ToolCallError:
        """One table's columns, statistics and lineage, by name or id."""
        logger.log(TOOL_CALL, "get_dataframe_reference(%s)", identifier)
        return self._find(identifier)

    def list_dataframes(self) -> list[DataFrameReference]:
        """All tables, registered ones and results."""
        logger.log(TOOL_CALL, "list_dataframes()")
        return list(self.references)

    # queries

    def execute_sql(self, *, query: str, result_name: str, result_description: str | None = None) -> DataFrameReference | ToolCallError:
        """Run a read-only SELECT over registered tables, named by id, and keep the result as a new table.

        query: the statement. result_name: a new name. result_description: what the result holds.
        """
        logger.log(TOOL_CALL, "execute_sql(%s)", result_name)
        if error := self._check_name(result_name):
            return error
        known = {r.id: r.column_names for r in self.references}
        try:
            frame, used = analyse(self._session(), query, known)
            order = [x for x in known if x in used]
            reference, kept = self._prepare(result_name, frame, description=result_description, parent_ids=order, source_query=query)
        except QueryError as error:
            logger.warning("execute_sql: %s", error.message)
            return ToolCallError(error_type=error.kind, message=error.message, details={"query": query, **error.details})
        except (PySparkException, ValueError) as error:
            logger.warning("execute_sql: %s", error)
            return ToolCallError(error_type="SQLExecutionError", message=str(error).splitlines()[0] or type(error).__name__, details={"query": query})
        self._registry.register(reference, kept)
        return reference

    def _session(self) -> SparkSession:
        ids = self._registry.context.dataframe_ids
        return self._registry.context.get_dataframe(ids[0]).sparkSession if ids else SparkSession.builder.getOrCreate()

    def view_as_markdown_table(self, *, identifier: str, columns: list[str] | None = None, num_rows: int = DEFAULT_ROWS, sample: bool = False, seed: int | None = None) -> str | ToolCallError:
        """A few rows of a table as markdown: the first and last ones around an ellipsis, or a random sample.

        identifier: name or id. columns: which ones, all by default. num_rows: how many. sample: draw at random, by seed.
        """
        logger.log(TOOL_CALL, "view_as_markdown_table(%s)", identifier)
        found = self._find(identifier)
        if isinstance(found, ToolCallError):
            return found
        if columns and len(set(columns)) < len(columns):
            return ToolCallError(error_type="DuplicateColumns", message=f"columns are listed twice: {', '.join(sorted({c for c in columns if columns.count(c) > 1}))}", details={"columns": columns})
        if columns and (missing := [c for c in columns if c not in found.column_names]):
            return ToolCallError(error_type="InvalidColumns", message=f"no such columns: {', '.join(missing)}; available: {', '.join(found.column_names)}", details={"missing": missing, "available": found.column_names})
        try:
            return preview(self._registry.context.snapshot(found.id), columns, num_rows, sample, seed)
        except ValueError as error:
            return ToolCallError(error_type="InvalidArgument", message=str(error), details={})

    # state

    def export_state(self) -> DataFrameToolkitState:
        """References only; data never leaves Spark."""
        return DataFrameToolkitState(references=list(self.references))

    @classmethod
    def from_state(cls, state: DataFrameToolkitState, base_dataframes: Mapping[str, DataFrame], *, rel_tol: float = REL_TOL) -> DataFrameToolkit:
        """A toolkit as it was exported, from the same base tables (by name or id); ValueError if anything differs."""
        return cls(restore(state, base_dataframes, rel_tol))


