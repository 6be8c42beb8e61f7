"""What can be wrong with a query, in the order in which it is looked for."""

from __future__ import annotations


class QueryError(Exception):
    """A query that is refused or fails; ``kind`` names it in tool answers."""

    kind = "SQLExecutionError"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message)
        self.message, self.details = message, details

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.message!r})"


class QuerySyntaxError(QueryError):
    kind = "SQLSyntaxError"


class QueryCommandError(QueryError):
    kind = "SQLBlacklistedCommand"


class QueryTableError(QueryError):
    kind = "SQLTableError"


class QueryColumnError(QueryError):
    kind = "SQLColumnError"


class QueryExecutionError(QueryError):
    kind = "SQLExecutionError"
