"""Event-stream analytics on Spark: windowed aggregates, running series functions, a SQL dialect and continuous queries."""

from .expr import call, call_with_namespace, col, qualified_col, value, wildcard, wildcard_with_table
from .operators.frame import StreamFrame
from .operators.window import Window
from .sql.planner import sql

__all__ = ["StreamFrame", "Window", "call", "call_with_namespace", "col", "qualified_col", "sql", "value", "wildcard", "wildcard_with_table"]
