"""The scalar functions of the query language over Spark columns."""

from . import nested, numbers, strings, times  # noqa: F401
from .registry import FUNCTIONS, Function, Value, function

__all__ = ["FUNCTIONS", "Function", "Value", "function"]
