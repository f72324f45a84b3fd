"""The search language: tokens, syntax tree, numbers and dates. Pure Python, no Spark."""

from quarryline.lang.ast import QueryError
from quarryline.lang.parser import parse
from quarryline.lang.values import Clock

__all__ = ["Clock", "QueryError", "parse"]
