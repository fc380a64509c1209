"""Registry of functions usable in term maps.

A function takes Columns and returns a Column, so a built-in expression stays inside code generation
and a ``pandas_udf`` travels in Arrow batches; the registry does not care which one it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.errors import MappingError


@dataclass(frozen=True)
class MappingFunction:
    apply: Callable[..., Column]
    multi: bool = False  # returns an array: one term per element


class FunctionRegistry:
    def __init__(self) -> None:
        self._functions: dict[str, MappingFunction] = {}

    def register(self, iri: str, apply: Callable[..., Column], *, multi: bool = False) -> FunctionRegistry:
        """Add ``apply``. Its keyword arguments are the parameter names (local names of parameter IRIs)."""
        self._functions[iri] = MappingFunction(apply, multi)
        return self

    def find(self, iri: str) -> MappingFunction:
        try:
            return self._functions[iri]
        except KeyError:
            raise MappingError(f"function '{iri}' is not registered") from None

    def copy(self) -> FunctionRegistry:
        other = FunctionRegistry()
        other._functions.update(self._functions)
        return other


FN = "http://www.w3.org/2005/xpath-functions#"


def default_functions() -> FunctionRegistry:
    """A few XPath functions every mapping may call."""
    registry = FunctionRegistry()
    registry.register(FN + "upper-case", lambda value: F.upper(value))
    registry.register(FN + "lower-case", lambda value: F.lower(value))
    registry.register(FN + "concat", lambda **parts: F.concat(*parts.values()))
    registry.register(FN + "tokenize", lambda value, pattern: F.split(value, pattern), multi=True)
    return registry
