"""User functions for term maps."""

from quadweave.functions.registry import FunctionRegistry, default_functions

__all__ = ["FunctionRegistry", "default_functions"]
