"""Connected components; the code is among the library's functions."""

from tablewright.functions.components import components

__all__ = ["components"]
