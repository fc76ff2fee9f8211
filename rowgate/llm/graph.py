"""Connected components of links, as the rest of the library has them."""

from rowgate.operators.graph import components

__all__ = ["components"]
