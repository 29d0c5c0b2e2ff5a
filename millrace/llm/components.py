"""Connected components of an edge table; they are of use outside this subpackage, too, so the core library has them."""

from ..operators.graphs import components

__all__ = ["components"]
