"""Connected components of a distributed edge list: the library's own, under the name the corpus operators use."""

from ..operators.components import components  # noqa: F401
