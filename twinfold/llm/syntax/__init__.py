"""Table-driven parsers built from the grammars in this package.

`check(ext, src)` says whether a source text is valid and, if not, where the
first error is.
"""

from .languages import EXTENSIONS, check, warm

__all__ = ["EXTENSIONS", "check", "warm"]
