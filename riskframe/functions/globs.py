"""Path globs.

``*`` and ``?`` stay inside one path segment, a segment that is exactly ``**``
stands for any number of segments, everything else is literal.  A pattern names
a whole path from the root and is case-sensitive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column

_GLOB_PIECE = re.compile(
    r"(?P<deep>(?:^|(?<=/))\*\*/)|(?P<rest>(?:^|(?<=/))\*\*$)|(?P<star>\*)|(?P<one>\?)|(?P<text>[^*?]+)"
)
_PIECE_REGEX = {"deep": r"(?:[^/]+/)*", "rest": r"[^\n]*", "star": r"[^/]*", "one": r"[^/]"}


def glob_to_regex(pattern: str) -> str:
    """Body of the regular expression for a glob, without anchors."""
    return "".join(
        _PIECE_REGEX.get(piece.lastgroup) or re.escape(piece.group())
        for piece in _GLOB_PIECE.finditer(pattern)
    )


def glob_matches(path: Column, pattern: str) -> Column:
    """Whether ``path`` matches the glob as a whole."""
    return path.rlike(rf"\A(?:{glob_to_regex(pattern)})\z")
