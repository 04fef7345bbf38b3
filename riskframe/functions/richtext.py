"""Plain text of rich-text issue descriptions.

The description of an issue is either a string or a tree of nodes.  Spark has no
recursive type, so the tree is walked in an Arrow-batched function; plain strings
are decided on the JVM side and never reach Python.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from riskframe import constants as C
from riskframe.functions.text import strip


def node_text(node: object) -> str:
    """Text of one parsed node."""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return " ".join(map(node_text, node))
    if not isinstance(node, dict):
        return ""
    kind = node.get("type", "")
    own = node.get("text", "")
    if kind == "text":
        return own
    if kind in C.RICH_TEXT_ATTRIBUTE:
        return (node.get("attrs") or {}).get(C.RICH_TEXT_ATTRIBUTE[kind], "")
    inner = " ".join(filter(None, map(node_text, node.get("content") or [])))
    return inner if inner or kind in C.RICH_TEXT_CONTAINERS else own


@F.pandas_udf(StringType())
def _tree_text(trees: pd.Series) -> pd.Series:
    def walk(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            return node_text(json.loads(raw))
        except ValueError:
            return raw

    return trees.map(walk)


def description_text(description: Column) -> Column:
    """Trimmed plain text of a raw description column; missing gives ``''``."""
    is_tree = F.ltrim(description).startswith("{")
    trees = F.when(is_tree, description)
    plain = F.when(is_tree, _tree_text(trees)).otherwise(description)
    return strip(F.coalesce(plain, F.lit("")))
