"""Mask a table against a stored token map and restore texts from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskframe.operators import tokens
from riskframe.scale import checkpointed
from riskframe.sources.tables import TokenMap


def mask_with_map(
    df: DataFrame, columns: Sequence[str], token_map: TokenMap, **options
) -> DataFrame:
    """Mask ``columns`` and add the new tokens to the map.

    The masked table is written to the checkpoint folder before the map changes, so
    that reading it later cannot number its values a second time.
    """
    masked, entries = tokens.mask_table(df, columns, token_map.read(), **options)
    masked, entries = checkpointed(masked), checkpointed(entries)
    if not entries.isEmpty():
        token_map.add(entries)
    return masked


def restore_with_map(df: DataFrame, column: str, token_map: TokenMap, **options) -> DataFrame:
    """Put original values back into ``column``."""
    return tokens.restore_texts(df, column, token_map.read(), **options)
