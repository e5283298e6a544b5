"""Driver-side argument rules shared by the query functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

# Fixed limits: (default, maximum).
SEARCH_LIMIT = (5, 25)
DIARY_LIMIT = (10, 100)
HOPS_LIMIT = (2, 5)
GROUP_LIMIT = 200
DUPLICATE_THRESHOLD = 0.9
CLEANUP_THRESHOLD = 0.85
CLEANUP_MIN_GROUP = 5


def clamp_positive(value: int | None, bounds: tuple[int, int]) -> int:
    """Missing or non-positive values take the default; large ones the maximum."""
    default, maximum = bounds
    return default if value is None or value <= 0 else min(value, maximum)


def clamp_threshold(value: float) -> float:
    if math.isnan(value) or math.isinf(value):
        return DUPLICATE_THRESHOLD
    return min(1.0, max(0.0, value))


def parse_switch(value: str | None) -> bool | None:
    """Boolean environment switch; None when the text is neither on nor off."""
    word = (value or "").strip().lower()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("0", "false", "no", "off"):
        return False
    return None


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an ordered frame; ``None`` keeps all."""
    return ordered if limit is None else ordered.limit(limit)
