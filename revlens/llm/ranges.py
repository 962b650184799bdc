"""Ranges of a key of about equal size, for orders over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(rows: DataFrame, key: str, ranges: int) -> list:
    """Sorted distinct bounds that cut the key into at most ``ranges`` parts; from approximate
    percentiles of all rows. The driver gets one value for each range."""
    if ranges < 2:
        return []
    shares = [number / ranges for number in range(1, ranges)]
    return sorted(set(rows.agg(F.percentile_approx(key, shares, 10 * ranges)).first()[0] or []))


def range_number(key: Column, bounds: list) -> Column:
    """How many bounds are at or under the key (null: none), found in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.ceil(math.sqrt(len(bounds)))
    done = F.size(F.filter(F.lit(bounds[step - 1 :: step]), lambda bound: bound <= key)) * step
    return done + F.size(F.filter(F.slice(F.lit(bounds), done + 1, F.lit(step)), lambda bound: bound <= key))
