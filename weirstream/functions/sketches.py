"""Mergeable sketches: distinct counts and percentiles, in one phase or two."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_slots(slots: int = 4096) -> int:
    """log2 of the number of slots, in the range that sketches take."""
    return max(4, min(21, int(math.log2(slots))))


def hyper_log_log(c: Column, slots: int = 4096) -> Column:
    """Approximate number of distinct values; nulls are ignored."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(log_slots(slots))))


def hyper_log_log_temporary(c: Column, slots: int = 4096) -> Column:
    """A partial sketch, to be merged by hyper_log_log_merge."""
    return F.hll_sketch_agg(c, F.lit(log_slots(slots)))


def hyper_log_log_merge(c: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(c))


def percentile(c: Column, q: float, compression: int = 100) -> Column:
    """Approximate quantile q in [0, 1]; NaN without values."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is not in [0, 1]")
    return F.coalesce(F.percentile_approx(c.cast("double"), F.lit(q), F.lit(100 * compression)), F.lit(float("nan")))


def percentile_temporary(c: Column) -> Column:
    """A partial sketch, to be merged by percentile_merge."""
    return F.kll_sketch_agg_double(c.cast("double"))


def percentile_merge(c: Column, q: float) -> Column:
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is not in [0, 1]")
    return F.coalesce(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(c), F.lit(q)), F.lit(float("nan")))
