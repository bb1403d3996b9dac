"""Review flags: they point at matches worth a look and change nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.config import LineConfig


def in_review(segments: Column, cfg: LineConfig = LineConfig()) -> Column:
    """Whether any segment (start_milepost, end_milepost) overlaps an interval that has a parallel trail."""
    return F.exists(segments, lambda s: F.reduce(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cfg.parallel_intervals)), F.lit(False), lambda hit, i: hit | ((s["start_milepost"] < i["b"]) & (s["end_milepost"] > i["a"]))))


def audit_flags(cfg: LineConfig = LineConfig()) -> Column:
    """Array of flags of a row (match_percentage, matched_point_count, co_travel_miles, distance_miles or null,
    n_segments, median_offset, co_unique_miles, in_review), in a fixed order.

    The flag for diagnostics that a record brings along has no source among the engine's own columns.
    """
    excess = F.col("co_travel_miles") - F.col("distance_miles")
    ratio = F.try_divide(excess, F.col("distance_miles"))
    rules = {
        "LOW_MATCH_PERCENTAGE": F.col("match_percentage") < cfg.low_match_percentage,
        "LOW_MATCHED_POINT_COUNT": F.col("matched_point_count") < cfg.low_matched_points,
        "CO_TRAVEL_EXCEEDS_STRAVA": excess > cfg.travel_excess_miles,
        "LARGE_CO_TRAVEL_DISCREPANCY": (excess > 0) & ((F.col("distance_miles") <= 0) | (ratio >= cfg.travel_excess_ratio)),
        "DISCONNECTED_MATCH": F.col("n_segments") > 1,
        "POSSIBLE_PARALLEL_TRAIL": (F.col("median_offset") >= cfg.parallel_median_offset) & (F.col("co_unique_miles") >= cfg.parallel_unique_miles) & F.col("in_review"),
    }
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
