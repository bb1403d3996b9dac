"""Activity records and the coverage summary, from matches: what is published and what stays private."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.config import MODES, LineConfig
from lineweave.operators import history as hist
from lineweave.operators.bins import as_segments, islands

#: The fields that may be published of an activity. Times, heart rates, calories, notes, file names and diagnostics aren't among them.
PUBLIC_FIELDS = ("activity_id", "activity_name", "activity_type", "co_travel_miles", "co_unique_miles", "cumulative_percent_complete", "cumulative_unique_miles", "date", "elevation_gain_feet", "max_milepost", "min_milepost", "moving_time_minutes", "new_co_unique_miles", "segments", "strava_distance_miles", "strava_url")
#: The order of the flat file's columns.
CSV_FIELDS = ("activity_id", "date", "activity_name", "activity_type", "strava_distance_miles", "co_travel_miles", "co_unique_miles", "new_co_unique_miles", "cumulative_unique_miles", "cumulative_percent_complete", "min_milepost", "max_milepost", "moving_time_minutes", "elevation_gain_feet", "strava_url")


def activity_records(activities: DataFrame, stats: DataFrame, bins: DataFrame, url_prefix: str = "", cfg: LineConfig = LineConfig()) -> DataFrame:
    """One row per activity that covered a bin. activities: the catalog's; stats and bins: match_tracks().

    Rounding is half-even on doubles; bin mileages never tie.
    """
    placed = bins.join(activities.select("activity_id", "ts", "mode"), "activity_id")
    history = hist.coverage_history(placed.select("activity_id", "ts", "bin"))
    runs = as_segments(islands(bins, ("activity_id",)), cfg)
    listed = runs.groupBy("activity_id").agg(F.sort_array(F.collect_list(F.struct("start_milepost", "end_milepost", "miles"))).alias("segments"))
    rows = history.drop("ts").join(listed, "activity_id").join(stats, "activity_id").join(activities, "activity_id")
    two = lambda c: F.bround(c, 2)
    mile = lambda c: two(F.col(c) * cfg.bin_miles)
    return rows.select(
        "activity_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm:ss'Z'").alias("time"),
        "activity_name",
        F.col("mode").alias("activity_type"),
        F.bround(F.col("distance_meters") / cfg.meters_per_mile, 3).alias("strava_distance_miles"),
        F.bround("travel_miles", 3).alias("co_travel_miles"),
        mile("unique_bins").alias("co_unique_miles"),
        mile("new_bins").alias("new_co_unique_miles"),
        mile("cumulative_bins").alias("cumulative_unique_miles"),
        F.bround(F.col("cumulative_bins") * cfg.bin_miles / cfg.line_miles * 100, 3).alias("cumulative_percent_complete"),
        F.element_at("segments", 1)["start_milepost"].alias("min_milepost"),
        F.element_at("segments", -1)["end_milepost"].alias("max_milepost"),
        two(F.col("moving_seconds") / 60).alias("moving_time_minutes"),
        two(F.col("elapsed_seconds") / 60).alias("elapsed_time_minutes"),
        F.bround(F.col("elevation_gain_meters") / cfg.meters_per_foot, 1).alias("elevation_gain_feet"),
        F.bround(F.col("elevation_loss_meters") / cfg.meters_per_foot, 1).alias("elevation_loss_feet"),
        "average_heart_rate",
        "max_heart_rate",
        "calories",
        "description",
        "filename",
        F.col("matched_points").alias("matched_point_count"),
        F.col("total_points").alias("total_gps_point_count"),
        two(F.coalesce(F.try_divide(F.col("matched_points") * 100.0, F.col("total_points")), F.lit(0.0))).alias("match_percentage"),
        F.struct(two("median_offset").alias("median_distance_meters"), two("p90_offset").alias("p90_distance_meters"), F.bround("median_alignment", 3).alias("median_alignment_ratio")).alias("matching_diagnostics"),
        "segments",
        F.concat(F.lit(url_prefix), F.col("activity_id").cast("string")).alias("strava_url"),
    )


def coverage_summary(records: DataFrame, bins: DataFrame, line_sha256: str | None = None, cfg: LineConfig = LineConfig()) -> dict[str, Any]:
    """The summary object; bins: (activity_type, bin). Only islands, gaps and a few sums come to the driver."""
    parts: dict[tuple[str, str], list[dict[str, float]]] = {}
    scoped = hist.scope_segments(bins, cfg.bin_count, MODES, "activity_type").withColumnsRenamed({"start_bin": "a", "end_bin": "b"})
    totals: dict[tuple[str, str], int] = {}
    for r in scoped.orderBy("a").collect():
        key = (r["coverage_scope"], r["coverage_status"])
        segment = {"start_milepost": round(r["a"] * cfg.bin_miles, 2), "end_milepost": round(r["b"] * cfg.bin_miles, 2), "miles": round((r["b"] - r["a"]) * cfg.bin_miles, 2)}
        parts.setdefault(key, []).append(segment)
        totals[key] = totals.get(key, 0) + r["bins"]
    done = parts.get(("combined", "completed"), [])
    covered = totals.get(("combined", "completed"), 0) * cfg.bin_miles
    seen = records.agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")).first()
    out: dict[str, Any] = {
        "canal_miles": cfg.line_miles,
        "bin_miles": cfg.bin_miles,
        "methodology": methodology(line_sha256, cfg),
        "combined_unique_miles": round(covered, 2),
        "combined_percent_complete": round(covered / cfg.line_miles * 100, 3),
        "remaining_miles": round(cfg.line_miles - covered, 2),
        "activity_count": seen["n"],
        "first_activity_date": seen["first"],
        "latest_activity_date": seen["last"],
        "longest_continuous_completed_section": max(done, key=lambda s: s["miles"], default=None),
        "completed_segments": done,
        "remaining_segments": parts.get(("combined", "remaining"), []),
    }
    for mode in MODES:
        out[f"{mode}_unique_miles"] = round(totals.get((mode, "covered"), 0) * cfg.bin_miles, 2)
        out[f"{mode}_segments"] = parts.get((mode, "covered"), [])
    return out


def methodology(line_sha256: str | None, cfg: LineConfig) -> dict[str, Any]:
    return {
        "match_tolerance_meters": cfg.match_tolerance,
        "projected_crs": cfg.crs,
        "canonical_towpath_sha256": line_sha256,
        "continuity": {
            "max_source_gap_meters": cfg.max_source_gap,
            "max_along_gap_meters": cfg.max_along_gap,
            "max_time_gap_seconds": cfg.max_time_gap,
            "minimum_alignment_ratio": cfg.min_alignment_ratio,
            "minimum_alignment_distance_meters": cfg.min_alignment_distance,
            "minimum_run_points": cfg.min_run_points,
            "minimum_run_travel_meters": cfg.min_run_travel,
        },
        "audit_thresholds": {
            "low_match_percentage": cfg.low_match_percentage,
            "low_matched_point_count": cfg.low_matched_points,
            "travel_exceeds_strava_tolerance_miles": cfg.travel_excess_miles,
            "large_travel_excess_ratio": cfg.travel_excess_ratio,
            "parallel_min_median_offset_meters": cfg.parallel_median_offset,
            "parallel_min_unique_miles": cfg.parallel_unique_miles,
            "parallel_review_intervals": [{"start_milepost": a, "end_milepost": b} for a, b in cfg.parallel_intervals],
        },
    }
