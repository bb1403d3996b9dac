"""End to end: export folder and line to records, summary, checks and files."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.config import MODES, LineConfig
from lineweave.functions.geo import albers
from lineweave.operators.match import line_segments, match_tracks
from lineweave.plans.audit import audit_flags, in_review
from lineweave.plans.features import GUIDE_AMENITIES, Reference, as_objects, named_sources, published_access_points, published_locks, registry
from lineweave.plans.invariants import gate, published_violations
from lineweave.plans.publish import json_text, minimal_csv, publish, write_if_changed
from lineweave.plans.records import activity_records, coverage_summary
from lineweave.plans.render import svg_map
from lineweave.scratch import cut
from lineweave.sources.catalog import Catalog, load_catalog
from lineweave.sources.reference_json import load_access_points, load_guide, load_locks, load_object, read_text
from lineweave.sources.tracks import read_tracks


@dataclass(frozen=True)
class Build:
    records: DataFrame
    coverage: dict[str, Any]
    issues: DataFrame
    catalog: Catalog
    line: list[tuple[float, float]]
    bins: DataFrame

    def report(self) -> str:
        by_code = {r["code"]: r["count"] for r in self.issues.groupBy("code").count().orderBy("code").collect()}
        by_type = {r["activity_type"]: r["count"] for r in self.records.groupBy("activity_type").count().collect()}
        lines = [f"rows: {self.catalog.total_rows}", f"candidates: {self.catalog.candidate_rows}", f"covered: {self.coverage['activity_count']}", *(f"  {m}: {by_type.get(m, 0)}" for m in MODES), f"miles: {self.coverage['combined_unique_miles']:.2f} ({self.coverage['combined_percent_complete']:.3f} %)", "issues:", *(f"  {k}: {n}" for k, n in by_code.items())]
        return "\n".join(lines)


def projected_line(spark: SparkSession, line: list[tuple[float, float]]) -> DataFrame:
    x, y = albers(F.col("lon"), F.col("lat"))
    return spark.createDataFrame([(k, *p) for k, p in enumerate(line)], "seq int, lon double, lat double").select("seq", x.alias("x"), y.alias("y"))


def match_export(spark: SparkSession, folder: str, line: list[tuple[float, float]], url_prefix: str = "", line_sha256: str | None = None, cfg: LineConfig = LineConfig()) -> Build:
    catalog = load_catalog(spark, folder)
    activities = cut(catalog.activities, "activities")
    points, track_issues = read_tracks(spark, activities.filter(F.col("track").isNotNull()), folder)
    x, y = albers(F.col("lon"), F.col("lat"))
    points = cut(points.select("activity_id", "seq", "ts", x.alias("x"), y.alias("y")), "points")
    segments = line_segments(projected_line(spark, line))
    length = segments.agg(F.sum("length")).first()[0]
    stats, bins = match_tracks(points, segments, length, cfg, len(line) - 1)
    bins = cut(bins, "activity-bins")
    records = cut(activity_records(activities, stats, bins, url_prefix, cfg), "records")
    coverage = coverage_summary(records, bins.join(records.select("activity_id", "activity_type"), "activity_id"), line_sha256, cfg)
    issues = catalog.issues.unionByName(track_issues)
    return Build(records, coverage, issues, catalog, line, bins)


def audit(build: Build, cfg: LineConfig = LineConfig()) -> DataFrame:
    """(activity_id, what the report says of it, flags) of the records that have any."""
    rows = build.records.select("activity_id", "date", "activity_type", "activity_name", "new_co_unique_miles", "min_milepost", "max_milepost", "match_percentage", "matched_point_count", "co_travel_miles", F.col("strava_distance_miles").alias("distance_miles"), F.size("segments").alias("n_segments"), F.col("matching_diagnostics.median_distance_meters").alias("median_offset"), "co_unique_miles", in_review(F.col("segments"), cfg).alias("in_review"))
    return rows.withColumn("flags", audit_flags(cfg)).filter(F.size("flags") > 0)


def audit_report(build: Build, cfg: LineConfig = LineConfig()) -> str:
    """Counts, completion, one line for each activity to review, and the input's issues by code."""
    found = audit(build, cfg).orderBy("activity_id").collect()  # a line of the report each
    lines = [f"candidates: {build.catalog.candidate_rows}", f"covered: {build.coverage['activity_count']}", f"miles: {build.coverage['combined_unique_miles']:.2f}", f"completion: {build.coverage['combined_percent_complete']:.3f} %", f"to review: {len(found)}"]
    for r in found:
        far = "unknown" if r["distance_miles"] is None else f"{r['distance_miles']:.3f}"
        lines.append(f"  {r['activity_id']}: {r['date']}, {r['activity_type']}, {r['activity_name']}, {far} mi, {r['co_travel_miles']:.3f} mi on the line, {r['co_unique_miles']:.2f} unique, {r['new_co_unique_miles']:.2f} new, {r['min_milepost']:.2f}-{r['max_milepost']:.2f}, {r['match_percentage']:.2f} % matched: {', '.join(r['flags'])}")
    codes = {r["code"]: r["count"] for r in build.issues.groupBy("code").count().orderBy("code").collect()}
    return "\n".join(lines + [f"issues: {', '.join(f'{k}={n}' for k, n in codes.items())}"] * bool(codes))


def load_reference(spark: SparkSession, access_points: str, locks: str, guide: str | None = None, lock_count: int | None = None) -> Reference:
    """The reference files, checked; without a guide nothing is said of amenities."""
    objects = [load_object(spark, p) for p in (access_points, locks)] + [load_object(spark, guide) if guide else None]
    return Reference(load_access_points(spark, access_points), load_locks(spark, locks, lock_count), load_guide(spark, guide, GUIDE_AMENITIES) if guide else None, named_sources(*objects))


def feature_objects(build: Build, reference: Reference, cfg: LineConfig = LineConfig()) -> tuple[list[dict], list[dict]]:
    """Access points and locks as they are published."""
    spark = build.records.sparkSession
    gaps = [(s["start_milepost"], s["end_milepost"], s["miles"]) for s in build.coverage["remaining_segments"]]
    remaining = spark.createDataFrame(gaps, "start_milepost double, end_milepost double, miles double")
    bins = build.bins.join(build.records.select("activity_id", "ts", F.col("activity_type").alias("mode")), "activity_id").select("activity_id", "ts", "mode", "bin")
    return as_objects(published_access_points(reference, build.records, bins, remaining, cfg), published_locks(reference, build.records, bins, remaining, cfg))


def line_digest(spark: SparkSession, path: str) -> str:
    return hashlib.sha256(read_text(spark, path).encode()).hexdigest()


#: The columns of the private flat file.
PROCESSED_COLUMNS = ("activity_id", "date", "start_time", "datetime", "activity_name", "activity_type", "strava_distance_miles", "co_travel_miles", "co_unique_miles", "new_co_unique_miles", "cumulative_unique_miles", "cumulative_percent_complete", "min_milepost", "max_milepost", "moving_time_minutes", "elapsed_time_minutes", "elevation_gain_feet", "average_heart_rate", "max_heart_rate", "calories", "matched_point_count", "total_gps_point_count", "match_percentage", "strava_url")


def write(build: Build, private: Path, public: Path, cfg: LineConfig = LineConfig(), reference: Reference | None = None) -> list[Path]:
    """The gate, then private and public files, then the map; nothing is written if a rule is broken. With reference files
    all 13 public files are written, else those of activities and coverage."""
    gate(published_violations(build.records, build.coverage, cfg))
    rows = [r.asDict(recursive=True) for r in build.records.orderBy("ts", "activity_id").collect()]  # one row per activity that covered something
    for r in rows:
        r["datetime"] = r.pop("ts").isoformat()
        r["start_time"] = r.pop("time")
    places, locks = feature_objects(build, reference, cfg) if reference else ([], [])
    done = [private / "activities.json", private / "coverage.json", private / "activities.csv"]
    texts = (json_text(rows), json_text(build.coverage), minimal_csv(rows, PROCESSED_COLUMNS))
    changed = [p for p, t in zip(done, texts, strict=True) if write_if_changed(p, t)]
    if reference:
        named = reference.sources or {}
        own = {"access_points": named.get("co_canal_association_access_points", {}), "locks": [named[k] for k in ("nps_lift_locks", "co_canal_trust_locks") if k in named]}
        changed += publish(public, rows, build.coverage, places, locks, registry(named), reference.amenities, own)
    else:
        changed += publish(public, rows, build.coverage)
    plane = [(r["x"], r["y"]) for r in projected_line(build.records.sparkSession, build.line).orderBy("seq").collect()]
    if write_if_changed(public / "map.svg", svg_map(plane, build.coverage["completed_segments"], cfg=cfg)):
        changed.append(public / "map.svg")
    return changed
