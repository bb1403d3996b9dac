"""Matching tracks to the line: nearest segment, plausible legs, runs, and what each activity covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.config import LineConfig
from lineweave.functions.geo import project_on_segment
from lineweave.operators.bins import leg_bins

#: Reference lines of up to so many segments are broadcast; a longer one is joined by shuffle on the grid cell.
BROADCAST_SEGMENTS = 100_000


def line_segments(vertices: DataFrame) -> DataFrame:
    """(idx, x1, y1, x2, y2, length, start) of the line through (seq, x, y); start is the length before the segment."""
    along = W.partitionBy(F.lit(0)).orderBy("seq")
    pairs = vertices.select((F.row_number().over(along) - 1).alias("idx"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(along).alias("x2"), F.lead("y").over(along).alias("y2")).filter(F.col("x2").isNotNull())
    sized = pairs.withColumn("length", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return sized.withColumn("start", F.sum("length").over(W.partitionBy(F.lit(0)).orderBy("idx")) - F.col("length"))


def nearest_segment(points: DataFrame, segments: DataFrame, tolerance: float, keys: tuple[str, ...], n_segments: int | None = None) -> DataFrame:
    """points' columns, then idx, offset, along of the nearest segment within the tolerance (inclusive); else null.

    Ties go to the lowest idx. keys name a point. Segments are entered in every grid cell that they may touch when
    widened by the tolerance, so each point meets the segments of its own cell by an equi-join only.
    """
    cell = 2 * tolerance
    at = lambda c: F.floor(c / cell).cast("long")
    low = lambda a, b: at(F.least(a, b) - tolerance)
    high = lambda a, b: at(F.greatest(a, b) + tolerance)
    xs = F.sequence(low(F.col("x1"), F.col("x2")), high(F.col("x1"), F.col("x2")))
    ys = F.sequence(low(F.col("y1"), F.col("y2")), high(F.col("y1"), F.col("y2")))
    entered = segments.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))
    # a long slanting segment crosses few cells of its box: those whose middle is too far from it go
    middle = project_on_segment((F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))[1]
    entered = entered.filter(middle <= tolerance + cell * 0.7072)
    if n_segments is not None and n_segments <= BROADCAST_SEGMENTS:
        entered = F.broadcast(entered)
    placed = points.withColumns({"_px": at(F.col("x")), "_py": at(F.col("y"))})
    share, offset = project_on_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    met = placed.join(entered, (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")))
    near = met.withColumns({"_offset": offset, "_along": F.col("start") + share * F.col("length")}).filter(F.col("_offset") <= tolerance)
    best = near.groupBy(*keys).agg(F.min(F.struct(F.col("_offset").alias("offset"), "idx", F.col("_along").alias("along"))).alias("_best"))
    return points.join(best, list(keys), "left").select(*points.columns, F.col("_best.idx").alias("idx"), F.col("_best.offset").alias("offset"), F.col("_best.along").alias("along"))


def legs(points: DataFrame, cfg: LineConfig = LineConfig(), source: Column | None = None) -> DataFrame:
    """points (activity_id, seq, ts, x, y, along, accepted) with the leg to the next row: source_distance,
    along_distance, plausible; the last row of a track has no leg (null). A null time skips the test of time."""
    order = W.partitionBy("activity_id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(order)
    withnext = points.withColumns({"_x": nxt("x"), "_y": nxt("y"), "next_along": nxt("along"), "_ts": nxt("ts"), "_ok": nxt("accepted"), "_seq": nxt("seq")})
    source = F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")) if source is None else source
    gap = (F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    measured = withnext.withColumns({"source_distance": source, "along_distance": F.abs(F.col("next_along") - F.col("along")), "_gap": gap})
    timely = F.coalesce(F.col("_gap").between(0, cfg.max_time_gap), F.lit(True))
    aside = (F.col("source_distance") >= cfg.min_alignment_distance) & (F.try_divide("along_distance", "source_distance") < cfg.min_alignment_ratio)
    fits = F.col("accepted") & F.col("_ok") & (F.col("source_distance") <= cfg.max_source_gap) & (F.col("along_distance") <= cfg.max_along_gap) & timely & ~aside
    plausible = F.when(F.col("_seq").isNotNull(), F.coalesce(fits, F.lit(False)))
    return measured.withColumn("plausible", plausible).drop("_x", "_y", "_ts", "_ok", "_seq", "_gap")


def runs(legged: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """The plausible legs with run and, for each run of adjacent ones, whether it is kept: enough points and travel."""
    order = W.partitionBy("activity_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = legged.filter(F.col("plausible").isNotNull()).withColumn("run", F.sum(F.when(F.col("plausible"), 0).otherwise(1)).over(order))
    plausible = numbered.filter("plausible")
    own = W.partitionBy("activity_id", "run")
    return plausible.withColumns({"run_points": F.count("*").over(own) + 1, "run_travel": F.sum("along_distance").over(own)}).withColumn("kept", (F.col("run_points") >= cfg.min_run_points) & (F.col("run_travel") >= cfg.min_run_travel))


def point_statistics(points: DataFrame) -> DataFrame:
    """(activity_id, total_points, matched_points, median_offset, p90_offset): offsets of accepted points, interpolated."""
    mine = F.when(F.col("accepted"), F.col("offset"))
    return points.groupBy("activity_id").agg(F.count("*").alias("total_points"), F.count_if("accepted").alias("matched_points"), F.median(mine).alias("median_offset"), F.percentile(mine, F.lit(0.9)).alias("p90_offset"))


def alignment(legged: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """(activity_id, median_alignment): along over source, of plausible legs that are long enough to tell."""
    told = legged.filter(F.col("plausible") & (F.col("source_distance") >= cfg.min_alignment_distance))
    return told.groupBy("activity_id").agg(F.median(F.col("along_distance") / F.col("source_distance")).alias("median_alignment"))


def match_tracks(points: DataFrame, segments: DataFrame, line_length: float, cfg: LineConfig = LineConfig(), n_segments: int | None = None) -> tuple[DataFrame, DataFrame]:
    """points (activity_id, seq, ts, x, y) -> (per activity: travel_miles, counts and diagnostics; rows (activity_id, bin))."""
    placed = nearest_segment(points, segments, cfg.match_tolerance, ("activity_id", "seq"), n_segments).withColumn("accepted", F.col("offset").isNotNull())
    legged = legs(placed.repartition("activity_id"), cfg)
    kept = runs(legged, cfg).filter("kept")
    mile = lambda c: F.col(c) / line_length * cfg.line_miles
    kept = kept.withColumns({"mp1": mile("along"), "mp2": mile("next_along")})
    travel = kept.groupBy("activity_id").agg(F.sum(F.abs(F.col("mp2") - F.col("mp1"))).alias("travel_miles"))
    stats = point_statistics(placed).join(travel, "activity_id", "left").join(alignment(legged, cfg), "activity_id", "left")
    stats = stats.withColumn("travel_miles", F.coalesce("travel_miles", F.lit(0.0)))
    bins = kept.select("activity_id", F.explode(leg_bins(F.col("mp1"), F.col("mp2"), cfg)).alias("bin")).distinct()
    return stats, bins
