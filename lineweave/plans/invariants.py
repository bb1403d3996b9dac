"""What must hold of every result. Each rule is one aggregate; a gate raises before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.config import MODES, LineConfig
from lineweave.operators.bins import edge_bin, explode_segments, on_edge

MILES, PERCENT = 0.005 + 1e-9, 0.0005 + 1e-9


class InvariantError(RuntimeError):
    """A result breaks a rule; nothing has been written."""


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def history_violations(history: DataFrame, bins: DataFrame, domain: int) -> DataFrame:
    """(rule, violations) of a history (activity_id, ts, unique_bins, new_bins, cumulative_bins) over bins.

    Order rules look at each row and the next one of its day, and at the days' ends; no window holds all rows.
    """
    day = W.partitionBy(F.to_date("ts")).orderBy("ts", "activity_id")
    seen = history.withColumn("_before", F.lag("cumulative_bins").over(day))
    one = seen.agg(
        F.count_if(F.col("new_bins") < 0).alias("new_not_negative"),
        F.count_if(F.col("new_bins") > F.col("unique_bins")).alias("new_at_most_unique"),
        F.count_if(F.col("cumulative_bins") < F.col("_before")).alias("cumulative_never_falls"),
        F.max("cumulative_bins").alias("_final"),
        F.sum("new_bins").alias("_new"),
        F.max_by("cumulative_bins", F.struct("ts", "activity_id")).alias("_last"),
    )
    union = bins.agg(F.count_distinct("bin").alias("_union"), F.count_if((F.col("bin") < 0) | (F.col("bin") >= domain)).alias("within_line"))
    differs = lambda a, b: F.coalesce((F.col(a) != F.col(b)).cast("long"), F.lit(0))
    row = one.join(F.broadcast(union)).select("new_not_negative", "new_at_most_unique", "cumulative_never_falls", differs("_final", "_union").alias("final_is_union"), differs("_new", "_union").alias("sum_of_new_is_union"), "within_line", differs("_last", "_final").alias("chronological"))
    rules = F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in row.columns))
    return row.select(F.inline(rules))


def segment_violations(rows: DataFrame, key: tuple[str, ...], cfg: LineConfig = LineConfig()) -> DataFrame:
    """(rule, violations) of published segments (key, pos, start_milepost, end_milepost, miles)."""
    s, e = F.col("start_milepost"), F.col("end_milepost")
    before = F.lag("end_milepost").over(W.partitionBy(*key).orderBy("pos"))
    checked = rows.withColumn("_before", before)
    one = checked.agg(
        F.count_if(s.isNull() | e.isNull() | F.col("miles").isNull()).alias("well_formed"),
        F.count_if((s < 0) | (s >= e) | (e > cfg.line_miles)).alias("inside_line"),
        F.count_if(s < F.col("_before") - 1e-8).alias("ordered_apart"),
        F.count_if(~on_edge(s, cfg) | ~on_edge(e, cfg)).alias("on_bin_edges"),
        F.count_if(~close(F.col("miles"), e - s, 1e-8)).alias("miles_from_ends"),
    )
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in one.columns))))


def published_violations(activities: DataFrame, coverage: dict, cfg: LineConfig = LineConfig()) -> dict[str, int]:
    """Rules of a published result: activities (activity_id, activity_type, date, segments, the mileages), coverage summary.

    With ts, the new and the cumulative miles of each activity are held against those recomputed from the segments.
    """
    spark = activities.sparkSession
    flat = activities.select("activity_id", "activity_type", F.posexplode("segments").alias("pos", "s")).select("activity_id", "activity_type", "pos", "s.*")
    out = {r["rule"]: r["violations"] for r in segment_violations(flat, ("activity_id",), cfg).collect()}
    binned = explode_segments(flat.withColumns({"_a": edge_bin(F.col("start_milepost"), cfg), "_b": edge_bin(F.col("end_milepost"), cfg)}), "_a", "_b").select("activity_id", "activity_type", "bin")
    own = binned.groupBy("activity_id").agg(F.count_distinct("bin").alias("n"))
    rows = activities.join(own, "activity_id", "left")
    mile = lambda n: n * cfg.bin_miles
    counted = rows.agg(
        F.count_if(F.col("n").isNull()).alias("has_bins"),
        F.count_if(~F.col("activity_type").isin(*MODES)).alias("known_type"),
        F.count_if(F.col("new_co_unique_miles") < 0).alias("new_not_negative"),
        F.count_if(F.col("new_co_unique_miles") > F.col("co_unique_miles") + MILES).alias("new_at_most_unique"),
        F.count_if(~close(F.col("co_unique_miles"), mile(F.col("n")), MILES)).alias("unique_is_bins"),
        F.count_if(~close(F.col("cumulative_percent_complete"), F.col("cumulative_unique_miles") / cfg.line_miles * 100, PERCENT)).alias("percent_of_line"),
        F.count_if((F.col("cumulative_percent_complete") < 0) | (F.col("cumulative_percent_complete") > 100)).alias("percent_range"),
        F.count_if(~F.col("min_milepost").between(0, cfg.line_miles) | ~F.col("max_milepost").between(F.col("min_milepost"), F.lit(cfg.line_miles))).alias("milepost_range"),
        F.count_if(~close(F.col("min_milepost"), F.element_at("segments", 1)["start_milepost"], MILES) | ~close(F.col("max_milepost"), F.element_at("segments", -1)["end_milepost"], MILES)).alias("milepost_ends"),
        F.max("cumulative_unique_miles").alias("_final"),
        F.sum("new_co_unique_miles").alias("_new"),
    ).first()
    out |= {k: v for k, v in counted.asDict().items() if k[0] != "_"}
    if "ts" in activities.columns:
        out |= _order_violations(activities, binned, cfg)
    sets = {r["mode"]: r["n"] for r in binned.select("bin", F.col("activity_type").alias("mode")).distinct().groupingSets([[F.col("mode")], []], "mode").agg(F.count_distinct("bin").alias("n")).collect()}
    near = lambda a, b, t=MILES: int(abs((a or 0) - b) > t)
    union = sets.get(None, 0) * cfg.bin_miles
    out["final_is_union"] = near(counted["_final"], union)
    out["sum_of_new_is_union"] = near(counted["_new"], union, MILES * max(1, activities.count()))
    out["combined_miles"] = near(coverage["combined_unique_miles"], union)
    out["combined_percent"] = near(coverage["combined_percent_complete"], union / cfg.line_miles * 100, PERCENT)
    out["remaining_miles"] = near(coverage["remaining_miles"], cfg.line_miles - union)
    for mode in MODES:
        out[f"{mode}_miles"] = near(coverage[f"{mode}_unique_miles"], sets.get(mode, 0) * cfg.bin_miles)

    def bins_of(name: str) -> DataFrame:
        given = [(float(s["start_milepost"]), float(s["end_milepost"])) for s in coverage[name]]
        frame = spark.createDataFrame(given, "start_milepost double, end_milepost double")
        return explode_segments(frame.withColumns({"_a": edge_bin(F.col("start_milepost"), cfg), "_b": edge_bin(F.col("end_milepost"), cfg)}), "_a", "_b").select("bin")

    done, left = bins_of("completed_segments"), bins_of("remaining_segments")
    out["completed_apart_from_remaining"] = done.intersect(left).count()
    every = binned.select("bin")
    out["completed_is_union"] = done.exceptAll(every.distinct()).count() + every.distinct().exceptAll(done).count()
    out["line_is_whole"] = cfg.bin_count - done.union(left).distinct().count()
    for mode in MODES:
        own = binned.filter(F.col("activity_type") == mode).select("bin").distinct()
        told = bins_of(f"{mode}_segments")
        out[f"{mode}_segments"] = told.exceptAll(own).count() + own.exceptAll(told).count()
    section = coverage["longest_continuous_completed_section"]
    out["longest_is_completed"] = int(bool(section) and section not in coverage["completed_segments"])
    return out


def _order_violations(activities: DataFrame, binned: DataFrame, cfg: LineConfig) -> dict[str, int]:
    """Rules of first touch in the order of time and id: new is what no earlier activity covers, cumulative is the running
    union and never falls, and every activity has its time."""
    placed = binned.join(activities.select("activity_id", "ts"), "activity_id")
    firsts = placed.groupBy("bin").agg(F.min(F.struct("ts", "activity_id")).alias("first")).groupBy(F.col("first.activity_id").alias("activity_id")).agg(F.count("*").alias("n"))
    rows = activities.join(firsts, "activity_id", "left").select("activity_id", "ts", F.coalesce("n", F.lit(0)).alias("n"), "new_co_unique_miles", "cumulative_unique_miles").orderBy("ts", "activity_id").collect()  # one row per activity, as for the files
    out = dict.fromkeys(("new_is_first_touch", "cumulative_is_running_union", "cumulative_never_falls", "chronological"), 0)
    running, before = 0, 0.0
    for r in rows:
        running += r["n"]
        told = r["cumulative_unique_miles"]
        out["new_is_first_touch"] += abs(r["new_co_unique_miles"] - r["n"] * cfg.bin_miles) > MILES
        out["cumulative_is_running_union"] += abs(told - running * cfg.bin_miles) > MILES
        out["cumulative_never_falls"] += told + MILES < before
        out["chronological"] += r["ts"] is None
        before = told
    return out


def gate(violations: dict[str, int]) -> None:
    broken = {k: v for k, v in violations.items() if v}
    if broken:
        raise InvariantError("; ".join(f"{k}: {v}" for k, v in sorted(broken.items())))
