"""Who covered what first: unique, new and cumulative bins of activities in (time, id) order, and the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.operators.bins import complement, islands


def first_touch(bins: DataFrame, when: str = "ts", who: str = "activity_id") -> DataFrame:
    """(bin, first): the earliest (ts, activity_id) of each bin. A minimum, so map-side partial sums carry a hot bin."""
    return bins.groupBy("bin").agg(F.min(F.struct(F.col(when).alias("ts"), F.col(who).alias("id"))).alias("first"))


def running_total(df: DataFrame, value: str, out: str, day: Column, order: tuple[str, ...]) -> DataFrame:
    """Running sum over a global order without one task for all rows: within each day, upon the total of the days before."""
    dated = df.withColumn("_day", day)
    days = dated.groupBy("_day").agg(F.sum(value).alias("_sum"))
    before = days.select(F.col("_day").alias("_of"), (F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_day")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_day").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return dated.join(before, F.col("_day") == F.col("_of")).withColumn(out, inside + F.col("_before")).drop("_day", "_of", "_before")


def coverage_history(bins: DataFrame) -> DataFrame:
    """(activity_id, ts, unique_bins, new_bins, cumulative_bins) for rows (activity_id, ts, bin), repeats allowed."""
    unique = bins.groupBy("activity_id", "ts").agg(F.count_distinct("bin").alias("unique_bins"))
    fresh = first_touch(bins).groupBy(F.col("first.id").alias("_id"), F.col("first.ts").alias("_ts")).agg(F.count("*").alias("new_bins"))
    both = unique.join(fresh, (F.col("activity_id") == F.col("_id")) & (F.col("ts") == F.col("_ts")), "left").withColumn("new_bins", F.coalesce("new_bins", F.lit(0)))
    return running_total(both.drop("_id", "_ts"), "new_bins", "cumulative_bins", F.to_date("ts"), ("ts", "activity_id"))


def scope_segments(bins: DataFrame, domain: int, modes: tuple[str, ...], mode: str = "mode") -> DataFrame:
    """(coverage_scope, coverage_status, start_bin, end_bin, bins): all modes together, what remains, and each mode."""
    distinct = bins.select("bin").distinct()
    together = islands(distinct).withColumns({"coverage_scope": F.lit("combined"), "coverage_status": F.lit("completed")})
    left = islands(complement(distinct, domain)).withColumns({"coverage_scope": F.lit("combined"), "coverage_status": F.lit("remaining")})
    own = islands(bins.filter(F.col(mode).isin(*modes)), (mode,)).withColumnRenamed(mode, "coverage_scope").withColumn("coverage_status", F.lit("covered"))
    columns = ("coverage_scope", "coverage_status", "start_bin", "end_bin", "bins")
    return together.select(*columns).unionByName(left.select(*columns)).unionByName(own.select(*columns))


def mode_totals(bins: DataFrame, mode: str = "mode") -> DataFrame:
    """(scope, bins): distinct bins of each mode and of all; one pass over the distinct pairs."""
    pairs = bins.select(mode, "bin").distinct()
    return pairs.groupingSets([[F.col(mode)], []], mode).agg(F.count_distinct("bin").alias("bins")).select(F.coalesce(mode, F.lit("combined")).alias("scope"), "bins")
