"""Bins of the line, and the intervals between them. Three binning rules stay apart: floats, edges and decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.config import LineConfig

DEC = "decimal(12,6)"


def leg_bins(left: Column, right: Column, cfg: LineConfig = LineConfig()) -> Column:
    """Float rule: the bins that a movement between two mileposts touches, both ends included; null if none."""
    first = F.greatest(F.lit(0), F.floor(F.least(left, right) / cfg.bin_miles)).cast("int")
    top = F.least(F.greatest(left, right), F.lit(cfg.line_miles - 1e-12))
    last = F.least(F.lit(cfg.bin_count - 1), F.floor(top / cfg.bin_miles)).cast("int")
    return F.when(last >= first, F.sequence(first, last))  # sequence(3, 2) would count down


def edge_bin(milepost: Column, cfg: LineConfig = LineConfig()) -> Column:
    """Rounding rule: the bin edge that a published milepost lies on."""
    return F.round(milepost / cfg.bin_miles).cast("int")


def on_edge(milepost: Column, cfg: LineConfig = LineConfig()) -> Column:
    return F.abs(edge_bin(milepost, cfg) * cfg.bin_miles - milepost) <= 1e-8


def decimal_bin(milepost: Column, cfg: LineConfig = LineConfig()) -> Column:
    """Decimal rule: floor in exact arithmetic, the end of the line in the last bin."""
    exact = milepost.cast(DEC) / F.lit(str(cfg.bin_miles)).cast(DEC)
    return F.least(F.floor(exact).cast("int"), F.lit(cfg.bin_count - 1))


def feature_bins(start: Column, end: Column, cfg: LineConfig = LineConfig()) -> Column:
    """Bins of a point feature (end null) or a range, both ends included."""
    first = decimal_bin(start, cfg)
    last = decimal_bin(F.coalesce(end, start), cfg)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def explode_segments(df: DataFrame, start: str, end: str, out: str = "bin") -> DataFrame:
    """One row per bin of [start, end) (bin numbers); empty and reversed intervals give none."""
    return df.filter(F.col(end) > F.col(start)).select("*", F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias(out))


#: Bins of the line that are sorted together.
RANGE = 1 << 16


def islands(bins: DataFrame, keys: tuple[str, ...] = (), column: str = "bin") -> DataFrame:
    """Maximal runs of consecutive bins: keys, start_bin, end_bin (exclusive), bins. Repeated bins count once.

    Bins are sorted within ranges of RANGE bins, whatever the length of the line; runs that touch the edge of a range,
    two of a range at most, are then joined with their neighbours.
    """
    distinct = bins.select(*keys, column).distinct().withColumn("_range", F.floor(F.col(column) / RANGE))
    marked = distinct.withColumn("_island", F.col(column) - F.row_number().over(W.partitionBy(*keys, "_range").orderBy(column)))
    runs = marked.groupBy(*keys, "_range", "_island").agg(F.min(column).alias("start_bin"), (F.max(column) + 1).alias("end_bin"), F.count("*").alias("bins")).drop("_range", "_island")
    at_edge = (F.col("start_bin") % RANGE == 0) | (F.col("end_bin") % RANGE == 0)
    along = W.partitionBy(*(keys or (F.lit(0),))).orderBy("start_bin")  # two rows of a range at most
    edges = runs.filter(at_edge).withColumn("_new", F.coalesce((F.lag("end_bin").over(along) != F.col("start_bin")).cast("int"), F.lit(1)))
    edges = edges.withColumn("_run", F.sum("_new").over(along))
    joined = edges.groupBy(*keys, "_run").agg(F.min("start_bin").alias("start_bin"), F.max("end_bin").alias("end_bin"), F.sum("bins").alias("bins")).drop("_run")
    return runs.filter(~at_edge).unionByName(joined)


def complement(bins: DataFrame, domain: int, column: str = "bin") -> DataFrame:
    """Bins 0..domain-1 that don't occur."""
    spark: SparkSession = bins.sparkSession
    return spark.range(domain).select(F.col("id").cast("int").alias(column)).join(bins.select(column), column, "left_anti")


def as_segments(runs: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """start_bin, end_bin as start_milepost, end_milepost and miles, rounded to the bin."""
    mile = lambda c: F.round(F.col(c) * cfg.bin_miles, 2)
    width = F.round((F.col("end_bin") - F.col("start_bin")) * cfg.bin_miles, 2)
    return runs.withColumns({"start_milepost": mile("start_bin"), "end_milepost": mile("end_bin"), "miles": width}).drop("start_bin", "end_bin", "bins")


def longest(runs: DataFrame) -> DataFrame:
    """The longest island; the first of equals."""
    return runs.orderBy(F.desc("bins"), "start_bin").limit(1)
