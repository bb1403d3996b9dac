"""The activity catalog: a wide CSV whose header repeats names, read as text, judged row by row."""

from __future__ import annotations

import csv
import io
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineweave.config import TYPE_MAPPING


class CatalogError(RuntimeError):
    """The export as a whole can't be used."""


#: The columns that an export must have.
REQUIRED = ("Activity ID", "Activity Date", "Activity Name", "Activity Type", "Filename", "Elapsed Time", "Moving Time", "Distance", "Elevation Gain", "Elevation Loss", "Average Speed", "Max Speed", "Average Heart Rate", "Max Heart Rate", "Calories")
SUFFIXES = (".gpx.gz", ".tcx.gz", ".fit.gz")


@dataclass(frozen=True)
class Catalog:
    """Frames: activities, issues (activity_id, code, message, filename), type_counts; and two row counts."""

    activities: DataFrame
    issues: DataFrame
    type_counts: DataFrame
    total_rows: int
    candidate_rows: int


def discover_export(root: str | Path, explicit: str | Path | None = None) -> Path:
    """The one folder below root that holds activities.csv; a folder named explicitly is taken as it is."""
    if explicit is not None:
        return Path(explicit)
    found = sorted({p.parent for p in Path(root).rglob("activities.csv")})
    if len(found) != 1:
        raise CatalogError(f"{len(found)} folders below {root} hold an activities.csv; one is needed")
    return found[0]


def unique_names(header: list[str]) -> list[str]:
    """Second and later uses of a name get .1, .2 and so on."""
    seen: Counter = Counter()
    out = []
    for name in header:
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def _number(name: str) -> Column:
    value = F.col(f"`{name}`").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def read_raw(spark: SparkSession, folder: str | Path) -> DataFrame:
    """Every cell as text, columns renamed by place; the header's byte-order mark and quoted line breaks are understood."""
    path = f"{folder}/activities.csv"
    first = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 1 << 20)).first()
    if first is None or not first[0]:
        raise CatalogError("activities.csv is empty")
    names = unique_names(next(csv.reader(io.StringIO(first[0].lstrip("﻿")))))
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise CatalogError("missing columns: " + ", ".join(missing))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, escape='"')
    return raw.toDF(*names)


def check_repeated(frame: DataFrame) -> None:
    """Repeated columns must agree: equal within 1e-6, or kilometres against metres within 10 m and 1 %."""
    rules = []
    for name in ("Elapsed Time", "Max Heart Rate"):
        if f"{name}.1" in frame.columns:
            rules.append((name, F.abs(_number(name) - _number(f"{name}.1")) <= 1e-6))
    if "Distance.1" in frame.columns:
        km, m = _number("Distance"), _number("Distance.1")
        rules.append(("Distance", ((km == 0) & (m == 0)) | (F.abs(m - km * 1000) <= 10 + F.abs(m) * 0.01)))
    if rules:
        bad = frame.agg(*(F.count_if(~rule).alias(name) for name, rule in rules)).first().asDict()
        if broken := [k for k, v in bad.items() if v]:
            raise CatalogError("repeated columns disagree: " + ", ".join(broken))


def load_catalog(spark: SparkSession, folder: str | Path) -> Catalog:
    """Candidates are the rows of the types wanted. Each gives an activity or one issue, by the first rule it breaks (id,
    repeated id, date); a file that is missing, unsafe or not named is an issue too, but the activity stays."""
    frame = read_raw(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).select(F.col("path"))
    root = Path(folder).resolve().as_posix()
    return judge_catalog(frame, files.select(F.regexp_replace("path", r"^file:/*", "/").alias("path")), root)


def judge_catalog(frame: DataFrame, files: DataFrame, root: str) -> Catalog:
    """The catalog of raw rows (every cell as text) and the paths of the files that exist, of which those below root count."""
    check_repeated(frame)
    detail = lambda name: f"{name}.1" if f"{name}.1" in frame.columns else name
    types = frame.groupBy(F.coalesce(_text("Activity Type"), F.lit("(missing)")).alias("activity_type")).agg(F.count("*").alias("n"))
    rows = frame.filter(F.col("Activity Type").isin(*TYPE_MAPPING))
    given = _text("Activity Date")
    when = F.coalesce(F.try_to_timestamp(given, F.lit("MMM d, yyyy, h:mm:ss a")), F.try_to_timestamp(given))
    distance = _number(detail("Distance"))
    meters = distance if detail("Distance").endswith(".1") else distance * 1000
    mapping = F.create_map(*(F.lit(x) for pair in TYPE_MAPPING.items() for x in pair))
    name = _text("Filename")
    existing = files.select(F.col("path").alias("_there")).filter(F.startswith("_there", F.lit(root)))
    unsafe = F.startswith(name, F.lit("/")) | F.concat(F.lit("/"), name, F.lit("/")).contains("/../")
    listed = rows.select(
        F.col("Activity ID").try_cast("long").alias("activity_id"),
        F.col("Activity ID").alias("_id"),
        when.alias("ts"),
        F.col("Activity Name").alias("activity_name"),
        F.col("Activity Type").alias("original_type"),
        F.element_at(mapping, F.col("Activity Type")).alias("mode"),
        (_text("Activity Description") if "Activity Description" in frame.columns else F.lit(None).cast("string")).alias("description"),
        _number(detail("Elapsed Time")).alias("elapsed_seconds"),
        _number("Moving Time").alias("moving_seconds"),
        meters.alias("distance_meters"),
        _number("Elevation Gain").alias("elevation_gain_meters"),
        _number("Elevation Loss").alias("elevation_loss_meters"),
        _number("Average Speed").alias("average_speed"),
        _number("Max Speed").alias("max_speed"),
        _number("Average Heart Rate").alias("average_heart_rate"),
        _number(detail("Max Heart Rate")).alias("max_heart_rate"),
        _number("Calories").alias("calories"),
        name.alias("filename"),
        unsafe.alias("_unsafe"),
    )
    copies = listed.filter(F.col("activity_id").isNotNull()).groupBy("activity_id").count().filter("count > 1").select("activity_id", F.lit(True).alias("_copies"))
    joined = listed.join(copies, "activity_id", "left").withColumn("_path", F.concat(F.lit(root + "/"), F.col("filename"))).join(existing, F.col("_path") == F.col("_there"), "left")
    problem = lambda code, message: F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    broken = F.when(F.col("activity_id").isNull(), problem("invalid_activity_id", F.col("_id"))).when(F.col("_copies"), problem("duplicate_activity_id", "all rows with this id were skipped")).when(F.col("ts").isNull(), problem("invalid_activity_date", "the date can't be read"))
    file = F.when(F.col("filename").isNull(), problem("missing_filename", "no file is named")).when(F.col("_unsafe"), problem("unsafe_filename", "the file is outside the export")).when(F.col("_there").isNull(), problem("missing_gps_file", "the file doesn't exist"))
    judged = joined.withColumn("_skip", broken).withColumn("_issue", F.coalesce(broken, file))
    issues = judged.filter(F.col("_issue").isNotNull()).select("activity_id", "_issue.code", "_issue.message", "filename")
    kept = judged.filter(F.col("_skip").isNull()).withColumn("track", F.when(F.col("_there").isNotNull() & ~F.col("_unsafe"), F.col("_path")))
    activities = kept.withColumn("filename", F.when(~F.col("_unsafe"), F.col("filename"))).drop("_id", "_unsafe", "_copies", "_path", "_there", "_skip", "_issue")
    return Catalog(activities, issues, types, frame.count(), rows.count())
