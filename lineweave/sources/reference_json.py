"""Reference files: features along the line, trail features, the line itself. Schemas are checked, not inferred."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.config import EAST_ANCHOR, WEST_ANCHOR, LineConfig
from lineweave.functions.geo import vincenty
from lineweave.functions.names import squeeze
from lineweave.operators.graph import LineError


class ReferenceError_(RuntimeError):
    """A reference file breaks its contract."""


POINT_KEYS = {"name", "milepost", "milepost_end", "latitude", "longitude"}
LOCK_KEYS = {"lock_number", "name", "common_name", "milepost", "alternate_milepost", "notes"}
ACCESS_SCHEMA = "struct<access_points:array<struct<name:string,milepost:double,milepost_end:double,latitude:double,longitude:double>>>"
LOCK_SCHEMA = "struct<locks:array<struct<lock_number:string,name:string,common_name:string,milepost:double,alternate_milepost:double,notes:string>>>"


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file, by Spark's own reader, so from any store."""
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise ReferenceError_(f"{path} is empty")
    return row[0]


def load_object(spark: SparkSession, path: str) -> dict[str, Any]:
    found = json.loads(read_text(spark, path))
    if not isinstance(found, dict):
        raise ReferenceError_(f"{path} isn't an object")
    return found


def number(value: Any, label: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ReferenceError_(f"{label} isn't a number")
    return float(value)


def _checked(rows: Any, keys: set[str], label: str, line: float) -> list[dict[str, Any]]:
    if not isinstance(rows, list) or not rows:
        raise ReferenceError_(f"{label}: a list is needed")
    for row in rows:
        if not isinstance(row, dict) or set(row) != keys:
            raise ReferenceError_(f"{label}: a row has other fields than {sorted(keys)}")
        if not isinstance(row["name"], str) or not row["name"].strip():
            raise ReferenceError_(f"{label}: a name is missing")
        if not 0 <= number(row["milepost"], label) <= line:
            raise ReferenceError_(f"{label}: a milepost is off the line")
    if [r["milepost"] for r in rows] != sorted(r["milepost"] for r in rows):
        raise ReferenceError_(f"{label}: rows aren't in the order of mileposts")
    if len({json.dumps(r, sort_keys=True) for r in rows}) < len(rows):
        raise ReferenceError_(f"{label}: a row is there twice")
    return rows


def load_access_points(spark: SparkSession, path: str, cfg: LineConfig = LineConfig()) -> DataFrame:
    """(point_id by place, name, milepost, milepost_end, latitude, longitude)."""
    rows = _checked([{"milepost_end": None} | r for r in load_object(spark, path).get("access_points") or []], POINT_KEYS, "access points", cfg.line_miles)
    for r in rows:
        if abs(number(r["latitude"], "latitude")) > 90 or abs(number(r["longitude"], "longitude")) > 180:
            raise ReferenceError_("access points: coordinates out of range")
        if r["milepost_end"] is not None and not r["milepost"] <= number(r["milepost_end"], "milepost_end") <= cfg.line_miles:
            raise ReferenceError_("access points: a range ends before it begins")
    data = [(i, r["name"], float(r["milepost"]), None if r["milepost_end"] is None else float(r["milepost_end"]), float(r["latitude"]), float(r["longitude"])) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "point_id int, name string, milepost double, milepost_end double, latitude double, longitude double")


def load_locks(spark: SparkSession, path: str, count: int | None = None, cfg: LineConfig = LineConfig()) -> DataFrame:
    rows = _checked(load_object(spark, path).get("locks"), LOCK_KEYS, "locks", cfg.line_miles)
    if count is not None and len(rows) != count or len({r["lock_number"] for r in rows}) < len(rows):
        raise ReferenceError_("locks: the count is wrong or a number is there twice")
    real = lambda v: None if v is None else number(v, "locks")
    return spark.createDataFrame([(r["lock_number"], r["name"], r["common_name"], float(r["milepost"]), real(r["alternate_milepost"]), r["notes"]) for r in rows], "lock_number string, name string, common_name string, milepost double, alternate_milepost double, notes string")


def load_guide(spark: SparkSession, path: str, amenities: tuple[str, ...], cfg: LineConfig = LineConfig()) -> DataFrame:
    """(location_id, name, milepost, one boolean per amenity). Camping must say what its two kinds say."""
    rows = _checked(load_object(spark, path).get("locations"), {"name", "milepost", "amenities"}, "guide", cfg.line_miles)
    for r in rows:
        own = r["amenities"]
        if not isinstance(own, dict) or set(own) != set(amenities) or not all(isinstance(v, bool) for v in own.values()):
            raise ReferenceError_("guide: amenities must be these booleans: " + ", ".join(amenities))
    data = [(i, r["name"], float(r["milepost"]), *(r["amenities"][a] for a in amenities)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "location_id int, name string, milepost double" + "".join(f", {a} boolean" for a in amenities))


#: The unit, the fields that its features have, names of wanted features, their attributes and uses.
UNIT = "CHOH"
TRAIL_FIELDS = ("OBJECTID", "UNITCODE", "TRLNAME", "TRLALTNAME", "MAPLABEL", "TRLSTATUS", "TRLSURFACE", "TRLUSE", "TRLTYPE", "TRLCLASS", "TRLFEATTYPE", "PUBLICDISPLAY", "DATAACCESS", "ISEXTANT", "OPENTOPUBLIC", "GEOMETRYID")
TRAIL_CANDIDATES = "towpath"
TRAIL_NAMES = r"Towpath\s*,?\s*Mile(?:s?post)?\s+\d+\s*-\s*\d+(?:\s+\(\d+(?:\.\d+)?\))?|(?-i:Towpath, Milepost 184\.184\.5 \(184\.00\)|Widewater Waste Weir Bridge 3100-059S)"
TRAIL_EXPECTED: dict[str, str] = {"TRLALTNAME": "Potomac Heritage National Scenic Trail", "TRLSTATUS": "Existing", "TRLTYPE": "Standard Terra Trail", "TRLFEATTYPE": "Park Trail", "PUBLICDISPLAY": "Public Map Display", "DATAACCESS": "Unrestricted", "ISEXTANT": "True"}
TRAIL_USES = ("Hiker / Pedestrian", "Bicycle")


def fetch_geojson(opener: Callable[..., Any], url: str, timeout: float = 60.0) -> dict[str, Any]:
    """A feature service's answer; the query in the URL already filters, selects fields and sorts. Refuses errors,
    other types and answers that were cut short."""
    with opener(url, timeout=timeout) as answer:
        found = json.loads(answer.read())
    if not isinstance(found, dict) or "error" in found or found.get("type") != "FeatureCollection":
        raise ReferenceError_("the service sent no feature collection")
    if found.get("exceededTransferLimit") or (found.get("properties") or {}).get("exceededTransferLimit"):
        raise ReferenceError_("the service cut its answer short")
    return found


def trail_features(spark: SparkSession, features: list[dict[str, Any]]) -> DataFrame:
    """(feature_order, properties: map, lines: array of lines of [lon, lat]) of GeoJSON lines and multi-lines."""
    rows = []
    for k, f in enumerate(features):
        shape = f.get("geometry") or {}
        lines = [shape["coordinates"]] if shape.get("type") == "LineString" else shape.get("coordinates") if shape.get("type") == "MultiLineString" else None
        if not lines or any(len(line) < 2 for line in lines):
            raise ReferenceError_(f"feature {k} isn't a line")
        clean = [[[float(c) for c in p[:2]] for p in line] for line in lines]
        if any(not (math.isfinite(x) and math.isfinite(y) and abs(x) <= 180 and abs(y) <= 90) for line in clean for x, y in line):
            raise ReferenceError_(f"feature {k} has coordinates out of range")
        rows.append((k, {n: None if v is None else str(v) for n, v in (f.get("properties") or {}).items()}, clean))
    return spark.createDataFrame(rows, "feature_order int, properties map<string,string>, lines array<array<array<double>>>")


def in_unit(unit: str) -> Column:
    return F.upper(squeeze(F.element_at("properties", "UNITCODE"))) == unit


def unit_trails(spark: SparkSession, features: list[dict[str, Any]], unit: str = UNIT, required: tuple[str, ...] = TRAIL_FIELDS) -> DataFrame:
    """``trail_features`` of the unit alone, which must be there and have the required fields between them."""
    own = trail_features(spark, features).filter(in_unit(unit))
    if own.isEmpty():
        raise ReferenceError_(f"no feature of {unit}")
    if lost := missing_fields(own, required):
        raise ReferenceError_(f"no feature has {lost}")
    return own


def missing_fields(features: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Fields that no feature has."""
    found = features.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect()
    return sorted(set(required) - {r["k"] for r in found})


def select_trail(features: DataFrame, names: str, candidates: str, expected: dict[str, str], uses: tuple[str, ...] = ()) -> DataFrame:
    """Features whose name matches ``names`` as a whole and whose attributes are as expected, whatever their case, in the
    order of their ids.

    Every feature whose name begins with, or whose label is, ``candidates`` must be one of them: others are ambiguous
    and stop the selection, as does an empty one.
    """
    p = lambda k: squeeze(F.coalesce(F.element_at("properties", k), F.lit("")))
    candidate = F.startswith(F.lower(p("TRLNAME")), F.lit(candidates)) | (F.lower(p("MAPLABEL")) == candidates)
    fits = p("TRLNAME").rlike(f"(?i)^(?:{names})$")
    for k, v in expected.items():
        fits = fits & (F.lower(p(k)) == v.lower())
    allowed = F.transform(F.split(F.lower(p("TRLUSE")), r"\|"), lambda u: F.trim(u))
    for use in uses:
        fits = fits & F.array_contains(allowed, use.lower())
    judged = features.withColumns({"_c": candidate, "_f": fits})
    counts = judged.agg(F.count_if(F.col("_c") & ~F.col("_f")).alias("odd"), F.count_if(F.col("_c") & F.col("_f")).alias("good")).first()
    if counts["odd"] or not counts["good"]:
        raise ReferenceError_(f"{counts['odd']} ambiguous and {counts['good']} good trail features")
    return judged.filter("_c and _f").drop("_c", "_f").orderBy(F.element_at("properties", "OBJECTID").try_cast("long"), F.element_at("properties", "GEOMETRYID"))


def load_line(spark: SparkSession, path: str, anchors: tuple = (EAST_ANCHOR, WEST_ANCHOR), cfg: LineConfig = LineConfig()) -> list[tuple[float, float]]:
    """The vertices of a file with one feature, one simple line, whose ends are near the anchors."""
    found = load_object(spark, path)
    features = found.get("features")
    if found.get("type") != "FeatureCollection" or not isinstance(features, list) or len(features) != 1 or features[0]["geometry"]["type"] != "LineString":
        raise ReferenceError_("one feature with one line is needed")
    line = [(float(x), float(y)) for x, y, *_ in features[0]["geometry"]["coordinates"]]
    validate_line(line)
    for end, anchor in ((line[0], anchors[0]), (line[-1], anchors[1])):
        if vincenty(*end, *anchor) > cfg.endpoint_tolerance:
            raise LineError("the line ends too far from its anchor")
    return line


def validate_line(line: list[tuple[float, float]]) -> None:
    """At least two vertices, in range, and no two segments that cross (sorted sweep over the segments' spans)."""
    if len(line) < 2 or any(abs(x) > 180 or abs(y) > 90 for x, y in line):
        raise LineError("the line has no length or leaves the range of coordinates")
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    spans = sorted((min(a[0], b[0]), max(a[0], b[0]), k) for k, (a, b) in enumerate(zip(line, line[1:], strict=False)))
    active: list[tuple[float, int]] = []
    for low, high, k in spans:
        active = [(h, j) for h, j in active if h >= low]
        a, b = line[k], line[k + 1]
        for _, j in active:
            c, d = line[j], line[j + 1]
            if abs(j - k) > 1 and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                raise LineError("the line crosses itself")
        active.append((high, k))

