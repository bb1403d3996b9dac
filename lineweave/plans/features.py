"""What is published about features along the line: access points and locks with all that belongs to them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.config import MODES, LineConfig
from lineweave.functions.names import feature_type, lock_number, normalized_name
from lineweave.operators import features as feat

#: The booleans that the guide has of a location.
GUIDE_AMENITIES = ("parking", "restrooms", "water", "picnic_tables", "camping", "camping_fee_area", "camping_tent", "boat_ramp", "canoe_kayak_ramp", "visitor_center", "food", "bike_rentals", "boat_rentals", "canal_quarters", "fee_area")


@dataclass(frozen=True)
class Reference:
    """The reference files: access points, locks and the guide, and the sources that they name."""

    access_points: DataFrame
    locks: DataFrame
    guide: DataFrame | None = None
    sources: dict[str, Any] | None = None
    amenities: tuple[str, ...] = GUIDE_AMENITIES


def _coverage(frame: DataFrame, key: str, records: DataFrame, bins: DataFrame, remaining: DataFrame, cfg: LineConfig) -> DataFrame:
    """(key, coverage_status, coverage_by_mode, covering_activity_count, covering_activity_count_by_mode, first_ and
    latest_covering_activity, remaining_segments) of features (key, milepost, milepost_end)."""
    own = feat.exploded_feature_bins(frame, key, cfg)
    whole = feat.status(own, bins.select("bin").distinct(), key)
    out = whole
    for m in MODES:
        out = out.join(feat.status(own, bins.filter(F.col("mode") == m).select("bin").distinct(), key).withColumnRenamed("coverage_status", f"_status_{m}"), key)
    out = out.join(feat.covering_activities(own, bins, key), key)
    event = records.select(F.col("activity_id").alias("_id"), F.struct("activity_id", "date", "strava_url").alias("_event"))
    for side, column in (("first", "first_id"), ("latest", "last_id")):
        out = out.join(event.select(F.col("_id").alias(f"_{side}"), F.col("_event").alias(f"{side}_covering_activity")), F.col(column) == F.col(f"_{side}"), "left")
    left = feat.remaining_for(frame, whole, remaining, key, cfg).join(remaining, ["start_milepost", "end_milepost"])
    listed = left.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_milepost", "end_milepost", "miles"))).alias("remaining_segments"))
    out = out.join(listed, key, "left")
    none = F.array().cast("array<struct<start_milepost:double,end_milepost:double,miles:double>>")
    return out.select(
        key,
        "coverage_status",
        F.struct(*(F.col(f"_status_{m}").alias(m) for m in MODES)).alias("coverage_by_mode"),
        F.col("covering_count").alias("covering_activity_count"),
        F.struct(*(F.col(f"covering_{m}").alias(m) for m in MODES)).alias("covering_activity_count_by_mode"),
        "first_covering_activity",
        "latest_covering_activity",
        F.coalesce("remaining_segments", none).alias("remaining_segments"),
    )


NEARBY = "array<struct<milepost_distance:double,milepost:double,type:string,name:string,id:string,lock_number:string,common_name:string,source:string>>"
MATCHES = "array<struct<place:int,name:string,milepost:double,milepost_distance:double>>"


def published_access_points(reference: Reference, records: DataFrame, bins: DataFrame, remaining: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """One row per access point with all that is published of it, nested, by its place in the file (point_id).

    bins: (activity_id, ts, mode, bin) of what each activity covered; remaining: the line's open segments
    (start_milepost, end_milepost, miles). Without a guide no point has matches or amenities.
    """
    tie = F.to_json(F.struct("latitude", "longitude", "milepost", "milepost_end", "name"), {"ignoreNullFields": "false"})
    places = feat.public_ids(reference.access_points, tie)
    spans = places.select("point_id", "milepost", "milepost_end")
    two = lambda c: F.bround(c, 2).cast("double")
    numbered = reference.locks.withColumn("id", feat.lock_id(F.col("lock_number")))
    near = feat.band_join(spans, numbered.select("id", "lock_number", F.col("name").alias("at_name"), "common_name", F.col("milepost").alias("at")), "milepost", "milepost_end", "at", cfg.nearby_band_miles)
    nearby = near.select("point_id", two("distance").alias("milepost_distance"), F.col("at").alias("milepost"), F.lit("lock").alias("type"), F.col("at_name").alias("name"), "id", "lock_number", "common_name", F.lit("locks").alias("source"))
    out = places
    if reference.guide is None:
        out = out.withColumns({"nps_amenities": F.lit(None).cast("struct<" + ",".join(f"{a}:boolean" for a in reference.amenities) + ">"), "nps_recreation_matches": F.array().cast(MATCHES)})
    else:
        locations = reference.guide.withColumn("lock_number", lock_number(F.col("name")))
        named = places.select("point_id", normalized_name(F.col("name")).alias("name"), "milepost", "milepost_end")
        matches = feat.recreation_matches(named, locations.select("location_id", normalized_name(F.col("name")).alias("loc_name"), F.col("milepost").alias("loc_milepost"), *reference.amenities), cfg)
        said = locations.select("location_id", F.col("name").alias("said"))
        listed = matches.join(said, "location_id").groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct(F.col("location_id").alias("place"), F.col("said").alias("name"), F.col("loc_milepost").alias("milepost"), two("distance").alias("milepost_distance")))).alias("nps_recreation_matches"))
        rolled = feat.any_amenity(places, matches, reference.amenities)
        whole = F.when(F.col(reference.amenities[0]).isNotNull(), F.struct(*reference.amenities))
        out = out.join(rolled.select("point_id", whole.alias("nps_amenities")), "point_id").join(listed, "point_id", "left")
        out = out.withColumn("nps_recreation_matches", F.coalesce("nps_recreation_matches", F.array().cast(MATCHES)))
        free = feat.unmatched(locations, matches, numbered)
        kind = feature_type(F.col("name"), {a: F.col(a) for a in reference.amenities})
        beside = feat.band_join(spans, free.select(F.col("name").alias("at_name"), kind.alias("type"), F.col("milepost").alias("at")), "milepost", "milepost_end", "at", cfg.nearby_band_miles)
        nothing = F.lit(None).cast("string")
        nearby = nearby.unionByName(beside.select("point_id", two("distance").alias("milepost_distance"), F.col("at").alias("milepost"), "type", F.col("at_name").alias("name"), nothing.alias("id"), nothing.alias("lock_number"), nothing.alias("common_name"), F.lit("recreation_guide").alias("source")))
    around = nearby.groupBy("point_id").agg(F.sort_array(F.collect_list(F.struct("milepost_distance", "milepost", "type", "name", "id", "lock_number", "common_name", "source"))).alias("nearby_features"))
    out = out.join(around, "point_id", "left").withColumn("nearby_features", F.coalesce("nearby_features", F.array().cast(NEARBY)))
    return out.join(_coverage(spans, "point_id", records, bins, remaining, cfg), "point_id")


def published_locks(reference: Reference, records: DataFrame, bins: DataFrame, remaining: DataFrame, cfg: LineConfig = LineConfig()) -> DataFrame:
    """One row per lock with all that is published of it, nested."""
    own = reference.locks.select("lock_number", "name", "common_name", "milepost", F.lit(None).cast("double").alias("milepost_end"))
    covered = _coverage(own, "lock_number", records, bins, remaining, cfg)
    return own.drop("milepost_end").withColumn("id", feat.lock_id(F.col("lock_number"))).join(covered, "lock_number")


def as_objects(access_points: DataFrame, locks: DataFrame) -> tuple[list[dict], list[dict]]:
    """The rows of both as the objects of the JSON files, as many as the reference files have; what comes from the guide
    has neither id nor lock number."""
    places = [r.asDict(recursive=True) for r in access_points.orderBy("point_id").collect()]
    for p in places:
        del p["point_id"]
        p["nearby_features"] = [n if n["source"] == "locks" else {k: v for k, v in n.items() if k not in ("id", "lock_number", "common_name")} for n in p["nearby_features"]]
        p["nps_recreation_matches"] = [{k: v for k, v in m.items() if k != "place"} for m in p["nps_recreation_matches"]]
    return places, [r.asDict(recursive=True) for r in locks.orderBy("milepost", "id").collect()]


#: The ids of the sources, with organisation, address where no file names one, and what they give.
SOURCES = {
    "co_canal_association_access_points": ("C&O Canal Association", None, "Names, mileposts, ranges and coordinates of the access points."),
    "co_canal_trust_locks": ("C&O Canal Trust", None, "Mileposts and common names of the locks."),
    "nps_lift_locks": ("National Park Service", "https://www.nps.gov/choh/learn/historyculture/lift-locks.htm", "Number and numbering of the locks."),
    "nps_recreation_guide": ("National Park Service", None, "Locations along the line and their amenities."),
    "nps_towpath_reference": ("National Park Service", "https://mapservices.nps.gov/arcgis/rest/services/NationalDatasets/NPS_Public_Trails_Geographic/FeatureServer/0", "Trail features that the line is made of."),
    "strava_activity_data": ("Strava", "https://www.strava.com/", "The user's activities."),
}
_MADE = {"nps_towpath_reference": "geometry of the line", "strava_activity_data": "activities"}
_LOCKS = {"co_canal_trust_locks": "mileposts and common names of locks", "nps_lift_locks": "number and numbering of locks"}
_PLACES = {"co_canal_association_access_points": "access points"}
_GUIDE = {"nps_recreation_guide": "locations and amenities"}
#: What each published file comes from, and the part that a source has in it.
ARTIFACTS = {
    "access-point-nps-matches.csv": _PLACES | _GUIDE,
    "access-points.json": _PLACES | _LOCKS | _GUIDE | _MADE,
    "activities.csv": _MADE,
    "activities.json": _MADE,
    "artifact-sources.csv": dict.fromkeys(SOURCES, "named here"),
    "coverage-segments.csv": _MADE,
    "coverage.json": _MADE,
    "feature-nearby-features.csv": _PLACES | _LOCKS | _GUIDE,
    "features.csv": _PLACES | _LOCKS | _GUIDE | _MADE,
    "features.json": _PLACES | _LOCKS | _GUIDE | _MADE,
    "locks.json": _LOCKS | _MADE,
    "sources.csv": dict.fromkeys(SOURCES, "named here"),
    "sources.json": dict.fromkeys(SOURCES, "named here"),
}


def registry(named: dict[str, dict[str, str]]) -> dict[str, Any]:
    """The source registry: six sources, and what each of the 13 files comes from. named: (name, url) by source id, as far
    as the reference files say them."""
    sources = [{"id": i, "name": (named.get(i) or {}).get("name") or organization, "organization": organization, "url": (named.get(i) or {}).get("url") or url, "description": told, "license": None} for i, (organization, url, told) in sorted(SOURCES.items())]
    artifacts = {a: {"sources": [{"source_id": s, "role": role} for s, role in sorted(of.items())]} for a, of in sorted(ARTIFACTS.items())}
    return {"schema_version": 1, "sources": sources, "artifacts": artifacts}


def named_sources(access_points: dict[str, Any], locks: dict[str, Any], guide: dict[str, Any] | None) -> dict[str, dict[str, str]]:
    """Name and address of sources by id, from the reference files' own objects."""
    out = {"co_canal_association_access_points": access_points.get("source") or {}, "nps_recreation_guide": (guide or {}).get("source") or {}}
    for s in locks.get("sources") or []:
        out["nps_lift_locks" if s.get("name") == "National Park Service" else "co_canal_trust_locks"] = s
    return out
