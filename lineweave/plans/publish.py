"""Sinks: deterministic JSON and CSV files, written only when they change, checked before anything is written."""

from __future__ import annotations

import csv
import io
import json
import re
from pathlib import Path
from typing import Any

from lineweave.config import MODES
from lineweave.plans.records import CSV_FIELDS, PUBLIC_FIELDS


class ExportError(RuntimeError):
    """What is to be published breaks the export's contract."""


SAFE_ID = re.compile("[a-z0-9]+(?:-[a-z0-9]+)*")


def write_if_changed(path: Path, content: str | bytes) -> bool:
    data = content.encode() if isinstance(content, str) else content
    if path.is_file() and path.read_bytes() == data:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return True


def json_text(value: Any) -> str:
    """Sorted keys, two spaces, UTF-8, a line break at the end."""
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"


def minimal_csv(rows: list[dict[str, Any]], columns: tuple[str, ...]) -> str:
    """Quotes only where needed; a missing field is an error, null an empty cell."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for row in rows:
        if lost := [c for c in columns if c not in row]:
            raise ExportError(f"a row lacks {lost}")
        writer.writerow(["" if row[c] is None else row[c] for c in columns])
    return out.getvalue()


def quoted_csv(rows: list[dict[str, Any]], columns: tuple[str, ...]) -> str:
    """Text quoted, numbers and booleans bare, null empty."""

    def cell(v: Any) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int | float) else '"' + str(v).replace('"', '""') + '"'

    lines = [",".join(f'"{c}"' for c in columns), *(",".join(cell(r.get(c)) for c in columns) for r in rows)]
    return "\n".join(lines) + "\n"


def check_ids(rows: list[dict[str, Any]], label: str, text: bool = True) -> set:
    ids = [r.get("id" if text else "activity_id") for r in rows]
    if len(set(ids)) < len(ids) or text and not all(isinstance(i, str) and SAFE_ID.fullmatch(i) for i in ids) or not text and not all(isinstance(i, int) and not isinstance(i, bool) for i in ids):
        raise ExportError(f"{label}: ids must be unique and safe")
    return set(ids)


def combined_features(access_points: list[dict], locks: list[dict]) -> list[dict]:
    """Both kinds in one list, told apart by feature_type, in the order of mileposts."""
    rows = [{"feature_type": "access_point", **r} for r in access_points] + [{"feature_type": "lock", **r} for r in locks]
    return sorted(rows, key=lambda r: (r["milepost"], r["feature_type"], r["name"], r["id"]))


def segment_rows(coverage: dict[str, Any]) -> list[dict[str, Any]]:
    """Five lists of segments as one flat list, combined first, completed before remaining."""
    lists = [("combined", "completed", "completed_segments"), ("combined", "remaining", "remaining_segments"), *((m, "covered", f"{m}_segments") for m in MODES)]
    return [{"coverage_scope": scope, "coverage_status": status, **s} for scope, status, name in lists for s in sorted(coverage[name], key=lambda s: (s["start_milepost"], s["end_milepost"]))]


SEGMENT_COLUMNS = ("coverage_scope", "coverage_status", "start_milepost", "end_milepost", "miles")
NEARBY_COLUMNS = ("access_point_id", "access_point_name", "access_point_milepost", "nearby_feature_id", "nearby_feature_type", "nearby_feature_name", "nearby_feature_common_name", "nearby_feature_lock_number", "nearby_feature_milepost", "milepost_distance", "source")
MATCH_COLUMNS = ("access_point_id", "access_point_name", "access_point_milepost", "access_point_milepost_end", "nps_location_name", "nps_milepost", "milepost_distance")


def nearby_rows(access_points: list[dict]) -> list[dict[str, Any]]:
    rows = [
        {"access_point_id": a["id"], "access_point_name": a["name"], "access_point_milepost": a["milepost"], "nearby_feature_id": n.get("id"), "nearby_feature_type": n["type"], "nearby_feature_name": n["name"], "nearby_feature_common_name": n.get("common_name"), "nearby_feature_lock_number": n.get("lock_number"), "nearby_feature_milepost": n["milepost"], "milepost_distance": n["milepost_distance"], "source": n["source"]}
        for a in access_points
        for n in a["nearby_features"]
    ]
    return sorted(rows, key=lambda r: (r["access_point_milepost"], r["access_point_id"], r["milepost_distance"], r["nearby_feature_milepost"], r["nearby_feature_type"], r["nearby_feature_name"]))


def match_rows(access_points: list[dict]) -> list[dict[str, Any]]:
    rows = [{"access_point_id": a["id"], "access_point_name": a["name"], "access_point_milepost": a["milepost"], "access_point_milepost_end": a.get("milepost_end"), "nps_location_name": m["name"], "nps_milepost": m["milepost"], "milepost_distance": m["milepost_distance"]} for a in access_points for m in a["nps_recreation_matches"]]
    return sorted(rows, key=lambda r: (r["access_point_milepost"], r["access_point_id"], r["milepost_distance"], r["nps_milepost"], r["nps_location_name"]))


#: The columns of the flat file of features; the amenities stand between the two parts.
FEATURE_COLUMNS = ("id", "feature_type", "name", "common_name", "lock_number", "milepost", "milepost_end", "latitude", "longitude", "coverage_status", "run_coverage_status", "bike_coverage_status", "hike_coverage_status", "covering_activity_count", "run_covering_activity_count", "bike_covering_activity_count", "hike_covering_activity_count", "first_covering_activity_id", "first_covering_date", "first_covering_strava_url", "latest_covering_activity_id", "latest_covering_date", "latest_covering_strava_url", "remaining_segment_count", "remaining_segment_start", "remaining_segment_end", "remaining_segment_miles", "nps_has_amenity_data")
FEATURE_COUNTS = ("nps_recreation_match_count", "nearby_feature_count", "nearby_lock_count")
STATUSES = ("covered", "partial", "remaining")


def feature_columns(amenities: tuple[str, ...]) -> tuple[str, ...]:
    return (*FEATURE_COLUMNS, *(f"nps_{a}" for a in sorted(amenities)), *FEATURE_COUNTS)


def flat_feature(kind: str, row: dict[str, Any], amenities: tuple[str, ...]) -> dict[str, Any]:
    """A feature's nested parts as columns; one remaining segment is told by its ends, more only by their count. What only
    access points have is null for a lock."""
    place = kind == "access_point"
    out = {k: row.get(k) for k in ("id", "name", "common_name", "lock_number", "milepost", "milepost_end", "latitude", "longitude", "coverage_status", "covering_activity_count")} | {"feature_type": kind}
    if any(out[k] is None for k in ("id", "name", "milepost", "coverage_status")):
        raise ExportError(f"a {kind} lacks a value that it must have")
    for m in MODES:
        out[f"{m}_coverage_status"] = row["coverage_by_mode"][m]
        out[f"{m}_covering_activity_count"] = row["covering_activity_count_by_mode"][m]
    if not {out["coverage_status"], *row["coverage_by_mode"].values()} <= set(STATUSES):
        raise ExportError(f"{row['id']}: no such coverage status")
    for side in ("first", "latest"):
        event = row.get(f"{side}_covering_activity") or {}
        out |= {f"{side}_covering_activity_id": event.get("activity_id"), f"{side}_covering_date": event.get("date"), f"{side}_covering_strava_url": event.get("strava_url")}
    left = row["remaining_segments"]
    only = left[0] if len(left) == 1 else {}
    out |= {"remaining_segment_count": len(left), "remaining_segment_start": only.get("start_milepost"), "remaining_segment_end": only.get("end_milepost"), "remaining_segment_miles": only.get("miles")}
    known = row.get("nps_amenities") if place else None
    out |= {"nps_has_amenity_data": known is not None if place else None} | {f"nps_{a}": None if known is None else known[a] for a in amenities}
    near = row["nearby_features"] if place else None
    counts = (len(row["nps_recreation_matches"]), len(near), sum(n["type"] == "lock" and n["source"] == "locks" for n in near)) if place else (None, None, None)
    return out | dict(zip(FEATURE_COUNTS, counts, strict=True))


def check_document(features: list[dict], access_points: list[dict], locks: list[dict]) -> None:
    """Without feature_type, the features of either type are the published ones, in everything."""
    for kind, rows in (("access_point", access_points), ("lock", locks)):
        own = {f["id"]: {k: v for k, v in f.items() if k != "feature_type"} for f in features if f.get("feature_type") == kind}
        if own != {r["id"]: r for r in rows} or len(features) != len(access_points) + len(locks):
            raise ExportError(f"the document of all features and the {kind}s differ")


def source_rows(registry: dict[str, Any]) -> tuple[list[dict], list[dict]]:
    """The registry's sources, and its map from artifact to sources, both flat and sorted; each relation must lead to a source."""
    sources = sorted(registry["sources"], key=lambda s: s["id"])
    known = {s["id"] for s in sources}
    flat = [{"source_id": s["id"], **{k: v for k, v in s.items() if k != "id"}} for s in sources]
    links = [{"artifact": a, "source_id": x.get("source_id", x.get("id")), "role": x["role"]} for a, entry in sorted(registry["artifacts"].items()) for x in entry["sources"]]
    if lost := {x["source_id"] for x in links} - known:
        raise ExportError(f"no such source: {sorted(lost)}")
    return flat, sorted(links, key=lambda x: (x["artifact"], x["source_id"], x["role"]))


def check_relations(access_points: list[dict], locks: list[dict], activities: list[dict]) -> None:
    """Every id that a row refers to exists, and the two kinds of feature share none."""
    places, numbers, done = check_ids(access_points, "access points"), check_ids(locks, "locks"), check_ids(activities, "activities", text=False)
    if places & numbers:
        raise ExportError("an access point and a lock share an id")
    for a in access_points:
        if lost := {n["id"] for n in a["nearby_features"] if n.get("id")} - numbers - places:
            raise ExportError(f"{a['id']}: no such feature: {sorted(lost)}")
    for f in [*access_points, *locks]:
        for side in ("first", "latest"):
            event = f.get(f"{side}_covering_activity")
            if event and event["activity_id"] not in done:
                raise ExportError(f"{f['id']}: no such activity: {event['activity_id']}")


#: The fields that may be published of the coverage.
COVERAGE_FIELDS = ("canal_miles", "bin_miles", "combined_unique_miles", "combined_percent_complete", "remaining_miles", "run_unique_miles", "bike_unique_miles", "hike_unique_miles", "activity_count", "first_activity_date", "latest_activity_date", "longest_continuous_completed_section", "completed_segments", "remaining_segments", "run_segments", "bike_segments", "hike_segments", "methodology")
SCHEMA_VERSION = 1
SOURCE_COLUMNS = ("source_id", "name", "organization", "url", "description", "license")


def _rows(texts: dict[str, str], name: str, key: str | None = None) -> Any:
    """What a JSON file about to be written says; a part of it, which must be a list of objects, by its key."""
    found = json.loads(texts[f"json/{name}.json"])
    if key is None:
        return found
    if not isinstance(found, dict) or not isinstance(found.get(key), list) or not all(isinstance(r, dict) for r in found[key]):
        raise ExportError(f"{name}.json: {key} must be a list of objects")
    return found[key]


def publish(out: Path, activities: list[dict], coverage: dict[str, Any], access_points: list[dict] = (), locks: list[dict] = (), registry: dict | None = None, amenities: tuple[str, ...] = (), sources: dict[str, Any] | None = None) -> list[Path]:
    """Writes json/ and then csv/ below out, the CSV from what the JSON says; returns the files that changed. Every check runs
    before the first file is written. Without features or a registry, their files aren't written."""
    access_points, locks, sources = list(access_points), list(locks), sources or {}
    shown = [{k: a[k] for k in PUBLIC_FIELDS} for a in activities]
    documents: dict[str, Any] = {"activities": shown, "coverage": {k: coverage[k] for k in COVERAGE_FIELDS}}
    if access_points or locks:
        head = {"schema_version": SCHEMA_VERSION}
        documents |= {
            "access-points": head | {"sources": sources.get("access_points", {}), "access_points": access_points},
            "locks": head | {"sources": sources.get("locks", []), "locks": locks},
            "features": head | {"features": combined_features(access_points, locks)},
        }
    if registry:
        documents["sources"] = registry
    texts = {f"json/{name}.json": json_text(x) for name, x in documents.items()}
    done, covered = _rows(texts, "activities"), _rows(texts, "coverage")
    files = dict(texts)
    files |= {"csv/activities.csv": minimal_csv(done, CSV_FIELDS), "csv/coverage-segments.csv": quoted_csv(segment_rows(covered), SEGMENT_COLUMNS)}
    places, numbered = (_rows(texts, "access-points", "access_points"), _rows(texts, "locks", "locks")) if access_points or locks else ([], [])
    check_relations(places, numbered, done)
    if access_points or locks:
        check_document(_rows(texts, "features", "features"), places, numbered)
        flat = [flat_feature("access_point", r, amenities) for r in places] + [flat_feature("lock", r, amenities) for r in numbered]
        flat.sort(key=lambda r: (r["milepost"], r["feature_type"], r["name"], r["id"]))
        files |= {"csv/features.csv": quoted_csv(flat, feature_columns(amenities)), "csv/feature-nearby-features.csv": quoted_csv(nearby_rows(places), NEARBY_COLUMNS), "csv/access-point-nps-matches.csv": quoted_csv(match_rows(places), MATCH_COLUMNS)}
    if registry:
        told, links = source_rows(_rows(texts, "sources"))
        files |= {"csv/sources.csv": quoted_csv(told, SOURCE_COLUMNS), "csv/artifact-sources.csv": quoted_csv(links, ("artifact", "source_id", "role"))}
    return [out / name for name, text in files.items() if write_if_changed(out / name, text)]
