"""Track files (gzip GPX, TCX, FIT) to ordered points. One file is one row of binaryFile; parsing runs where the bytes are."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.scratch import ship

SEMICIRCLE = 180 / 2**31
FIT_EPOCH = datetime(1989, 12, 31, tzinfo=UTC)
Point = tuple[datetime | None, float, float]


class TrackError(RuntimeError):
    """One track can't be read; an issue, not a failure of the run."""


def _time(text: str | None) -> datetime | None:
    try:
        when = datetime.fromisoformat((text or "").strip())
    except ValueError:
        return None
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)


def _point(when: datetime | None, lat: object, lon: object) -> Point | None:
    try:
        y, x = float(lat), float(lon)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return (when, y, x) if abs(y) <= 90 and abs(x) <= 180 else None


def _root(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data.upper() or b"<!ENTITY" in data.upper():
        raise TrackError("document types and entities aren't allowed")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as error:
        raise TrackError(str(error)) from error


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_tcx(data: bytes) -> list[Point]:
    out = []
    for node in _root(data).iter():
        if _local(node.tag) == "Trackpoint":
            own = {_local(x.tag): x.text for x in node.iter()}
            out.append(_point(_time(own.get("Time")), own.get("LatitudeDegrees"), own.get("LongitudeDegrees")))
    return [p for p in out if p]


def parse_gpx(data: bytes) -> list[Point]:
    out = []
    for node in _root(data).iter():
        if _local(node.tag) in ("trkpt", "rtept"):
            when = next((x.text for x in node if _local(x.tag) == "time"), None)
            out.append(_point(_time(when), node.get("lat"), node.get("lon")))
    return [p for p in out if p]


def fit_crc(data: bytes) -> int:
    """CRC-16 of the FIT protocol (reflected polynomial 0xA001)."""
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    return crc


def parse_fit(data: bytes) -> list[Point]:
    """Record messages (global number 20) with both positions; timestamps may be compressed into headers."""
    if len(data) < 14 or data[8:12] != b".FIT":
        raise TrackError("not a FIT file")
    head, size = data[0], struct.unpack_from("<I", data, 4)[0]
    end = head + size
    if len(data) < end + 2 or fit_crc(data[: end + 2]) != 0:
        raise TrackError("the checksum doesn't match")
    kinds: dict[int, tuple[str, int, list[tuple[int, int]], int]] = {}
    out: list[Point] = []
    at, last = head, 0
    try:
        while at < end:
            header = data[at]
            at += 1
            if not header & 0x80 and header & 0x40:
                order = ">" if data[at + 1] else "<"
                number, n = struct.unpack_from(f"{order}HB", data, at + 2)
                fields = [(data[at + 5 + 3 * i], data[at + 6 + 3 * i]) for i in range(n)]
                at += 5 + 3 * n
                extra = 0
                if header & 0x20:
                    extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                    at += 1 + 3 * data[at]
                kinds[header & 0x0F] = (order, number, fields, extra)
                continue
            order, number, fields, extra = kinds[header >> 5 & 3 if header & 0x80 else header & 0x0F]
            own = {}
            for field, width in fields:
                own[field] = data[at : at + width]
                at += width
            at += extra
            if header & 0x80:
                last += (header & 0x1F) - last & 0x1F
                stamp: int | None = last
            else:
                raw = own.get(253)
                stamp = struct.unpack(f"{order}I", raw)[0] if raw is not None and len(raw) == 4 else None
                last = stamp if stamp is not None else last
            if number == 20 and len(own.get(0, b"")) == 4 and len(own.get(1, b"")) == 4:
                lat, lon = (struct.unpack(f"{order}i", own[k])[0] for k in (0, 1))
                if 0x7FFFFFFF not in (lat, lon):
                    when = FIT_EPOCH + timedelta(seconds=stamp) if stamp not in (None, 0xFFFFFFFF) else None
                    if point := _point(when, lat * SEMICIRCLE, lon * SEMICIRCLE):
                        out.append(point)
    except (IndexError, KeyError, struct.error) as error:
        raise TrackError("the records don't fit their definitions") from error
    return out


PARSERS = {".tcx.gz": parse_tcx, ".gpx.gz": parse_gpx, ".fit.gz": parse_fit}


def parse_track(path: str, data: bytes) -> list[Point]:
    parser = next((f for suffix, f in PARSERS.items() if path.lower().endswith(suffix)), None)
    if parser is None:
        raise TrackError("the suffix isn't known")
    try:
        return parser(gzip.decompress(data).lstrip())
    except (OSError, EOFError) as error:
        raise TrackError(str(error)) from error


def read_tracks(spark: SparkSession, activities: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """activities (activity_id, track: path or null) -> points (activity_id, seq, ts, lat, lon) and issues
    (activity_id, code, message, filename). seq is the order in the file; files are read where their rows are."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")
    wanted = files.join(activities.select("activity_id", F.col("track").alias("path")), "path").select("activity_id", "path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, path, content in zip(frame.activity_id, frame.path, frame.content, strict=True):
                try:
                    points = parse_track(path, bytes(content))
                except TrackError as error:
                    yield pd.DataFrame({"activity_id": [i], "path": [path], "seq": [None], "ts": [None], "lat": [None], "lon": [None], "error": [str(error)]}).astype({"seq": "Int32", "ts": "datetime64[us, UTC]", "lat": float, "lon": float})
                    continue
                if not points:
                    yield pd.DataFrame({"activity_id": [i], "path": [path], "seq": [None], "ts": [None], "lat": [None], "lon": [None], "error": [""]}).astype({"seq": "Int32", "ts": "datetime64[us, UTC]", "lat": float, "lon": float})
                    continue
                when, lat, lon = zip(*points, strict=True)
                yield pd.DataFrame({"activity_id": i, "path": path, "seq": pd.array(range(len(points)), "Int32"), "ts": pd.to_datetime(pd.Series(when), utc=True).astype("datetime64[us, UTC]"), "lat": lat, "lon": lon, "error": None})

    read = wanted.mapInPandas(run, "activity_id long, path string, seq int, ts timestamp, lat double, lon double, error string")
    points = read.filter(F.col("error").isNull()).select("activity_id", "seq", "ts", "lat", "lon")
    code = F.when(F.col("error") == "", "no_gps_coordinates").otherwise("track_parse_failure")
    issues = read.filter(F.col("error").isNotNull()).select("activity_id", code.alias("code"), F.col("error").alias("message"), F.col("path").alias("filename"))
    return points, issues
