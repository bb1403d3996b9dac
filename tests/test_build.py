"""From an export folder with GPX, TCX and FIT files to published files, and replay of a published result."""

import gzip
import json
import os
import struct
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lineweave import cli
from lineweave.config import EAST_ANCHOR, WEST_ANCHOR
from lineweave.operators import history
from lineweave.operators.bins import edge_bin, explode_segments
from lineweave.plans.build import audit, match_export, write
from lineweave.plans.features import ARTIFACTS, GUIDE_AMENITIES
from lineweave.plans.invariants import published_violations
from lineweave.plans.publish import ExportError, check_document, check_relations, quoted_csv, segment_rows, source_rows
from lineweave.plans.render import RenderError, check_intervals, substring
from lineweave.sources import reference_json as ref
from lineweave.sources import tracks
from lineweave.sources.catalog import REQUIRED, CatalogError, discover_export, load_catalog, unique_names

N = 400
LINE = [(EAST_ANCHOR[0] + (WEST_ANCHOR[0] - EAST_ANCHOR[0]) * k / N, EAST_ANCHOR[1] + (WEST_ANCHOR[1] - EAST_ANCHOR[1]) * k / N) for k in range(N + 1)]
T0 = datetime(2021, 5, 1, 12, tzinfo=UTC)


def along(start, end, n=60):
    """Points along the line between two shares of it, ten seconds apart."""
    out = []
    for i in range(n):
        s = (start + (end - start) * i / (n - 1)) * N
        k = min(int(s), N - 1)
        (x1, y1), (x2, y2) = LINE[k], LINE[k + 1]
        out.append((T0 + timedelta(seconds=10 * i), y1 + (s - k) * (y2 - y1), x1 + (s - k) * (x2 - x1)))
    return out


def gpx(points):
    body = "".join(f'<trkpt lat="{y}" lon="{x}"><time>{t:%Y-%m-%dT%H:%M:%SZ}</time></trkpt>' for t, y, x in points)
    return f'<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>{body}</trkseg></trk></gpx>'.encode()


def tcx(points):
    body = "".join(f"<Trackpoint><Time>{t:%Y-%m-%dT%H:%M:%SZ}</Time><Position><LatitudeDegrees>{y}</LatitudeDegrees><LongitudeDegrees>{x}</LongitudeDegrees></Position></Trackpoint>" for t, y, x in points)
    return f"   <TrainingCenterDatabase>{body}</TrainingCenterDatabase>".encode()


def fit(points):
    definition = bytes([0x40, 0, 0]) + struct.pack("<HB", 20, 3) + bytes([253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85])
    body = definition + b"".join(b"\0" + struct.pack("<Iii", int((t - tracks.FIT_EPOCH).total_seconds()), round(y / tracks.SEMICIRCLE), round(x / tracks.SEMICIRCLE)) for t, y, x in points)
    head = struct.pack("<BBHI4s", 14, 16, 100, len(body), b".FIT")
    head += struct.pack("<H", tracks.fit_crc(head))
    return head + body + struct.pack("<H", tracks.fit_crc(head + body))


def export(folder: Path):
    (folder / "activities").mkdir(parents=True)
    files = {"1.gpx.gz": gpx(along(0.1, 0.12)), "2.tcx.gz": tcx(along(0.11, 0.14)), "3.fit.gz": fit(along(0.5, 0.49)), "4.gpx.gz": b"<gpx><trk>", "5.gpx.gz": b"<gpx/>"}
    for name, data in files.items():
        (folder / "activities" / name).write_bytes(gzip.compress(data))
    header = [*REQUIRED, "Distance", "Activity Description"]
    row = lambda i, date, kind, file: [str(i), date, f'Name "{i}", x', kind, file, "600", "590", "5.0", "10", "9", "2.5", "3", "", "150", "", "5001", "two\nlines"]
    rows = [
        row(1, "May 1, 2021, 12:00:00 PM", "Run", "activities/1.gpx.gz"),
        row(2, "2021-05-02T08:00:00", "Ride", "activities/2.tcx.gz"),
        row(3, "May 3, 2021, 9:00:00 AM", "Hike", "activities/3.fit.gz"),
        row(4, "May 4, 2021, 9:00:00 AM", "Run", "activities/4.gpx.gz"),
        row(5, "May 5, 2021, 9:00:00 AM", "Run", "activities/5.gpx.gz"),
        row(6, "May 6, 2021, 9:00:00 AM", "Run", "activities/none.gpx.gz"),
        row(7, "not a date", "Run", "activities/1.gpx.gz"),
        row(8, "May 6, 2021, 9:00:00 AM", "Run", "../out.gpx.gz"),
        row(9, "May 6, 2021, 9:00:00 AM", "Run", ""),
        row(10, "May 6, 2021, 9:00:00 AM", "Run", "a"),
        row(10, "May 7, 2021, 9:00:00 AM", "Ride", "b"),
        row("x", "May 6, 2021, 9:00:00 AM", "Run", "a"),
        row(11, "May 6, 2021, 9:00:00 AM", "Swim", "a"),
        row(12, "May 6, 2021, 9:00:00 AM", "", "a"),
    ]
    cell = lambda v: '"' + v.replace('"', '""') + '"'
    (folder / "activities.csv").write_text("﻿" + "\n".join(",".join(map(cell, r)) for r in [header, *rows]) + "\n", encoding="utf-8")


def test_unique_names_and_discovery(tmp_path):
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    with pytest.raises(CatalogError):
        discover_export(tmp_path)
    export(tmp_path / "one")
    assert discover_export(tmp_path) == tmp_path / "one"


def test_parsers():
    points = along(0.2, 0.21, 5)
    for suffix, make in ((".gpx.gz", gpx), (".TCX.gz", tcx), (".fit.gz", fit)):
        got = tracks.parse_track("x" + suffix, gzip.compress(make(points)))
        assert [p[0] for p in got] == [p[0] for p in points]
        assert all(abs(a[1] - b[1]) < 1e-6 and abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, points))
    broken = bytearray(fit(points))
    broken[40] ^= 1
    for name, data in (("x.fit.gz", bytes(broken)), ("x.gpx.gz", b'<!DOCTYPE a><gpx/>'), ("x.gpx.gz", b"<gpx>"), ("x.txt", b"")):
        with pytest.raises(tracks.TrackError):
            tracks.parse_track(name, gzip.compress(data))
    odd = b'<gpx><rtept lat="91" lon="0"/><rtept lat="nan" lon="0"/><rtept lat="1" lon="2"/></gpx>'
    assert tracks.parse_track("a.gpx.gz", gzip.compress(odd)) == [(None, 1.0, 2.0)]


def reference_files(folder):
    none = dict.fromkeys(GUIDE_AMENITIES, False)
    points = [{"name": "Foo Ferry", "milepost": 19.0, "latitude": 39.0, "longitude": -77.1}, {"name": "Foo Ferry", "milepost": 19.0, "latitude": 39.5, "longitude": -77.1}, {"name": "Long Place", "milepost": 21.0, "milepost_end": 30.0, "latitude": 39.0, "longitude": -77.2}, {"name": "Nowhere", "milepost": 150.0, "latitude": 39.0, "longitude": -78.0}]
    locks = [{"lock_number": n, "name": f"Lock {n}", "common_name": c, "milepost": m, "alternate_milepost": None, "notes": None} for n, c, m in (("7", "Seven", 19.5), ("8", None, 150.5))]
    guide = [("Foo Ferry Park", 19.1, none | {"water": True}), ("Big Tunnel", 19.8, none), ("Lock 7 Camp", 19.9, none)]
    said = {
        "access-points": {"access_points": points, "source": {"name": "Points", "url": "https://p"}},
        "locks": {"locks": locks, "sources": [{"name": "National Park Service", "role": "numbers", "url": "https://n"}, {"name": "Trust", "role": "mileposts", "url": "https://t"}]},
        "guide": {"locations": [{"name": n, "milepost": m, "amenities": a} for n, m, a in guide], "source": {"name": "Guide", "url": "https://g"}},
    }
    out = []
    for name, value in said.items():
        (folder / f"{name}.json").write_text(json.dumps(value))
        out += [f"--{name}", str(folder / f"{name}.json")]
    return out


def check_features(folder):
    names = {p.name for p in (folder / "json").iterdir()} | {p.name for p in (folder / "csv").iterdir()}
    assert names == set(ARTIFACTS) and len(names) == 13
    found = json.loads((folder / "json/access-points.json").read_text())
    assert found["sources"] == {"name": "Points", "url": "https://p"}
    by_id = {p["id"]: p for p in found["access_points"]}
    assert set(by_id) == {"foo-ferry-19-0-lat-39-0-lon-minus-77-1", "foo-ferry-19-0-lat-39-5-lon-minus-77-1", "long-place-21-0-30-0", "nowhere-150-0"}
    first = by_id["foo-ferry-19-0-lat-39-0-lon-minus-77-1"]
    assert first["nps_amenities"]["water"] is True and first["nps_amenities"]["food"] is False
    assert first["nps_recreation_matches"] == [{"name": "Foo Ferry Park", "milepost": 19.1, "milepost_distance": 0.1}]
    lock = {"id": "lock-7", "type": "lock", "lock_number": "7", "name": "Lock 7", "common_name": "Seven", "milepost": 19.5, "milepost_distance": 0.5, "source": "locks"}
    assert first["nearby_features"] == [lock, {"type": "tunnel", "name": "Big Tunnel", "milepost": 19.8, "milepost_distance": 0.8, "source": "recreation_guide"}]
    assert first["coverage_status"] == "covered" and first["coverage_by_mode"] == {"run": "covered", "bike": "remaining", "hike": "remaining"}
    assert first["first_covering_activity"]["activity_id"] == 1 and first["remaining_segments"] == []
    long, nowhere = by_id["long-place-21-0-30-0"], by_id["nowhere-150-0"]
    assert long["coverage_status"] == "partial" and long["covering_activity_count_by_mode"] == {"run": 1, "bike": 1, "hike": 0}
    assert (long["first_covering_activity"]["activity_id"], long["latest_covering_activity"]["activity_id"]) == (1, 2)
    assert nowhere["coverage_status"] == "remaining" and nowhere["covering_activity_count"] == 0 and nowhere["first_covering_activity"] is None and nowhere["nps_amenities"] is None and len(nowhere["remaining_segments"]) == 1
    together = json.loads((folder / "json/features.json").read_text())["features"]
    assert [f["milepost"] for f in together] == sorted(f["milepost"] for f in together) and len(together) == 6
    flat = (folder / "csv/features.csv").read_text().splitlines()
    assert len(flat) == 7 and len(flat[0].split(",")) == 46 and flat[0].startswith('"id","feature_type","name"')
    assert len((folder / "csv/feature-nearby-features.csv").read_text().splitlines()) == 1 + 5 and len((folder / "csv/access-point-nps-matches.csv").read_text().splitlines()) == 3
    sources = json.loads((folder / "json/sources.json").read_text())
    assert len(sources["sources"]) == 6 and len(sources["artifacts"]) == 13 and {s["url"] for s in sources["sources"]} > {"https://p", "https://n", "https://t", "https://g"}
    assert len((folder / "csv/artifact-sources.csv").read_text().splitlines()) == 1 + 54


def test_build(spark, tmp_path, capsys):
    export(tmp_path / "export")
    catalog = load_catalog(spark, tmp_path / "export")
    assert (catalog.total_rows, catalog.candidate_rows) == (14, 12)
    assert {r.activity_type: r.n for r in catalog.type_counts.collect()}["(missing)"] == 1
    build = match_export(spark, str(tmp_path / "export"), LINE)
    codes = sorted((r.activity_id or 0, r.code) for r in build.issues.collect())
    assert codes == [(0, "invalid_activity_id"), (4, "track_parse_failure"), (5, "no_gps_coordinates"), (6, "missing_gps_file"), (7, "invalid_activity_date"), (8, "unsafe_filename"), (9, "missing_filename"), (10, "duplicate_activity_id"), (10, "duplicate_activity_id")]
    rows = {r.activity_id: r for r in build.records.collect()}
    assert set(rows) == {1, 2, 3}
    assert abs(rows[1].min_milepost - 18.45) < 0.1 and abs(rows[1].co_unique_miles - 3.69) < 0.05
    assert abs(rows[2].new_co_unique_miles - 3.69) < 0.05 and abs(rows[3].co_unique_miles - 1.85) < 0.05
    assert build.coverage["activity_count"] == 3 and len(build.coverage["completed_segments"]) == 2
    changed = write(build, tmp_path / "processed", tmp_path / "public")
    assert changed and not write(build, tmp_path / "processed", tmp_path / "public")
    shown = json.loads((tmp_path / "public/json/activities.json").read_text())
    assert len(shown) == 3 and not {"description", "calories", "max_heart_rate", "filename", "matching_diagnostics"} & set(shown[0])
    assert (tmp_path / "public/map.svg").read_text().startswith("<svg")
    assert "covered: 3" in build.report()
    assert {r.activity_id for r in audit(build).collect()} <= {1, 2, 3}
    line = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": LINE}}]}
    (tmp_path / "line.geojson").write_text(json.dumps(line))
    files = reference_files(tmp_path)
    args = lambda what: cli.parser().parse_args([what, "--export", str(tmp_path / "export"), "--line", str(tmp_path / "line.geojson"), "--out", str(tmp_path / "data"), *files])
    assert "covered: 3" in cli.run(spark, args("build"))
    check_features(tmp_path / "data/public")
    report = cli.run(spark, args("audit"))
    assert "completion: " in report and "to review: " in report and "duplicate_activity_id=2" in report
    assert cli.main(["build", "--root", str(tmp_path / "nothing")]) == 1


def test_reference_files(spark, tmp_path):
    line = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"UNITCODE": " a ", "TRLNAME": "Mile 1", "TRLUSE": "Hike|Bike", "OBJECTID": 2}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"type": "Feature", "properties": {"UNITCODE": "B", "TRLNAME": "Other"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]]]}}]}
    f = ref.trail_features(spark, line["features"])
    assert f.filter(ref.in_unit("A")).count() == 1 and ref.missing_fields(f, ("TRLNAME", "NONE")) == ["NONE"]
    assert ref.select_trail(f, r"mile \d+", "mile", {"TRLNAME": "Mile 1"}, ("Hike",)).count() == 1
    with pytest.raises(ref.ReferenceError_):
        ref.select_trail(f, r"mile \d+", "other", {})
    with pytest.raises(Exception):
        ref.validate_line([(0, 0), (2, 2), (2, 0), (0, 2)])
    points = {"access_points": [{"name": "A", "milepost": 1.0, "milepost_end": None, "latitude": 1, "longitude": 2}]}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(points))
    assert ref.load_access_points(spark, str(path)).first().milepost == 1.0
    path.write_text(json.dumps({"access_points": [points["access_points"][0] | {"milepost": True}]}))
    with pytest.raises(ref.ReferenceError_):
        ref.load_access_points(spark, str(path))

    class Answer:
        def __init__(self, data):
            self.data = data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self):
            return json.dumps(self.data).encode()

    opener = lambda data: lambda url, timeout: Answer(data)
    assert ref.fetch_geojson(opener(line), "u")["type"] == "FeatureCollection"
    for bad in ({"error": 1}, {"type": "x"}, line | {"exceededTransferLimit": True}):
        with pytest.raises(ref.ReferenceError_):
            ref.fetch_geojson(opener(bad), "u")


def test_reference_build_takes_the_towpath_alone(spark, tmp_path, monkeypatch):
    def feature(k, coordinates, **other):
        own = {f: None for f in ref.TRAIL_FIELDS} | {"OBJECTID": k, "UNITCODE": "choh", "TRLNAME": f"Towpath, Mile {k} - {k + 1}", "TRLUSE": "Bicycle | Hiker / Pedestrian|Horse", **ref.TRAIL_EXPECTED, "TRLSTATUS": "EXISTING"}
        return {"type": "Feature", "properties": own | other, "geometry": {"type": "LineString", "coordinates": coordinates}}

    path = tmp_path / "trails.geojson"
    args = lambda action, source=path: cli.parser().parse_args(["reference", action, str(source), "--line", str(tmp_path / "out.geojson")])
    good = [feature(2, LINE[200:]), feature(1, LINE[:201])]
    side = feature(3, [LINE[200], (LINE[200][0], LINE[200][1] + 0.1)], TRLNAME="Side Trail")
    other = feature(4, LINE[100:301], UNITCODE="OTHR")

    def put(features):
        path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))

    put([*good, side, other])
    assert f"{N + 1} vertices" in cli.run(spark, args("build"))
    made = json.loads((tmp_path / "out.geojson").read_text())["features"][0]
    assert made["properties"]["selected_nps_feature_count"] == 2 and (tmp_path / "README.md").exists() and len(made["geometry"]["coordinates"]) == N + 1
    assert cli.run(spark, args("inspect")).count("\n") == 2  # the unit's three
    monkeypatch.setattr(cli, "fetch_geojson", lambda opener, url: json.loads(path.read_text()))
    assert "unchanged" in cli.run(spark, args("build", "https://service/query"))
    short = [{**f, "properties": {k: v for k, v in f["properties"].items() if k != "GEOMETRYID"}} for f in good]
    for bad in ([*good, feature(5, LINE[:9], TRLNAME="Towpath Detour")], [*good, feature(5, LINE[:9], TRLUSE="Bicycle")], [other], [side], short):
        put(bad)
        with pytest.raises(ref.ReferenceError_):
            cli.run(spark, args("build"))


def test_gate_on_first_touch(spark, tmp_path):
    export(tmp_path / "export")
    build = match_export(spark, str(tmp_path / "export"), LINE)
    broken = lambda records: {k for k, n in published_violations(records, build.coverage).items() if n}
    at = lambda column, values: build.records.withColumn(column, F.coalesce(*(F.when(F.col("activity_id") == i, F.col(column) + d) for i, d in values.items()), F.col(column)))
    assert not broken(build.records)
    # the totals stay right
    assert broken(at("new_co_unique_miles", {1: -0.5, 3: 0.5})) >= {"new_is_first_touch"}
    assert "cumulative_is_running_union" in broken(at("cumulative_unique_miles", {1: 0.5}))
    assert "cumulative_never_falls" in broken(at("cumulative_unique_miles", {1: 90.0}))
    assert "chronological" in broken(build.records.withColumn("ts", F.when(F.col("activity_id") > 1, F.col("ts"))))


def test_publication_checks():
    place = {"id": "a-1", "name": "A", "milepost": 1.0, "nearby_features": [{"id": "lock-1", "type": "lock"}], "first_covering_activity": {"activity_id": 5}}
    lock = {"id": "lock-1", "name": "L", "milepost": 1.0}
    check_relations([place], [lock], [{"activity_id": 5}])
    for bad in (([place], [], [{"activity_id": 5}]), ([place], [lock], []), ([place | {"id": "A 1"}], [lock], [{"activity_id": 5}]), ([place | {"id": "lock-1"}], [lock], [{"activity_id": 5}])):
        with pytest.raises(ExportError):
            check_relations(*bad)
    assert quoted_csv([{"a": 'x"y', "b": 1.5, "c": None, "d": True}], ("a", "b", "c", "d")) == '"a","b","c","d"\n"x""y",1.5,,true\n'
    together = [{"feature_type": "access_point", **place}, {"feature_type": "lock", **lock}]
    check_document(together, [place], [lock])
    for odd in (together[:1], [together[0] | {"name": "B"}, together[1]], [*together, together[1]]):
        with pytest.raises(ExportError):
            check_document(odd, [place], [lock])
    flat, links = source_rows({"sources": [{"id": "s", "name": "n"}], "artifacts": {"f": {"sources": [{"source_id": "s", "role": "r"}]}}})
    assert flat == [{"source_id": "s", "name": "n"}] and links == [{"artifact": "f", "source_id": "s", "role": "r"}]
    with pytest.raises(RenderError):
        check_intervals([{"start_milepost": 2.0, "end_milepost": 1.0, "miles": -1.0}])
    assert substring([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 0.25, 0.75) == [(5.0, 0.0), (10.0, 0.0), (10.0, 5.0)]


@pytest.mark.skipif("GOLDEN_DIR" not in os.environ, reason="GOLDEN_DIR names a folder with a published result")
def test_replay(spark):
    """A published result's mileages and segments follow from its activities' segments alone."""
    folder = Path(os.environ["GOLDEN_DIR"])
    shown = json.loads((folder / "json/activities.json").read_text())
    coverage = json.loads((folder / "json/coverage.json").read_text())
    rows = [(a["activity_id"], datetime.fromisoformat(a["date"]), a["activity_type"], float(s["start_milepost"]), float(s["end_milepost"])) for a in shown for s in a["segments"]]
    df = spark.createDataFrame(rows, "activity_id long, ts timestamp, mode string, s double, e double")
    bins = explode_segments(df.withColumns({"a": edge_bin(F.col("s")), "b": edge_bin(F.col("e"))}), "a", "b").select("activity_id", "ts", "mode", "bin")
    got = {r.activity_id: r for r in history.coverage_history(bins).collect()}
    for a in shown:
        r = got[a["activity_id"]]
        assert (round(r.unique_bins / 100, 2), round(r.new_bins / 100, 2), round(r.cumulative_bins / 100, 2)) == (a["co_unique_miles"], a["new_co_unique_miles"], a["cumulative_unique_miles"])
        assert round(r.cumulative_bins / 184.5, 3) == a["cumulative_percent_complete"]
    flat = quoted_csv(segment_rows(coverage), ("coverage_scope", "coverage_status", "start_milepost", "end_milepost", "miles"))
    assert flat == (folder / "csv/coverage-segments.csv").read_text()
    runs = {(r.coverage_scope, r.coverage_status, round(r.start_bin / 100, 2), round(r.end_bin / 100, 2)) for r in history.scope_segments(bins, 18450, ("run", "bike", "hike")).collect()}
    assert runs == {(r["coverage_scope"], r["coverage_status"], r["start_milepost"], r["end_milepost"]) for r in segment_rows(coverage)}
    schema = "activity_id long, activity_type string, co_unique_miles double, new_co_unique_miles double, cumulative_unique_miles double, cumulative_percent_complete double, min_milepost double, max_milepost double, segments array<struct<start_milepost:double,end_milepost:double,miles:double>>"
    keys = [c.split()[0] for c in schema.split(", ") if "array" not in c]
    data = [tuple(float(a[k]) if k not in ("activity_id", "activity_type") else a[k] for k in keys) + ([(float(s["start_milepost"]), float(s["end_milepost"]), float(s["miles"])) for s in a["segments"]],) for a in shown]
    assert not any(published_violations(spark.createDataFrame(data, schema), coverage).values())
