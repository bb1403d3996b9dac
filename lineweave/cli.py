"""Command line: build, audit, reference inspect, reference build."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import date
from pathlib import Path
from typing import Any
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.operators.graph import LineError, assemble, source_edges
from lineweave.plans.build import audit_report, line_digest, load_reference, match_export, write
from lineweave.plans.invariants import InvariantError
from lineweave.plans.publish import ExportError, json_text, write_if_changed
from lineweave.plans.render import RenderError
from lineweave.sources.catalog import CatalogError, discover_export
from lineweave.sources.reference_json import TRAIL_CANDIDATES, TRAIL_EXPECTED, TRAIL_NAMES, TRAIL_USES, UNIT, ReferenceError_, fetch_geojson, load_line, load_object, select_trail, unit_trails, validate_line

KNOWN = (CatalogError, ExportError, InvariantError, LineError, ReferenceError_, RenderError)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "audit"):
        c = sub.add_parser(name)
        c.add_argument("--export", type=Path)
        c.add_argument("--root", type=Path, default=Path("data/raw"))
        c.add_argument("--line", default="data/reference/line.geojson")
        c.add_argument("--out", type=Path, default=Path("data"))
        c.add_argument("--access-points", help="JSON of access points; with --locks, what is published of features too")
        c.add_argument("--locks", help="JSON of locks")
        c.add_argument("--guide", help="JSON of the recreation guide")
    ref = sub.add_parser("reference").add_subparsers(dest="action", required=True)
    for name in ("inspect", "build"):
        c = ref.add_parser(name)
        c.add_argument("source", help="GeoJSON of trail features, a file or the http(s) query of a feature service")
        c.add_argument("--line", type=Path, default=Path("data/reference/line.geojson"))
        c.add_argument("--retrieved", type=date.fromisoformat, default=date.today())
    return p


def trail_source(spark: SparkSession, source: str) -> dict[str, Any]:
    if not source.startswith(("http://", "https://")):
        return load_object(spark, source)
    try:
        return fetch_geojson(urlopen, source)
    except (OSError, ValueError) as error:
        raise ReferenceError_(f"the service failed: {error}") from error


def chosen_trail(features: DataFrame) -> DataFrame:
    """The line's own features, numbered in the order of their ids."""
    p = lambda k: F.element_at("properties", k)
    order = W.orderBy(F.coalesce(p("OBJECTID").try_cast("long"), F.lit(0)), F.coalesce(p("GEOMETRYID"), F.lit("")), "feature_order")  # a few hundred rows
    return select_trail(features, TRAIL_NAMES, TRAIL_CANDIDATES, TRAIL_EXPECTED, TRAIL_USES).withColumn("feature_order", F.row_number().over(order))


#: What the line's file says of it.
LINE_PROPERTIES = {"direction": "Georgetown to Cumberland", "name": "C&O Canal Towpath", "source": "National Park Service Public Trails"}


def metadata(retrieved: date, source: str, found: int, selected: int) -> str:
    return f"""# The reference line

- Source: {LINE_PROPERTIES["source"]}, `{source}`, unit {UNIT}
- Retrieved: {retrieved.isoformat()}
- Features of the unit: {found}
- Features of the line: {selected}

Equal lines count once, parts up to 50 m apart are joined, and the only way between the line's two ends is kept, from
{LINE_PROPERTIES["direction"]}. Made for analysis, not for navigation.
"""


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    if args.command == "reference":
        found = trail_source(spark, args.source).get("features")
        if not isinstance(found, list):
            raise ReferenceError_(f"{args.source} has no features")
        features = unit_trails(spark, found)
        if args.action == "inspect":
            keys = ("TRLNAME", "MAPLABEL", "TRLSTATUS", "TRLSURFACE", "TRLUSE", "TRLTYPE")
            counts = features.groupBy(*(F.element_at("properties", k).alias(k) for k in keys)).count().orderBy(*keys)
            return "\n".join("\t".join(str(v) for v in r) for r in counts.collect())
        chosen = chosen_trail(features)
        line = assemble(source_edges(chosen))
        validate_line(line)
        properties = {**LINE_PROPERTIES, "unit_code": UNIT, "selected_nps_feature_count": chosen.count()}
        shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": properties, "geometry": {"type": "LineString", "coordinates": line}}]}
        changed = write_if_changed(args.line, json_text(json.loads(json.dumps(shape))))
        note = args.line.with_name("README.md")
        if changed or not note.exists():  # the date is that of the last change
            write_if_changed(note, metadata(args.retrieved, args.source, features.count(), properties["selected_nps_feature_count"]))
        return f"{len(line)} vertices; {'written' if changed else 'unchanged'}"
    folder = discover_export(args.root, args.export)
    build = match_export(spark, str(folder), load_line(spark, args.line), line_sha256=line_digest(spark, args.line))
    reference = load_reference(spark, args.access_points, args.locks, args.guide) if args.access_points and args.locks else None
    write(build, args.out / "processed", args.out / "public", reference=reference)
    return audit_report(build) if args.command == "audit" else build.report()


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(run(spark, args))
    except KNOWN as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
