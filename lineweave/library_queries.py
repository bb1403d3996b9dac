"""Queries that put whole parts of the library to the test: catalog, records, rules, features, trail selection, distances.

As in ``queries``, the tables stand for what they lack: events for a catalog's rows, orders for activities, suppliers for
locks, parts for trail features. Some rows are made to break each rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.config import LineConfig
from lineweave.functions.geo import geodesic_near
from lineweave.operators import history as hist
from lineweave.operators.graph import near_pairs, source_edges
from lineweave.plans.features import GUIDE_AMENITIES, Reference, published_access_points, published_locks
from lineweave.plans.invariants import history_violations, segment_violations
from lineweave.plans.records import activity_records
from lineweave.queries import _E2, _SEG, _domain, _plane, _t, activity_bins
from lineweave.sources.catalog import Catalog, judge_catalog
from lineweave.sources.reference_json import TRAIL_EXPECTED, TRAIL_NAMES, TRAIL_USES, in_unit, select_trail

AS_MODE = {"F": "run", "O": "bike", "P": "hike"}


def _catalog(spark: SparkSession, d: str) -> Catalog:
    e, n = _t(spark, d, "events"), F.col("event_id")
    text = lambda c: c.cast("string")
    value = text(F.round("value", 2))
    raw = e.select(
        F.when(n % 29 == 0, F.concat(F.lit("x"), text(n))).when(n % 50 == 8, text(n - 1)).otherwise(text(n)).alias("Activity ID"),
        F.when(n % 31 == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("Activity Date"),
        F.concat(F.lit("Event "), text(n)).alias("Activity Name"),
        F.when(F.col("event_type") == "view", "Run").when(F.col("event_type") == "click", "Ride").when(F.col("event_type") == "purchase", "Hike").when(n % 3 == 0, " ").otherwise(F.col("event_type")).alias("Activity Type"),
        F.when(n % 17 == 0, "  ").when(n % 19 == 0, "../0.gpx.gz").otherwise(F.concat(F.lit("t/"), text(n % 100), F.lit(".gpx.gz"))).alias("Filename"),
        value.alias("Elapsed Time"),
        value.alias("Elapsed Time.1"),
        F.when(n % 23 == 0, "inf").when(n % 23 == 1, "-").otherwise(value).alias("Moving Time"),
        value.alias("Distance"),
        text(F.round(F.col("value") * 1000, 2)).alias("Distance.1"),
        *(value.alias(c) for c in ("Elevation Gain", "Elevation Loss", "Average Speed", "Max Speed", "Average Heart Rate", "Max Heart Rate", "Calories")),
    )
    files = spark.range(60).select(F.concat(F.lit("/x/t/"), text(F.col("id")), F.lit(".gpx.gz")).alias("path"))
    return judge_catalog(raw, files, "/x")


def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    """Activities of the wanted types: ids that aren't numbers or repeat are out, dates parsed, units and blanks settled."""
    a = _catalog(spark, d).activities
    return a.select("activity_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "activity_name", "original_type", "mode", "elapsed_seconds", "moving_seconds", "distance_meters", "filename", "track")


def catalog_issues(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).issues.select(F.coalesce("activity_id", F.lit(-1)).alias("activity_id"), "code")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d).type_counts


def published_activities(spark: SparkSession, d: str) -> DataFrame:
    """Records of activities with their match statistics, history and segments."""
    o = _t(spark, d, "orders")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    activities = o.select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("activity_name"), F.col("o_totalprice").alias("distance_meters"), (F.sqrt("o_totalprice") * 100).alias("moving_seconds"), *none("double", "elapsed_seconds", "elevation_gain_meters", "elevation_loss_meters", "average_heart_rate", "max_heart_rate", "calories"), *none("string", "description", "filename"))
    l = _t(spark, d, "lineitem")
    stats = l.groupBy(F.col("l_orderkey").alias("activity_id")).agg(F.count_if(F.col("l_quantity") > 25).alias("matched_points"), F.count("*").alias("total_points"), F.min("l_discount").alias("median_offset"), F.max("l_discount").alias("p90_offset"), F.max("l_tax").alias("median_alignment"), F.sum("l_quantity").alias("travel_miles"))
    n = _domain(spark, d)
    r = activity_records(activities, stats, activity_bins(spark, d).select("activity_id", "bin"), "https://a/", LineConfig(line_miles=n * 0.01, bin_count=n))
    return r.select("activity_id", "date", "time", "activity_name", "activity_type", "strava_distance_miles", "co_travel_miles", "co_unique_miles", "new_co_unique_miles", "cumulative_unique_miles", "min_milepost", "max_milepost", "moving_time_minutes", "matched_point_count", "match_percentage", F.size("segments").cast("long").alias("n_segments"), "strava_url")


def invariant_report(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a history in which some rows are made wrong."""
    bins, k = activity_bins(spark, d), F.col("activity_id")
    right = hist.coverage_history(bins)
    wrong = right.withColumns({"new_bins": F.when(k % 97 == 0, -1).when(k % 89 == 0, F.col("unique_bins") + 1).otherwise(F.col("new_bins")), "cumulative_bins": F.when(k % 101 == 0, F.col("cumulative_bins") - 700).otherwise(F.col("cumulative_bins"))})
    return history_violations(wrong, bins, _domain(spark, d) - 500)


def segment_report(spark: SparkSession, d: str) -> DataFrame:
    """Rules of segments that overlap, run backwards, leave the line, lie off the bins' edges or lack a value."""
    l = _t(spark, d, "lineitem")
    n = _domain(spark, d)
    start = F.round((F.col("l_partkey") * 40 + F.floor("l_quantity")) * 0.01, 2) + F.when(F.col("l_suppkey") % 13 == 0, 0.003).otherwise(0.0)
    end = F.round((F.col("l_partkey") * 40 + F.floor("l_quantity") + F.col("l_linenumber") + F.when(F.col("l_suppkey") % 7 == 0, -4).otherwise(1)) * 0.01, 2)
    miles = F.when(F.col("l_suppkey") % 17 == 0, F.lit(None)).when(F.col("l_suppkey") % 19 == 0, 1.0).otherwise(F.round(end - start, 6))
    rows = l.select("l_orderkey", (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_quantity") * 100 + F.col("l_suppkey") % 100).alias("pos"), start.alias("start_milepost"), end.alias("end_milepost"), miles.cast("double").alias("miles"))
    return segment_violations(rows, ("l_orderkey",), LineConfig(line_miles=(n - 500) * 0.01))


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, LineConfig]:
    n = _domain(spark, d)
    bins = activity_bins(spark, d)
    named = F.create_map(*(F.lit(x) for pair in AS_MODE.items() for x in pair))
    bins = bins.withColumn("mode", F.element_at(named, F.col("mode")))
    records = _t(spark, d, "orders").select(F.col("o_orderkey").alias("activity_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("strava_url"))
    left = hist.scope_segments(bins, n, tuple(AS_MODE.values())).filter("coverage_status = 'remaining'")
    mile = lambda c: F.round(c * 0.01, 2)
    remaining = left.select(mile(F.col("start_bin")).alias("start_milepost"), mile(F.col("end_bin")).alias("end_milepost"), mile(F.col("end_bin") - F.col("start_bin")).alias("miles"))
    return bins, records, remaining, LineConfig(line_miles=n * 0.01, bin_count=n)


def _locks(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("lock_number"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") > 12, F.col("s_name")).alias("common_name"), F.round(F.col("s_suppkey") * 1.37, 2).alias("milepost"))


def locks_published(spark: SparkSession, d: str) -> DataFrame:
    """Locks with what covers them and what of the line remains around them."""
    bins, records, remaining, cfg = _covered(spark, d)
    out = published_locks(Reference(spark.range(0).toDF("point_id"), _locks(spark, d)), records, bins, remaining, cfg)
    modes = [F.col(f"coverage_by_mode.{m}").alias(f"{m}_status") for m in AS_MODE.values()] + [F.col(f"covering_activity_count_by_mode.{m}").alias(f"{m}_count") for m in AS_MODE.values()]
    return out.select("id", "coverage_status", *modes, "covering_activity_count", F.coalesce("first_covering_activity.activity_id", F.lit(-1)).alias("first_id"), F.coalesce("first_covering_activity.date", F.lit("")).alias("first_date"), F.coalesce("latest_covering_activity.strava_url", F.lit("")).alias("latest_url"), F.size("remaining_segments").cast("long").alias("n_remaining"))


def nearby_published(spark: SparkSession, d: str) -> DataFrame:
    """What is published as near an access point, in its order: locks within a mile, and free locations of the guide."""
    bins, records, remaining, cfg = _covered(spark, d)
    c, p = _t(spark, d, "nation"), _t(spark, d, "region")
    points = c.select(F.col("n_nationkey").alias("point_id"), F.concat(F.lit("Zone "), F.col("n_name")).alias("name"), F.round(F.col("n_nationkey") * 3.9, 2).alias("milepost"), F.when(F.col("n_nationkey") % 4 == 0, F.round(F.col("n_nationkey") * 3.9 + 2, 2)).alias("milepost_end"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    guide = p.select(F.col("r_regionkey").cast("int").alias("location_id"), F.concat(F.lit("Tunnel "), F.col("r_name")).alias("name"), F.round(F.col("r_regionkey") * 15.6 + 0.5, 2).alias("milepost"), *(F.lit(False).alias(a) for a in GUIDE_AMENITIES))
    out = published_access_points(Reference(points, _locks(spark, d), guide), records, bins, remaining, cfg)
    flat = out.select("point_id", F.col("id").alias("access_point_id"), F.posexplode("nearby_features").alias("place", "n"))
    return flat.select("point_id", "access_point_id", "place", "n.type", "n.name", "n.milepost", "n.milepost_distance", "n.source")


def trail_selection(spark: SparkSession, d: str) -> DataFrame:
    """The line's own features among all of a park's, by unit, name, attributes and uses."""
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    good = F.concat(F.when(k % 2 == 0, "Towpath,  Mile ").otherwise("towpath mile "), k.cast("string"), F.lit(" - "), (k + 1).cast("string"))
    other = k % 5 != 0
    said = {"OBJECTID": (10_000 - k).cast("string"), "UNITCODE": F.when(F.col("p_size") % 2 == 0, " choh ").otherwise("OTHR"), "TRLNAME": F.when(other, F.col("p_name")).otherwise(good), "TRLUSE": F.when(other, "Horse").otherwise("Horse| bicycle |Hiker / Pedestrian"), "GEOMETRYID": F.lit("g"), **{f: F.upper(F.lit(v)) for f, v in TRAIL_EXPECTED.items()}}
    features = p.select(k.alias("feature_order"), F.create_map(*(x for f, v in said.items() for x in (F.lit(f), v))).alias("properties"))
    return select_trail(features.filter(in_unit("CHOH")), TRAIL_NAMES, "towpath", TRAIL_EXPECTED, TRAIL_USES).select(F.col("feature_order").cast("long").alias("feature_order"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _plane(spark, d).select("vec_id", (F.floor(F.col("x") * 20) / 200 - 77).alias("lon"), (F.floor(F.col("y") * 20) / 200 + 39).alias("lat"), F.col("vec_id").alias("id"))


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines from a point to the middle and on: repeated vertices and repeated lines, also reversed ones, count once."""
    middle = F.array(F.lit(-77.0), F.lit(39.0))
    own = F.array("lon", "lat")
    line = F.when(F.col("vec_id") % 2 == 0, F.array(own, own, middle, middle)).otherwise(F.array(middle, own))
    rows = _lines(spark, d).select(F.col("vec_id").cast("int").alias("feature_order"), F.array(line).alias("lines"))
    return source_edges(rows).select(F.col("edge.feature_order").alias("feature_order"), F.size("coordinates").alias("vertices"))


def endpoint_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points within 900 m on the ellipsoid."""
    pts = _plane(spark, d).select(F.col("vec_id").alias("id"), (F.col("x") - 77).alias("lon"), (F.col("y") + 39).alias("lat"))
    return near_pairs(pts, 900.0, 0.05, geodesic_near).select("a", "b", F.round("distance", 4).alias("meters"))


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Length on the ellipsoid of each label's line through its points."""
    e = _t(spark, d, "embeddings").select("vec_id", "label", (F.get("embedding", F.lit(0)).cast("double") / 10 - 77).alias("lon"), (F.get("embedding", F.lit(1)).cast("double") / 10 + 39).alias("lat"))
    w = W.partitionBy("label").orderBy("vec_id")
    step = geodesic_near(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))
    return e.withColumn("step", step).groupBy("label").agg(F.count("step").alias("steps"), F.round(F.sum("step"), 2).alias("meters"))


_RAW = """
raw AS (SELECT event_id AS n, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 50 = 8 THEN event_id - 1 ELSE event_id END AS id,
    CASE WHEN event_id % 31 <> 3 THEN date_trunc('second', ts) END AS ts, round(value, 2) AS v, round(value * 1000, 2) AS m,
    CASE event_type WHEN 'view' THEN 'Run' WHEN 'click' THEN 'Ride' WHEN 'purchase' THEN 'Hike' END AS original_type, event_type,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '../0.gpx.gz' ELSE 't/' || event_id % 100 || '.gpx.gz' END AS file FROM events),
cand AS (SELECT *, count(*) OVER (PARTITION BY id) AS copies, coalesce(file LIKE '../%', false) AS unsafe, coalesce(file LIKE 't/%' AND n % 100 < 60, false) AS there FROM raw WHERE original_type IS NOT NULL),
judged AS (SELECT *, CASE WHEN id IS NULL THEN 'invalid_activity_id' WHEN copies > 1 THEN 'duplicate_activity_id' WHEN ts IS NULL THEN 'invalid_activity_date' END AS skip,
    CASE WHEN file IS NULL THEN 'missing_filename' WHEN unsafe THEN 'unsafe_filename' WHEN NOT there THEN 'missing_gps_file' END AS lost FROM cand)
"""
_HIST = f"{_SEG}, f AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ts, activity_id) AS rn FROM (SELECT DISTINCT activity_id, ts, bin FROM ab)), g AS (SELECT activity_id, ts, count(*) AS u, count(*) FILTER (rn = 1) AS new FROM f GROUP BY activity_id, ts), h AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, activity_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM g)"
_GEO = "sqrt(pow(6378137.0::DOUBLE * (1 - e2) / (w * sqrt(w)) * radians(lat2 - lat1), 2) + pow(6378137.0::DOUBLE / sqrt(w) * cos(mid) * radians(lon2 - lon1), 2))"
_LOCK = "lk AS (SELECT s_suppkey, s_name, round(s_suppkey * 1.37::DOUBLE, 2) AS milepost, CAST(floor(CAST(round(s_suppkey * 1.37::DOUBLE, 2) AS DECIMAL(12,6)) * 100) AS INT) AS bin0 FROM supplier), lb AS (SELECT lk.*, least(bin0, n - 1) AS bin FROM lk, dom)"

SQL: dict[str, str] = {
    "catalog_scan": f"WITH {_RAW} SELECT id AS activity_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'Event ' || n AS activity_name, original_type, CASE original_type WHEN 'Run' THEN 'run' WHEN 'Ride' THEN 'bike' ELSE 'hike' END AS mode, v AS elapsed_seconds, CASE WHEN n % 23 < 2 THEN NULL ELSE v END AS moving_seconds, m AS distance_meters, CASE WHEN NOT unsafe THEN file END AS filename, CASE WHEN there THEN '/x/' || file END AS track FROM judged WHERE skip IS NULL",
    "catalog_issues": f"WITH {_RAW} SELECT coalesce(id, -1) AS activity_id, coalesce(skip, lost) AS code FROM judged WHERE coalesce(skip, lost) IS NOT NULL",
    "type_counts": f"WITH {_RAW} SELECT coalesce(original_type, CASE WHEN n % 3 = 0 THEN '(missing)' ELSE nullif(trim(event_type), '') END, '(missing)') AS activity_type, count(*) AS n FROM raw GROUP BY 1",
    "published_activities": f"WITH {_HIST}, own AS (SELECT DISTINCT activity_id, bin FROM ab), i AS (SELECT activity_id, min(bin) AS a, max(bin) + 1 AS b FROM (SELECT *, bin - row_number() OVER (PARTITION BY activity_id ORDER BY bin) AS g FROM own) GROUP BY activity_id, g), s AS (SELECT activity_id, count(*) AS k, min(a) AS a, max(b) AS b FROM i GROUP BY activity_id), st AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS mp, count(*) AS tp, sum(l_quantity) AS tm FROM lineitem GROUP BY 1) SELECT o_orderkey AS activity_id, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M:%SZ') AS time, o_orderpriority AS activity_name, o_orderstatus AS activity_type, round(o_totalprice / 1609.344, 3) AS strava_distance_miles, round(tm, 3) AS co_travel_miles, round(u * 0.01::DOUBLE, 2) AS co_unique_miles, round(new * 0.01::DOUBLE, 2) AS new_co_unique_miles, round(c * 0.01::DOUBLE, 2) AS cumulative_unique_miles, round(a * 0.01::DOUBLE, 2) AS min_milepost, round(b * 0.01::DOUBLE, 2) AS max_milepost, round(sqrt(o_totalprice) * 100 / 60, 2) AS moving_time_minutes, mp AS matched_point_count, round(mp * 100.0::DOUBLE / tp, 2) AS match_percentage, k AS n_segments, 'https://a/' || o_orderkey AS strava_url FROM h JOIN s USING (activity_id) JOIN st ON l_orderkey = activity_id JOIN orders ON o_orderkey = activity_id",
    "invariant_report": f"WITH {_HIST}, x AS (SELECT activity_id, ts, u, CASE WHEN activity_id % 97 = 0 THEN -1 WHEN activity_id % 89 = 0 THEN u + 1 ELSE new END AS new, CASE WHEN activity_id % 101 = 0 THEN c - 700 ELSE c END AS c FROM h), y AS (SELECT *, lag(c) OVER (PARTITION BY ts::DATE ORDER BY ts, activity_id) AS before FROM x), r AS (SELECT count(*) FILTER (new < 0) AS r1, count(*) FILTER (new > u) AS r2, count(*) FILTER (c < before) AS r3, max(c) AS fin, sum(new) AS sn, arg_max(c, row(ts, activity_id)) AS la FROM y), q AS (SELECT count(DISTINCT bin) AS un, count(*) FILTER (bin < 0 OR bin >= n - 500) AS outside FROM seg2, dom GROUP BY ()) SELECT unnest(['new_not_negative', 'new_at_most_unique', 'cumulative_never_falls', 'final_is_union', 'sum_of_new_is_union', 'within_line', 'chronological']) AS rule, CAST(unnest([r1, r2, r3, (fin <> un)::BIGINT, (sn <> un)::BIGINT, outside, (la <> fin)::BIGINT]) AS BIGINT) AS violations FROM r, q".replace("FROM seg2, dom GROUP BY ()", "FROM (SELECT unnest(range(start_bin, end_bin)) AS bin FROM seg), dom"),
    "segment_report": "WITH dom AS (SELECT (count(*) * 40 + 60 - 500) * 0.01::DOUBLE AS n FROM part), r AS (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_quantity * 100 + l_suppkey % 100 AS pos, round((l_partkey * 40 + floor(l_quantity)) * 0.01::DOUBLE, 2) + CASE WHEN l_suppkey % 13 = 0 THEN 0.003::DOUBLE ELSE 0 END AS s, round((l_partkey * 40 + floor(l_quantity) + l_linenumber + CASE WHEN l_suppkey % 7 = 0 THEN -4 ELSE 1 END) * 0.01::DOUBLE, 2) AS e, l_suppkey FROM lineitem), m AS (SELECT *, CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_suppkey % 19 = 0 THEN 1.0::DOUBLE ELSE round(e - s, 6) END AS miles, lag(e) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM r), c AS (SELECT count(*) FILTER (miles IS NULL) AS a, count(*) FILTER (s < 0 OR s >= e OR e > n) AS b, count(*) FILTER (s < before - 1e-8) AS c, count(*) FILTER (NOT (abs(round(s / 0.01::DOUBLE) * 0.01::DOUBLE - s) <= 1e-8) OR NOT (abs(round(e / 0.01::DOUBLE) * 0.01::DOUBLE - e) <= 1e-8)) AS d, count(*) FILTER (NOT abs(miles - (e - s)) <= greatest(1e-9 * greatest(abs(miles), abs(e - s)), 1e-8)) AS f FROM m, dom) SELECT unnest(['well_formed', 'inside_line', 'ordered_apart', 'on_bin_edges', 'miles_from_ends']) AS rule, unnest([a, b, c, d, f]) AS violations FROM c",
    "locks_published": f"WITH {_SEG}, {_LOCK}, hit AS (SELECT s_suppkey, activity_id, any_value(ts) AS ts, any_value(mode) AS mode FROM lb JOIN ab USING (bin) GROUP BY s_suppkey, activity_id), g AS (SELECT s_suppkey, count(*) AS c, count(*) FILTER (mode = 'F') AS f, count(*) FILTER (mode = 'O') AS o, count(*) FILTER (mode = 'P') AS p, arg_min(activity_id, row(ts, activity_id::VARCHAR)) AS a, arg_max(activity_id, row(ts, activity_id::VARCHAR)) AS z FROM hit GROUP BY s_suppkey), rem AS (SELECT round(start_bin * 0.01::DOUBLE, 2) AS x, round(end_bin * 0.01::DOUBLE, 2) AS y FROM isl WHERE coverage_status = 'remaining'), lf AS (SELECT s_suppkey, count(*) AS k FROM lk JOIN rem ON x <= milepost AND (y > milepost OR (y = milepost AND milepost = (SELECT n * 0.01::DOUBLE FROM dom))) GROUP BY s_suppkey) SELECT 'lock-' || lk.s_suppkey AS id, CASE WHEN c > 0 THEN 'covered' ELSE 'remaining' END AS coverage_status, CASE WHEN f > 0 THEN 'covered' ELSE 'remaining' END AS run_status, CASE WHEN o > 0 THEN 'covered' ELSE 'remaining' END AS bike_status, CASE WHEN p > 0 THEN 'covered' ELSE 'remaining' END AS hike_status, coalesce(f, 0) AS run_count, coalesce(o, 0) AS bike_count, coalesce(p, 0) AS hike_count, coalesce(c, 0) AS covering_activity_count, coalesce(a, -1) AS first_id, coalesce(strftime(oa.o_orderdate, '%Y-%m-%d'), '') AS first_date, coalesce('u' || z, '') AS latest_url, CASE WHEN c > 0 THEN 0 ELSE coalesce(k, 0) END AS n_remaining FROM lk LEFT JOIN g USING (s_suppkey) LEFT JOIN lf USING (s_suppkey) LEFT JOIN orders oa ON oa.o_orderkey = a",
    "nearby_published": f"WITH dom AS (SELECT count(*) * 40 + 60 AS n FROM part), {_LOCK}, pt AS (SELECT n_nationkey AS point_id, 'zone-' || lower(n_name) AS base, round(n_nationkey * 3.9::DOUBLE, 2) AS s, CASE WHEN n_nationkey % 4 = 0 THEN round(n_nationkey * 3.9::DOUBLE + 2, 2) END AS e FROM nation), o AS (SELECT 'lock' AS type, s_name AS name, milepost, 'locks' AS source FROM lk UNION ALL SELECT 'tunnel', 'Tunnel ' || r_name, round(r_regionkey * 15.6::DOUBLE + 0.5, 2), 'recreation_guide' FROM region), j AS (SELECT *, CASE WHEN milepost BETWEEN s AND coalesce(nullif(e, 0), s) THEN 0 ELSE least(abs(milepost::DECIMAL(12,6) - s::DECIMAL(12,6)), abs(milepost::DECIMAL(12,6) - coalesce(nullif(e, 0), s)::DECIMAL(12,6))) END::DOUBLE AS far FROM pt, o) SELECT point_id::INT AS point_id, regexp_replace(base, '[^a-z0-9]+', '-', 'g') || '-' || replace(s::VARCHAR, '.', '-') || CASE WHEN e IS NOT NULL THEN '-' || replace(e::VARCHAR, '.', '-') ELSE '' END AS access_point_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY round(far, 2), milepost, type, name) - 1 AS INT) AS place, type, name, milepost, round(far, 2) AS milepost_distance, source FROM j WHERE far <= 1",
    "trail_selection": "SELECT p_partkey AS feature_order FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 = 0",
    "source_lines": "WITH p AS (SELECT vec_id, floor(embedding[1]::DOUBLE * 20) / 200 - 77 AS lon, floor(embedding[2]::DOUBLE * 20) / 200 + 39 AS lat FROM embeddings), u AS (SELECT min(vec_id) AS feature_order FROM p WHERE NOT (lon = -77 AND lat = 39) GROUP BY lon, lat) SELECT CAST(feature_order AS INT) AS feature_order, 2 AS vertices FROM u",
    "endpoint_pairs": f"WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE - 77 AS lon, embedding[2]::DOUBLE + 39 AS lat FROM embeddings), j AS (SELECT a.id AS a, b.id AS b, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2, radians((a.lat + b.lat) / 2) AS mid, {_E2}::DOUBLE AS e2, 1 - {_E2}::DOUBLE * pow(sin(radians((a.lat + b.lat) / 2)), 2) AS w FROM p a JOIN p b ON a.id < b.id) SELECT a, b, round({_GEO}, 4) AS meters FROM j WHERE {_GEO} <= 900",
    "line_lengths": f"WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE / 10 - 77 AS lon1, embedding[2]::DOUBLE / 10 + 39 AS lat1 FROM embeddings), q AS (SELECT *, lead(lon1) OVER o AS lon2, lead(lat1) OVER o AS lat2 FROM p WINDOW o AS (PARTITION BY label ORDER BY vec_id)), j AS (SELECT *, radians((lat1 + lat2) / 2) AS mid, {_E2}::DOUBLE AS e2, 1 - {_E2}::DOUBLE * pow(sin(radians((lat1 + lat2) / 2)), 2) AS w FROM q) SELECT label, count({_GEO}) AS steps, round(sum({_GEO}), 2) AS meters FROM j GROUP BY label",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
