"""The engine's operators over the driver's tables, each with the same question in plain SQL.

The tables hold no tracks, so each operator meets an analogue of the same shape. The line is the axis of parts: a
lineitem of part p and quantity q is a segment that begins at bin 40 p + q and is l_linenumber + 1 bins long; an
order is an activity (time o_orderdate, mode o_orderstatus). Events of a user are a track along ``value``. The first two
components of embeddings are a plane.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineweave.config import LineConfig
from lineweave.functions.geo import albers
from lineweave.functions.names import feature_type, lock_number, names_match, normalized_name, number_slug, slug
from lineweave.operators import features as feat
from lineweave.operators import history as hist
from lineweave.operators import match
from lineweave.operators.bins import explode_segments, islands, leg_bins
from lineweave.operators.bins import longest as longest_island
from lineweave.operators.graph import components, near_pairs
from lineweave.plans.audit import audit_flags as flags_of

MODES = ("F", "O", "P")
#: Tracks of events are sparse: hours between points, values of 0 to some hundreds.
TRACK = LineConfig(match_tolerance=400.0, max_source_gap=40.0, max_along_gap=40.0, max_time_gap=43_200.0, min_alignment_ratio=0.0, min_run_points=3, min_run_travel=32.0)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _domain(spark: SparkSession, d: str) -> int:
    return _t(spark, d, "part").count() * 40 + 60


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(activity_id, ts, mode, start_bin, end_bin)."""
    items = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 40 + F.floor("l_quantity")).cast("int").alias("start_bin"), (F.col("l_linenumber") + 1).alias("n"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("activity_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("mode"))
    return items.join(orders, F.col("l_orderkey") == F.col("activity_id")).select("activity_id", "ts", "mode", "start_bin", (F.col("start_bin") + F.col("n")).cast("int").alias("end_bin"))


def activity_bins(spark: SparkSession, d: str) -> DataFrame:
    return explode_segments(segments(spark, d), "start_bin", "end_bin").select("activity_id", "ts", "mode", "bin")


def coverage_history(spark: SparkSession, d: str) -> DataFrame:
    out = hist.coverage_history(activity_bins(spark, d))
    return out.select("activity_id", "ts", "unique_bins", "new_bins", "cumulative_bins", F.round(F.col("cumulative_bins") * 100 / F.lit(_domain(spark, d)), 3).alias("percent"))


def coverage_segments(spark: SparkSession, d: str) -> DataFrame:
    return hist.scope_segments(activity_bins(spark, d), _domain(spark, d), MODES)


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _domain(spark, d)
    totals = hist.mode_totals(activity_bins(spark, d))
    return totals.select("scope", "bins", F.round(F.col("bins") * 0.01, 2).alias("miles"), F.round(F.col("bins") * 100 / F.lit(n), 3).alias("percent"), (F.lit(n) - F.col("bins")).alias("remaining_bins"))


def longest_section(spark: SparkSession, d: str) -> DataFrame:
    return longest_island(islands(activity_bins(spark, d).select("bin"))).select("start_bin", "end_bin", "bins")


def activity_summary(spark: SparkSession, d: str) -> DataFrame:
    """First and last time and number of activities, by mode."""
    a = segments(spark, d).select("activity_id", "ts", "mode").distinct()
    return a.groupBy("mode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _track(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("user_id").alias("activity_id"), "ts", "event_id", "value")
    seq = F.row_number().over(W.partitionBy("activity_id").orderBy("ts", "event_id"))
    return e.select("activity_id", seq.alias("seq"), "ts", F.col("value").alias("along"), F.col("value").alias("x"), F.lit(0.0).alias("y"), (F.col("value") <= TRACK.match_tolerance).alias("accepted"), (F.col("value") / 10).alias("offset"))


def track_runs(spark: SparkSession, d: str) -> DataFrame:
    r = match.runs(match.legs(_track(spark, d), TRACK), TRACK)
    return r.groupBy("activity_id", "run").agg(F.min("seq").cast("long").alias("first_seq"), F.max("run_points").alias("points"), F.round(F.max("run_travel"), 4).alias("travel"), F.bool_or("kept").alias("kept")).drop("run")


def track_match_stats(spark: SparkSession, d: str) -> DataFrame:
    s = match.point_statistics(_track(spark, d))
    pct = F.round(F.col("matched_points") * 100 / F.col("total_points"), 2)
    return s.select("activity_id", "total_points", "matched_points", F.round("median_offset", 6).alias("median_offset"), F.round("p90_offset", 6).alias("p90_offset"), pct.alias("match_percentage"))


def track_bins(spark: SparkSession, d: str) -> DataFrame:
    """Legs of kept runs to the bins that they touch."""
    cfg = LineConfig(line_miles=1000.0, bin_miles=1.0, bin_count=1000)
    kept = match.runs(match.legs(_track(spark, d), TRACK), TRACK).filter("kept")
    bins = kept.select("activity_id", F.explode(leg_bins(F.col("along"), F.col("next_along"), cfg)).alias("bin")).distinct()
    return islands(bins, ("activity_id",)).select("activity_id", "start_bin", "end_bin", "bins")


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings' points to a zigzag line over the plane."""
    xs = [(i, -1.0 + i * 0.05, 0.8 if i % 2 else -0.8) for i in range(41)]
    line = match.line_segments(spark.createDataFrame(xs, "seq int, x double, y double"))
    out = match.nearest_segment(_plane(spark, d), line, 0.02, ("vec_id",), 40)
    return out.select("vec_id", F.coalesce(F.col("idx").cast("int"), F.lit(-1)).alias("idx"), F.round("offset", 6).alias("offset"), F.round("along", 6).alias("along"))


def projected_points(spark: SparkSession, d: str) -> DataFrame:
    x, y = albers(F.col("x") * 10 - 77, F.col("y") * 5 + 39)
    return _plane(spark, d).select("vec_id", F.round(x, 2).alias("px"), F.round(y, 2).alias("py"))


def nearby_features(spark: SparkSession, d: str) -> DataFrame:
    """Customers within a band of each supplier's balance, as the nearest and how many."""
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("milepost"))
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("at"))
    near = feat.band_join(s, c, "milepost", None, "at", "1.0")
    return near.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("distance").cast("double"), 4).alias("total"), F.min_by("c_custkey", F.struct("distance", "at", "c_custkey")).alias("nearest"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Parts as features: a name, and a range of bins for every third."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_name").alias("name"), (F.col("p_partkey") * 0.4).alias("milepost"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") * 0.4 + 0.3).alias("milepost_end"), "p_type", "p_size", "p_brand")
    return p


def name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Parts that are near on the axis and alike in name."""
    a = _places(spark, d).select("point_id", normalized_name(F.col("name")).alias("name"), "milepost", "milepost_end")
    b = _places(spark, d).select(F.col("point_id").alias("location_id"), normalized_name(F.col("name")).alias("loc_name"), F.col("milepost").alias("loc_milepost"))
    near = feat.band_join(a, b, "milepost", "milepost_end", "loc_milepost", "1.2").filter(F.col("point_id") != F.col("location_id"))
    return near.filter(names_match(F.col("name"), F.col("loc_name"))).select("point_id", "location_id", F.col("distance").cast("double").alias("distance"))


def amenity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of event each customer ever had; null without any event."""
    kinds = ("view", "click", "purchase")
    pts = _t(spark, d, "customer").select(F.col("c_custkey").alias("point_id"))
    m = _t(spark, d, "events").select(F.col("user_id").alias("point_id"), *((F.col("event_type") == k).alias(k) for k in kinds))
    return feat.any_amenity(pts, m, kinds)


def unmatched_features(spark: SparkSession, d: str) -> DataFrame:
    """Parts never sold by the first supplier key of their size class and without a canonical size."""
    loc = _t(spark, d, "part").select(F.col("p_partkey").alias("location_id"), F.col("p_size").alias("lock_number"))
    m = _t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("location_id"))
    known = _t(spark, d, "nation").select(F.col("n_nationkey").alias("lock_number"))
    return feat.unmatched(loc, m, known).select("location_id", "lock_number")


def feature_types(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    flags = {"visitor_center": F.col("p_size") > 45, "canal_quarters": F.col("p_size") > 40, "camping": F.col("p_size") > 30, "boat_ramp": F.col("p_size") > 20, "canoe_kayak_ramp": F.col("p_size") > 15}
    kind = feature_type(F.concat_ws(" ", "p_name", "p_type"), flags)
    return p.groupBy(kind.alias("feature_type")).agg(F.count("*").alias("n"))


def lock_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from names like "Lock 12 1/3 (Brand)"."""
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_size") > 25, "Lock ").otherwise("Dam "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " 1/3").otherwise(""), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("name"))
    return p.select("p_partkey", lock_number(F.col("name")).alias("lock_number"))


def public_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parts named by type and place; those that share a name and place get a longer id."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_type").alias("name"), F.col("p_size").alias("milepost"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).alias("milepost_end"), F.length("p_name").alias("latitude"), (-F.length("p_brand")).alias("longitude"))
    return feat.public_ids(p, F.col("p_partkey").cast("string")).select("p_partkey", "id")


def url_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", slug(F.col("url")).alias("slug"), number_slug(-F.col("page_id")).alias("number"))


def _feature_bins(spark: SparkSession, d: str) -> DataFrame:
    cfg = LineConfig(line_miles=1e9, bin_count=1_000_000_000)
    return feat.exploded_feature_bins(_places(spark, d), "point_id", cfg)


def covering_activities(spark: SparkSession, d: str) -> DataFrame:
    out = feat.covering_activities(_feature_bins(spark, d), activity_bins(spark, d), "point_id", MODES)
    return out.select("point_id", "covering_count", *(f"covering_{m}" for m in MODES), F.coalesce("first_id", F.lit(-1)).alias("first_id"), F.coalesce("last_id", F.lit(-1)).alias("last_id"))


def feature_status(spark: SparkSession, d: str) -> DataFrame:
    return feat.status(_feature_bins(spark, d), activity_bins(spark, d).select("bin").distinct(), "point_id")


def remaining_for_feature(spark: SparkSession, d: str) -> DataFrame:
    left = hist.scope_segments(activity_bins(spark, d), _domain(spark, d), MODES).filter("coverage_status = 'remaining'")
    left = left.select(F.round(F.col("start_bin") * 0.01, 2).alias("start_milepost"), F.round(F.col("end_bin") * 0.01, 2).alias("end_milepost"))
    places = _places(spark, d)
    places = places.withColumns({"milepost": F.round("milepost", 2), "milepost_end": F.round("milepost_end", 2)})
    out = feat.remaining_for(places, feature_status(spark, d), left, "point_id", LineConfig(line_miles=_domain(spark, d) * 0.01))
    return out.select("point_id", "start_milepost", "end_milepost")


def flatten_public(spark: SparkSession, d: str) -> DataFrame:
    """Activities nested with their segments, then flat again, one row a segment."""
    runs = islands(activity_bins(spark, d).select("activity_id", "bin"), ("activity_id",))
    nested = runs.groupBy("activity_id").agg(F.sort_array(F.collect_list(F.struct("start_bin", "end_bin"))).alias("segments"))
    return nested.select("activity_id", F.posexplode("segments").alias("pos", "s")).select("activity_id", "pos", "s.start_bin", "s.end_bin")


def artifact_sources(spark: SparkSession, d: str) -> DataFrame:
    """A map from region to its nations, flat again."""
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = n.groupBy("r_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("sources"))
    return m.select(F.col("r_name").alias("artifact"), F.explode("sources").alias("source_id", "role"))


def feature_union(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of feature with different columns as one, in publication order."""
    a = _t(spark, d, "part").select(F.lit("part").alias("feature_type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("milepost"), "p_size")
    b = _t(spark, d, "supplier").select(F.lit("supplier").alias("feature_type"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("milepost"))
    return a.unionByName(b, allowMissingColumns=True).withColumn("p_size", F.coalesce("p_size", F.lit(-1))).orderBy("milepost", "feature_type", "name", "id")


def route_components(spark: SparkSession, d: str) -> DataFrame:
    """Points of the plane within some metres of each other, transitively."""
    pts = _plane(spark, d).select(F.col("vec_id").alias("id"), (F.col("x") - 77).alias("lon"), (F.col("y") + 39).alias("lat"))
    return components(near_pairs(pts, 1500.0, 0.05)).select("node", "component")


def trail_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Counts of attribute tuples."""
    p = _t(spark, d, "part")
    keys = ("p_brand", "p_type", "p_size")
    return p.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys)


def relation_integrity(spark: SparkSession, d: str) -> DataFrame:
    """References without a target, for each relation; all should be 0."""
    l, o, p, s = (_t(spark, d, t) for t in ("lineitem", "orders", "part", "supplier"))
    lost = lambda a, k, b, j, name: a.join(b, F.col(k) == F.col(j), "left_anti").agg(F.count("*").alias("lost")).select(F.lit(name).alias("relation"), "lost")
    return lost(l, "l_orderkey", o, "o_orderkey", "order").unionByName(lost(l, "l_partkey", p, "p_partkey", "part")).unionByName(lost(l, "l_suppkey", s, "s_suppkey", "supplier"))


def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    """Review flags of tracks: match statistics against the track's own length."""
    stats = match.point_statistics(_track(spark, d))
    legged = match.legs(_track(spark, d), TRACK)
    travel = match.runs(legged, TRACK).filter("kept").groupBy("activity_id").agg(F.round(F.sum("along_distance"), 4).alias("co_travel_miles"), F.min("along").alias("low"), F.max("along").alias("high"), F.count_distinct("run").alias("n_segments"))
    whole = legged.groupBy("activity_id").agg(F.round(F.sum("along_distance") / 10, 4).alias("distance_miles"))
    rows = stats.join(travel, "activity_id", "left").join(whole, "activity_id", "left")
    rows = rows.select("activity_id", (F.col("matched_points") * 100 / F.col("total_points")).alias("match_percentage"), F.col("matched_points").alias("matched_point_count"), F.coalesce("co_travel_miles", F.lit(0.0)).alias("co_travel_miles"), "distance_miles", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.col("median_offset"), F.coalesce("co_travel_miles", F.lit(0.0)).alias("co_unique_miles"), (F.col("low") < 3.5).alias("in_review"))
    return rows.select("activity_id", F.array_join(flags_of(), ",").alias("flags"))


def set_checks(spark: SparkSession, d: str) -> DataFrame:
    """Completed and remaining bins: overlap, union, and what is missing of the line."""
    n = _domain(spark, d)
    done = activity_bins(spark, d).select("bin").distinct()
    left = hist.complement(done, n)
    return done.withColumn("k", F.lit(1)).unionByName(left.withColumn("k", F.lit(2))).groupBy("bin").agg(F.bit_or("k").alias("k")).agg(F.count_if(F.col("k") == 3).alias("both"), F.count("*").alias("together"), F.count_if(F.col("k") == 1).alias("completed"), F.count_if(F.col("k") == 2).alias("remaining"), (F.lit(n) - F.count("*")).alias("missing"))


_SEG = """
seg AS (SELECT o_orderkey AS activity_id, o_orderdate AS ts, o_orderstatus AS mode, CAST(l_partkey * 40 + floor(l_quantity) AS INT) AS start_bin, CAST(l_partkey * 40 + floor(l_quantity) + l_linenumber + 1 AS INT) AS end_bin
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ab AS (SELECT DISTINCT activity_id, ts, mode, CAST(unnest(range(start_bin, end_bin)) AS INT) AS bin FROM seg),
dom AS (SELECT count(*) * 40 + 60 AS n FROM part),
scopes AS (SELECT DISTINCT 'combined' AS coverage_scope, 'completed' AS coverage_status, bin FROM ab
    UNION ALL SELECT 'combined', 'remaining', CAST(g AS INT) FROM (SELECT unnest(range(n)) AS g FROM dom) WHERE g NOT IN (SELECT bin FROM ab)
    UNION ALL SELECT DISTINCT mode, 'covered', bin FROM ab),
isl AS (SELECT coverage_scope, coverage_status, CAST(min(bin) AS INT) AS start_bin, CAST(max(bin) + 1 AS INT) AS end_bin, count(*) AS bins
    FROM (SELECT *, bin - row_number() OVER (PARTITION BY coverage_scope, coverage_status ORDER BY bin) AS g FROM scopes) GROUP BY coverage_scope, coverage_status, g)
"""
_TRACK = """
tr AS (SELECT user_id AS activity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, value AS along, value <= 400 AS accepted, value / 10 AS off FROM events),
lg AS (SELECT *, lead(along) OVER w AS next_along, lead(ts) OVER w AS next_ts, lead(accepted) OVER w AS next_ok, lead(seq) OVER w AS next_seq FROM tr WINDOW w AS (PARTITION BY activity_id ORDER BY seq)),
pl AS (SELECT *, abs(next_along - along) AS dist, accepted AND next_ok AND abs(next_along - along) <= 40 AND coalesce((epoch_us(next_ts) - epoch_us(ts)) / 1e6 BETWEEN 0 AND 43200, true) AS plausible FROM lg WHERE next_seq IS NOT NULL),
rn AS (SELECT *, sum(CASE WHEN plausible THEN 0 ELSE 1 END) OVER (PARTITION BY activity_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM pl),
kp AS (SELECT *, count(*) OVER r + 1 AS points, sum(dist) OVER r AS travel FROM rn WHERE plausible WINDOW r AS (PARTITION BY activity_id, run)),
kept AS (SELECT * FROM kp WHERE points >= 3 AND travel >= 32)
"""
_PLACE = """
pc AS (SELECT p_partkey AS point_id, p_name AS name, p_partkey * 0.4::DOUBLE AS milepost, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 0.4::DOUBLE + 0.3::DOUBLE END AS milepost_end FROM part),
fb AS (SELECT point_id, milepost_end IS NOT NULL AS is_range, CAST(unnest(range(CAST(floor(CAST(milepost AS DECIMAL(12,6)) * 100) AS BIGINT), CAST(floor(CAST(coalesce(milepost_end, milepost) AS DECIMAL(12,6)) * 100) AS BIGINT) + 1)) AS INT) AS bin FROM pc)
"""
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({0}), '’', ''''), '''s\\b', 's', 'g'), '\\bno\\.?\\s+(\\d)', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_KIND = "CASE WHEN list_contains({0}, 'aqueduct') THEN 'aqueduct' WHEN list_contains({0}, 'bridge') THEN 'bridge' WHEN list_contains({0}, 'dam') THEN 'dam' WHEN list_contains({0}, 'lock') THEN 'lock' WHEN list_contains({0}, 'tunnel') THEN 'tunnel' END"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"

_E2 = "0.0066943800229007876"
_ALBERS = f"""
c AS (SELECT {_E2}::DOUBLE AS e2, sqrt({_E2}::DOUBLE) AS e, radians(29.5::DOUBLE) AS p1, radians(45.5::DOUBLE) AS p2, radians(23.0::DOUBLE) AS p0),
k AS (SELECT e2, e, cos(p1) / sqrt(1 - e2 * sin(p1) ** 2) AS m1, cos(p2) / sqrt(1 - e2 * sin(p2) ** 2) AS m2,
    (1 - e2) * (sin(p1) / (1 - e2 * sin(p1) ** 2) - ln((1 - e * sin(p1)) / (1 + e * sin(p1))) / (2 * e)) AS q1,
    (1 - e2) * (sin(p2) / (1 - e2 * sin(p2) ** 2) - ln((1 - e * sin(p2)) / (1 + e * sin(p2))) / (2 * e)) AS q2,
    (1 - e2) * (sin(p0) / (1 - e2 * sin(p0) ** 2) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM c),
n AS (SELECT *, (m1 ** 2 - m2 ** 2) / (q2 - q1) AS n FROM k),
r AS (SELECT *, m1 ** 2 + n * q1 AS cc FROM n),
pt AS (SELECT vec_id, embedding[1]::DOUBLE * 10 - 77 AS lon, sin(radians(embedding[2]::DOUBLE * 5 + 39)) AS s FROM embeddings),
rho AS (SELECT vec_id, 6378137.0 * sqrt(cc - n * ((1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)))) / n AS rho, n * radians(lon + 96) AS theta, 6378137.0 * sqrt(cc - n * q0) / n AS rho0 FROM pt, r)
"""

SQL: dict[str, str] = {
    "coverage_history": f"WITH {_SEG}, f AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ts, activity_id) AS rn FROM (SELECT DISTINCT activity_id, ts, bin FROM ab)), g AS (SELECT activity_id, ts, count(*) AS unique_bins, count(*) FILTER (rn = 1) AS new_bins FROM f GROUP BY activity_id, ts), h AS (SELECT *, CAST(sum(new_bins) OVER (ORDER BY ts, activity_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_bins FROM g) SELECT h.*, round(cumulative_bins * 100 / n, 3) AS percent FROM h, dom",
    "coverage_segments": f"WITH {_SEG} SELECT * FROM isl",
    "coverage_summary": f"WITH {_SEG}, t AS (SELECT coalesce(mode, 'combined') AS scope, count(DISTINCT bin) AS bins FROM ab GROUP BY GROUPING SETS ((mode), ())) SELECT scope, bins, round(bins * 0.01::DOUBLE, 2) AS miles, round(bins * 100 / n, 3) AS percent, n - bins AS remaining_bins FROM t, dom",
    "longest_section": f"WITH {_SEG} SELECT start_bin, end_bin, bins FROM isl WHERE coverage_scope = 'combined' AND coverage_status = 'completed' ORDER BY bins DESC, start_bin LIMIT 1",
    "activity_summary": f"WITH {_SEG} SELECT mode, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT DISTINCT activity_id, ts, mode FROM seg) GROUP BY mode",
    "track_runs": f"WITH {_TRACK} SELECT activity_id, min(seq) AS first_seq, max(points) AS points, round(max(travel), 4) AS travel, bool_or(points >= 3 AND travel >= 32) AS kept FROM kp GROUP BY activity_id, run",
    "track_match_stats": f"WITH {_TRACK} SELECT activity_id, count(*) AS total_points, count(*) FILTER (accepted) AS matched_points, round(quantile_cont(CASE WHEN accepted THEN off END, 0.5), 6) AS median_offset, round(quantile_cont(CASE WHEN accepted THEN off END, 0.9), 6) AS p90_offset, round(count(*) FILTER (accepted) * 100 / count(*), 2) AS match_percentage FROM tr GROUP BY activity_id",
    "track_bins": f"WITH {_TRACK}, b AS (SELECT DISTINCT activity_id, CAST(unnest(range(CAST(floor(least(along, next_along)) AS BIGINT), CAST(least(999, floor(greatest(along, next_along))) AS BIGINT) + 1)) AS INT) AS bin FROM kept) SELECT activity_id, min(bin) AS start_bin, max(bin) + 1 AS end_bin, count(*) AS bins FROM (SELECT *, bin - row_number() OVER (PARTITION BY activity_id ORDER BY bin) AS g FROM b) GROUP BY activity_id, g",
    "nearest_segment": "WITH v AS (SELECT i, -1.0::DOUBLE + i * 0.05::DOUBLE AS x, CASE WHEN i % 2 = 1 THEN 0.8 ELSE -0.8 END::DOUBLE AS y FROM (SELECT unnest(range(41)) AS i)), s AS (SELECT a.i AS idx, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len FROM v a JOIN v b ON b.i = a.i + 1), t AS (SELECT *, sum(len) OVER (ORDER BY idx) - len AS start FROM s), p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len))) AS u FROM p, t), o AS (SELECT *, sqrt((x - (x1 + u * (x2 - x1))) ** 2 + (y - (y1 + u * (y2 - y1))) ** 2) AS off FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY off, idx) AS rn FROM o WHERE off <= 0.02) SELECT p.vec_id, coalesce(CAST(idx AS INT), -1) AS idx, round(off, 6) AS \"offset\", round(start + u * len, 6) AS along FROM p LEFT JOIN f ON p.vec_id = f.vec_id AND rn = 1",
    "projected_points": f"WITH {_ALBERS} SELECT vec_id, round(rho * sin(theta), 2) AS px, round(rho0 - rho * cos(theta), 2) AS py FROM rho",
    "nearby_features": "WITH d AS (SELECT s_suppkey, c_custkey, c_acctbal, abs(CAST(s_acctbal AS DECIMAL(12,6)) - CAST(c_acctbal AS DECIMAL(12,6))) AS distance FROM supplier, customer) SELECT s_suppkey, count(*) AS n, round(sum(distance)::DOUBLE, 4) AS total, arg_min(c_custkey, row(distance, c_acctbal, c_custkey)) AS nearest FROM d WHERE distance <= 1 GROUP BY s_suppkey",
    "name_matches": f"WITH {_PLACE}, x AS (SELECT point_id, {_NORM.format('name')} AS name, milepost::DECIMAL(12,6) AS s, coalesce(milepost_end, milepost)::DECIMAL(12,6) AS e FROM pc), j AS (SELECT a.point_id, b.point_id AS location_id, a.name AS an, b.name AS bn, string_split(a.name, ' ') AS aw, string_split(b.name, ' ') AS bw, CASE WHEN b.s BETWEEN a.s AND a.e THEN 0 ELSE least(abs(b.s - a.s), abs(b.s - a.e)) END::DOUBLE AS distance FROM x a JOIN x b ON a.point_id <> b.point_id AND b.s BETWEEN a.s - 1.2 AND a.e + 1.2) SELECT point_id, location_id, distance FROM j WHERE coalesce({_KIND.format('aw')} = {_KIND.format('bw')}, true) AND (contains(an, bn) OR contains(bn, an) OR len(list_filter(list_intersect(aw, bw), lambda w: len(w) >= 5 AND w NOT IN ('access', 'boat', 'center', 'lock', 'park', 'ramp', 'state', 'visitor'))) > 0)",
    "amenity_rollup": "SELECT c_custkey AS point_id, bool_or(event_type = 'view') AS \"view\", bool_or(event_type = 'click') AS click, bool_or(event_type = 'purchase') AS purchase FROM customer LEFT JOIN events ON c_custkey = user_id GROUP BY c_custkey",
    "unmatched_features": "SELECT p_partkey AS location_id, p_size AS lock_number FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size NOT IN (SELECT n_nationkey FROM nation)",
    "feature_types": "WITH x AS (SELECT lower(p_name || ' ' || p_type) AS low, p_size FROM part) SELECT CASE WHEN contains(low, 'lockhouse') THEN 'lockhouse' WHEN contains(low, 'lock') THEN 'lock' WHEN contains(low, 'aqueduct') THEN 'aqueduct' WHEN regexp_matches(low, '\\bdam\\b') THEN 'dam' WHEN contains(low, 'tunnel') THEN 'tunnel' WHEN p_size > 45 OR contains(low, 'visitor center') THEN 'visitor_center' WHEN p_size > 40 THEN 'canal_quarters' WHEN p_size > 30 THEN 'campground' WHEN p_size > 15 THEN 'boat_access' WHEN contains(low, 'fort ') THEN 'historic_site' ELSE 'recreation_location' END AS feature_type, count(*) AS n FROM x GROUP BY 1",
    "lock_numbers": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size::VARCHAR || CASE WHEN p_partkey % 2 = 0 THEN ' 1/3' ELSE '' END END AS lock_number FROM part",
    "public_ids": f"WITH b AS (SELECT p_partkey, concat_ws('-', {_SLUG.format('p_type')}, p_size, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 END) AS base, '-lat-' || length(p_name) || '-lon-minus-' || length(p_brand) AS place FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM b), i AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || place END AS cand FROM c), m AS (SELECT *, count(*) OVER (PARTITION BY cand) AS k FROM i) SELECT p_partkey, CASE WHEN k = 1 THEN cand ELSE cand || '-' || substr(sha256(p_partkey::VARCHAR), 1, 8) END AS id FROM m",
    "url_slugs": f"SELECT page_id, {_SLUG.format('url')} AS slug, CASE WHEN page_id = 0 THEN '0' ELSE 'minus-' || page_id END AS number FROM pages",
    "covering_activities": f"WITH {_SEG}, {_PLACE}, pr AS (SELECT DISTINCT point_id, activity_id, ts, mode FROM fb JOIN ab USING (bin)), g AS (SELECT point_id, count(*) AS c, count(*) FILTER (mode = 'F') AS f, count(*) FILTER (mode = 'O') AS o, count(*) FILTER (mode = 'P') AS p, arg_min(activity_id, row(ts, activity_id::VARCHAR)) AS first_id, arg_max(activity_id, row(ts, activity_id::VARCHAR)) AS last_id FROM pr GROUP BY point_id) SELECT point_id, coalesce(c, 0) AS covering_count, coalesce(f, 0) AS \"covering_F\", coalesce(o, 0) AS \"covering_O\", coalesce(p, 0) AS \"covering_P\", coalesce(first_id, -1) AS first_id, coalesce(last_id, -1) AS last_id FROM (SELECT DISTINCT point_id FROM fb) LEFT JOIN g USING (point_id)",
    "feature_status": f"WITH {_SEG}, {_PLACE}, cov AS (SELECT DISTINCT bin FROM ab), h AS (SELECT point_id, count(*) AS n, count(cov.bin) AS hits, bool_or(is_range) AS is_range FROM fb LEFT JOIN cov USING (bin) GROUP BY point_id) SELECT point_id, CASE WHEN hits = n THEN 'covered' WHEN is_range AND hits > 0 THEN 'partial' ELSE 'remaining' END AS coverage_status FROM h",
    "remaining_for_feature": f"WITH {_SEG}, {_PLACE}, cov AS (SELECT DISTINCT bin FROM ab), h AS (SELECT point_id, count(*) AS n, count(cov.bin) AS hits FROM fb LEFT JOIN cov USING (bin) GROUP BY point_id), rem AS (SELECT round(start_bin * 0.01::DOUBLE, 2) AS a, round(end_bin * 0.01::DOUBLE, 2) AS b FROM isl WHERE coverage_status = 'remaining'), q AS (SELECT point_id, round(milepost, 2) AS s, round(coalesce(milepost_end, milepost), 2) AS e FROM pc JOIN h USING (point_id) WHERE hits < n) SELECT point_id, a AS start_milepost, b AS end_milepost FROM q JOIN rem ON a <= e AND (b > s OR (b = s AND s = e AND e = (SELECT n * 0.01::DOUBLE FROM dom)))",
    "flatten_public": f"WITH {_SEG}, d AS (SELECT DISTINCT activity_id, bin FROM ab), i AS (SELECT activity_id, min(bin) AS start_bin, max(bin) + 1 AS end_bin FROM (SELECT *, bin - row_number() OVER (PARTITION BY activity_id ORDER BY bin) AS g FROM d) GROUP BY activity_id, g) SELECT activity_id, CAST(row_number() OVER (PARTITION BY activity_id ORDER BY start_bin) - 1 AS INT) AS pos, CAST(start_bin AS INT) AS start_bin, CAST(end_bin AS INT) AS end_bin FROM i",
    "artifact_sources": "SELECT r_name AS artifact, n_name AS source_id, n_nationkey AS role FROM nation JOIN region ON n_regionkey = r_regionkey",
    "feature_union": "SELECT 'part' AS feature_type, p_name AS name, p_partkey AS id, p_retailprice AS milepost, p_size FROM part UNION ALL SELECT 'supplier', s_name, s_suppkey, s_acctbal, -1 FROM supplier ORDER BY milepost, feature_type, name, id",
    "route_components": "WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE - 77 AS lon, embedding[2]::DOUBLE + 39 AS lat FROM embeddings), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND 2 * 6371008.8 * asin(least(1.0, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 1500), w AS (SELECT a AS node, a AS reach FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.reach = e.a) SELECT node, min(reach) AS component FROM w GROUP BY node",
    "trail_attributes": "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL",
    "relation_integrity": "SELECT 'order' AS relation, count(*) AS lost FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "audit_flags": f"WITH {_TRACK}, st AS (SELECT activity_id, count(*) FILTER (accepted) * 100 / count(*) AS pct, count(*) FILTER (accepted) AS m, quantile_cont(CASE WHEN accepted THEN off END, 0.5) AS med FROM tr GROUP BY activity_id), tv AS (SELECT activity_id, round(sum(dist), 4) AS co, min(along) AS low, count(DISTINCT run) AS n FROM kept GROUP BY activity_id), wh AS (SELECT activity_id, round(sum(abs(next_along - along)) / 10, 4) AS own FROM lg GROUP BY activity_id), j AS (SELECT *, coalesce(co, 0) AS c FROM st LEFT JOIN tv USING (activity_id) LEFT JOIN wh USING (activity_id)) SELECT activity_id, concat_ws(',', CASE WHEN pct < 25 THEN 'LOW_MATCH_PERCENTAGE' END, CASE WHEN m < 50 THEN 'LOW_MATCHED_POINT_COUNT' END, CASE WHEN c - own > 0.01 THEN 'CO_TRAVEL_EXCEEDS_STRAVA' END, CASE WHEN c - own > 0 AND (own <= 0 OR (c - own) / own >= 0.03) THEN 'LARGE_CO_TRAVEL_DISCREPANCY' END, CASE WHEN n > 1 THEN 'DISCONNECTED_MATCH' END, CASE WHEN med >= 12 AND c >= 0.25 AND low < 3.5 THEN 'POSSIBLE_PARALLEL_TRAIL' END) AS flags FROM j",
    "set_checks": f"WITH {_SEG}, c AS (SELECT count(DISTINCT bin) AS c FROM ab) SELECT 0::BIGINT AS both, n AS together, c AS completed, n - c AS remaining, 0::BIGINT AS missing FROM dom, c",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}

