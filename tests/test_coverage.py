"""Bins, history, matching, features and invariants on hand-computed rows."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.config import LineConfig
from lineweave.functions import geo, names
from lineweave.operators import bins as B
from lineweave.operators import features as feat
from lineweave.operators import graph, history, match
from lineweave.plans.audit import audit_flags
from lineweave.plans.invariants import InvariantError, gate, history_violations

T0 = datetime(2020, 1, 1)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_islands_and_complement(spark):
    df = spark.createDataFrame([(b,) for b in (0, 1, 2, 5, 2)], "bin int")
    got = [tuple(r) for r in B.as_segments(B.islands(df)).orderBy("start_milepost").collect()]
    assert got == [(0.0, 0.03, 0.03), (0.05, 0.06, 0.01)]
    assert B.islands(df.filter("bin < 0")).count() == 0
    last = spark.createDataFrame([(18449,)], "bin int")
    assert tuple(B.as_segments(B.islands(last)).first()) == (184.49, 184.5, 0.01)
    assert sorted(r.bin for r in B.complement(df, 7).collect()) == [3, 4, 6]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 60)))
def test_bins_segments_bins(spark, chosen):
    df = spark.createDataFrame([(b,) for b in chosen], "bin int")
    runs = B.islands(df)
    back = {r.bin for r in B.explode_segments(runs.select("start_bin", "end_bin"), "start_bin", "end_bin").collect()}
    assert back == chosen
    ends = sorted((r.start_bin, r.end_bin) for r in runs.collect())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_three_binning_rules(spark):
    leg = lambda a, b: one(spark, B.leg_bins(F.lit(a), F.lit(b)))[0]
    assert leg(0.0, 0.02) == [0, 1, 2] and leg(0.02, 0.0) == [0, 1, 2]
    assert leg(184.495, 184.5) == [18449]
    assert one(spark, F.floor(F.lit(0.29) / 0.01))[0] == 28 and one(spark, B.decimal_bin(F.lit(0.29)))[0] == 29
    assert one(spark, B.feature_bins(F.lit(0.1), F.lit(0.12)))[0] == [10, 11, 12]
    assert one(spark, B.feature_bins(F.lit(184.5), F.lit(None)))[0] == [18449]
    assert one(spark, B.edge_bin(F.lit(1.17)), B.on_edge(F.lit(1.17)), B.on_edge(F.lit(1.175))) == (117, True, False)


def test_history_and_order(spark):
    t = [T0, T0 + timedelta(1), T0 + timedelta(2)]
    data = [(1, t[0], 0), (1, t[0], 1), (2, t[1], 1), (2, t[1], 2), (3, t[2], 0), (3, t[2], 0)]
    df = spark.createDataFrame(data, "activity_id long, ts timestamp, bin int")
    h = history.coverage_history(df)
    assert [(r.new_bins, r.cumulative_bins) for r in h.orderBy("ts").collect()] == [(2, 2), (1, 3), (0, 3)]
    assert {r.rule: r.violations for r in history_violations(h, df, 3).collect()} == dict.fromkeys(("new_not_negative", "new_at_most_unique", "cumulative_never_falls", "final_is_union", "sum_of_new_is_union", "within_line", "chronological"), 0)
    assert {r.rule: r.violations for r in history_violations(h.withColumn("new_bins", F.lit(9)), df, 2).collect()}["within_line"] == 1
    with pytest.raises(InvariantError):
        gate({"a": 0, "b": 2})


def test_tie_rules(spark):
    df = spark.createDataFrame([(9, T0, "run", 0), (10, T0, "bike", 0)], "activity_id long, ts timestamp, mode string, bin int")
    assert history.first_touch(df).first().first.id == 9  # by number
    fb = spark.createDataFrame([("x", False, 0), ("y", False, 7)], "k string, is_range boolean, bin int")
    got = {r.k: r for r in feat.covering_activities(fb, df, "k").collect()}
    assert (got["x"].first_id, got["x"].last_id, got["x"].covering_count, got["x"].covering_run) == (10, 9, 2, 1)  # by text
    assert (got["y"].covering_count, got["y"].first_id) == (0, None)


def test_features_bins_are_not_broadcast(spark):
    features = spark.range(1).selectExpr("id AS k", "0D AS milepost", "900D AS milepost_end")  # Spark knows its size
    df = spark.createDataFrame([(9, T0, "run", 5), (9, T0, "run", 89_999), (10, T0, "bike", 7)], "activity_id long, ts timestamp, mode string, bin int")
    out = feat.covering_activities(feat.exploded_feature_bins(features, "k", LineConfig(line_miles=1000.0, bin_count=100_000)), df, "k")
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join [bin" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert (out.first().covering_count, out.first().covering_run) == (2, 1)


def legs_of(spark, rows):
    df = spark.createDataFrame([(1, i, t, float(x), 0.0, float(a), ok) for i, (t, x, a, ok) in enumerate(rows)], "activity_id long, seq int, ts timestamp, x double, y double, along double, accepted boolean")
    return match.legs(df)


@pytest.mark.parametrize(
    "left,right,expected",
    [
        ((T0, 0, 0, True), (T0 + timedelta(seconds=181), 10, 10, True), False),
        ((T0, 0, 0, True), (T0 - timedelta(seconds=1), 10, 10, True), False),
        ((T0, 0, 0, True), (None, 10, 10, True), True),
        ((T0, 0, 0, True), (T0, 5, 3.25, True), True),
        ((T0, 0, 0, True), (T0, 5, 3.2, True), False),
        ((T0, 0, 0, True), (T0, 4.9, 0, True), True),
        ((T0, 0, 0, True), (T0, 501, 400, True), False),
        ((T0, 0, 0, True), (T0, 450, 401, True), False),
        ((T0, 0, 0, True), (T0, 10, 10, False), False),
    ],
)
def test_leg(spark, left, right, expected):
    rows = legs_of(spark, [left, right]).orderBy("seq").collect()
    assert [r.plausible for r in rows] == [expected, None]


def test_runs_kept(spark):
    kept = lambda xs: {r.kept for r in match.runs(legs_of(spark, [(T0, x, x, True) for x in xs])).collect()}
    assert kept([0, 40]) == {False}  # two points
    assert kept([0, 16, 31.9]) == {False} and kept([0, 16, 32.0]) == {True}


def test_nearest_segment(spark):
    line = match.line_segments(spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 0.0), (2, 100.0, 1000.0)], "seq int, x double, y double"))
    pts = spark.createDataFrame([(1, 50.0, 30.0), (2, 50.0, 30.01), (3, 100.0, 0.0), (4, 110.0, 555.0), (5, 1e6, 0.0)], "id int, x double, y double")
    got = {r.id: r for r in match.nearest_segment(pts, line, 30.0, ("id",), 2).collect()}
    assert (got[1].idx, got[1].offset, got[1].along) == (0, 30.0, 50.0)
    assert got[2].idx is None and got[5].idx is None
    assert got[3].idx == 0 and (got[4].idx, round(got[4].along, 6)) == (1, 655.0)
    assert {r.id: r.idx for r in match.nearest_segment(pts, line, 30.0, ("id",)).collect()} == {k: v.idx for k, v in got.items()}


def test_names(spark):
    def m(a, b):
        return one(spark, names.names_match(names.normalized_name(F.lit(a)), names.normalized_name(F.lit(b))))[0]

    assert m("Lock 7", "Lock 7 (Glen Echo)") and m("Lock 1", "Lock 10")
    assert not m("Foo Bridge", "Foo Lock") and m("Great Falls Park", "Falls of Great Park")
    assert one(spark, names.normalized_name(F.lit("Fletcher’s  Cove No. 5")))[0] == "fletchers cove 5"
    assert one(spark, names.slug(F.lit("C&O Café")), names.slug(F.lit("straße")), names.number_slug(F.lit(-0.5))) == ("c-o-cafe", "strae", "minus-0-5")
    assert one(spark, names.lock_number(F.lit("near lock 63 1/3 gate")), names.lock_number(F.lit("Dam 4"))) == ("63 1/3", None)
    flags = {k: F.lit(k == "camping") for k in names.AMENITIES}
    kind = lambda n: one(spark, names.feature_type(F.lit(n), flags))[0]
    assert [kind(n) for n in ("Lockhouse 5", "Lock 5", "Dam 2", "Damage", "Fort Duncan")] == ["lockhouse", "lock", "dam", "campground", "campground"]


def test_distance_status_remaining(spark):
    d = lambda s, e, at: float(one(spark, feat.milepost_distance(F.lit(s), F.lit(e).cast("double"), F.lit(at)))[0])
    assert d(0.0, 1.1, 1.2) == 0.1 and d(0.0, 1.1, 0.4) == 0 and d(3.0, None, 2.5) == 0.5
    fb = spark.createDataFrame([("r", True, 0), ("r", True, 1), ("p", False, 5), ("q", False, 1)], "k string, is_range boolean, bin int")
    cov = spark.createDataFrame([(1,)], "bin int")
    assert {r.k: r.coverage_status for r in feat.status(fb, cov, "k").collect()} == {"r": "partial", "p": "remaining", "q": "covered"}
    o = lambda s, e, a, b: one(spark, feat.remaining_overlap(F.lit(s), F.lit(e).cast("double"), F.lit(a), F.lit(b)))[0]
    assert o(1.0, 2.0, 2.0, 3.0) and not o(1.0, 2.0, 0.5, 1.0) and o(184.5, None, 184.0, 184.5)


def test_band_join_is_complete(spark):
    a = spark.createDataFrame([(i, i * 0.37, None) for i in range(30)] + [(99, 2.0, 5.5)], "i int, s double, e double")
    b = spark.createDataFrame([(i, i * 0.41) for i in range(30)], "j int, at double")
    got = {(r.i, r.j) for r in feat.band_join(a, b, "s", "e", "at", "0.35").collect()}
    want = set()
    for i, s, e in [(i, round(i * 0.37, 6), round(i * 0.37, 6)) for i in range(30)] + [(99, 2.0, 5.5)]:
        want |= {(i, j) for j in range(30) if max(s - j * 0.41, j * 0.41 - e, 0) <= 0.35 + 1e-9}
    assert got == want


def test_public_ids(spark):
    df = spark.createDataFrame([("A", 1.0, None, 1.0, 2.0), ("B", 1.0, 2.5, 1.0, 2.0), ("B", 1.0, 2.5, 1.0, -2.0), ("C", 3.0, None, 1.0, 1.0), ("C", 3.0, None, 1.0, 1.0)], "name string, milepost double, milepost_end double, latitude double, longitude double")
    ids = [r.id for r in feat.public_ids(df, F.col("name")).collect()]
    assert "a-1-0" in ids and "b-1-0-2-5-lat-1-0-lon-minus-2-0" in ids and sum(i.startswith("c-3-0-lat-1-0-lon-1-0-") for i in ids) == 2


def test_albers_and_geodesic(spark):
    x, y = one(spark, *geo.albers(F.lit(-96.0), F.lit(23.0)))
    assert abs(x) < 1e-6 and abs(y) < 1e-3
    # along the central meridian's standard parallel, a short step keeps its length
    (x1, y1), (x2, y2) = (one(spark, *geo.albers(F.lit(lon), F.lit(29.5))) for lon in (-96.0, -95.99))
    assert abs(((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 - geo.vincenty(-96.0, 29.5, -95.99, 29.5)) < 0.01
    assert abs(geo.vincenty(-77.0567, 38.9041, -77.0567, 38.9041)) == 0
    assert abs(geo.vincenty(0, 0, 0, 1) - 110574.39) < 0.01


def test_audit(spark):
    cols = "match_percentage double, matched_point_count int, co_travel_miles double, distance_miles double, n_segments int, median_offset double, co_unique_miles double, in_review boolean"
    rows = [(10.0, 10, 2.0, 1.0, 2, 13.0, 0.5, True), (90.0, 90, 1.0, None, 1, None, 1.0, True), (90.0, 90, 1.0, 0.0, 1, 1.0, 1.0, False)]
    got = [r.f for r in spark.createDataFrame(rows, cols).select(audit_flags().alias("f")).collect()]
    assert got == [["LOW_MATCH_PERCENTAGE", "LOW_MATCHED_POINT_COUNT", "CO_TRAVEL_EXCEEDS_STRAVA", "LARGE_CO_TRAVEL_DISCREPANCY", "DISCONNECTED_MATCH", "POSSIBLE_PARALLEL_TRAIL"], [], ["CO_TRAVEL_EXCEEDS_STRAVA", "LARGE_CO_TRAVEL_DISCREPANCY"]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (52, 51)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[50], got[51], got[52]} == {50}


DEG = 1 / 111_195  # about a metre of latitude


def chain(start, n, step=0.001):
    return [[(-77.0, start + i * step), (-77.0, start + (i + 1) * step)] for i in range(n)]


def edge_rows(spark, edges):
    return spark.createDataFrame(list(enumerate(edges)), "edge int, coordinates array<array<double>>")


def test_route_of_chains(spark):
    anchors = ((-77.0, 39.0), (-77.0, 39.02))
    near = chain(39.0, 10) + [line[::-1] for line in chain(39.01 + 40 * DEG, 10)]
    line = graph.assemble(edge_rows(spark, [*near, [(-77.0, 39.005), (-76.9, 39.005)]]), anchors)  # and a side way
    assert line[0] == (-77.0, 39.0) and len(line) == 22 and line == sorted(line)
    with pytest.raises(graph.LineError):
        graph.assemble(edge_rows(spark, chain(39.0, 10) + chain(39.01 + 60 * DEG, 10)), anchors)
    with pytest.raises(graph.LineError):
        graph.assemble(edge_rows(spark, [[(0.0, 0.0), (0.0, 1.0)], [(0.0, 1.0), (1.0, 1.0)], [(1.0, 1.0), (0.0, 0.0)]]), ((0.0, 0.0), (0.0, 1.0)))


def test_source_edges(spark):
    lines = [(0, [[[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]]]), (1, [[[1.0, 1.0], [0.0, 0.0]], [[2.0, 2.0], [3.0, 3.0]]])]
    df = spark.createDataFrame(lines, "feature_order int, lines array<array<array<double>>>")
    assert sorted(r.coordinates for r in graph.source_edges(df).collect()) == [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]
