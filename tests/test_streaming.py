from datetime import datetime

from lineweave.streaming.first_touch import event_bins, merge_first_touch

T = [datetime(2020, 1, 1, h) for h in range(4)]


def test_merge_is_idempotent(spark):
    schema = "bin int, ts timestamp, activity_id long"
    touched = spark.createDataFrame([(1, T[1], 5), (2, T[0], 7)], schema)
    batch = spark.createDataFrame([(1, T[0], 9), (2, T[0], 8), (3, T[2], 1), (3, T[2], 1)], schema)
    once = merge_first_touch(batch, touched)
    want = [(1, T[0], 9), (2, T[0], 7), (3, T[2], 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge_first_touch(batch, once).collect())) == want


def test_stream_of_bins(spark, tmp_path):
    rows = [(T[0], "run", 1), (T[0], "run", 1), (T[0], "run", 2), (T[1], "bike", 3), (T[3], "run", 1)]
    spark.createDataFrame(rows, "ts timestamp, mode string, bin int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, mode string, bin int").parquet(str(tmp_path / "in"))
    query = event_bins(stream, "10 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("bins_by_hour").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.window.start.hour, r.mode, r.bins) for r in spark.table("bins_by_hour").collect())
    assert got == [(0, "run", 2), (1, "bike", 1), (3, "run", 1)]
