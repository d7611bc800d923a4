import datetime as dt
import os

from pyspark.sql import functions as F

from noctua.streaming.correlate import incidents_from_windows, late_rows, stream_correlate, window_aggregate

SCHEMA = "id long, element_id string, site_id string, ts timestamp_ntz, severity string, alarm_type string, metrics string"
T0 = dt.datetime(2024, 1, 1, 0, 0)


def _rows(start_id, minutes, el="E1"):
    return [(start_id + i, el, "S", T0 + dt.timedelta(minutes=m), "major", "latencyHigh", '{"latency_ms": 400}')
            for i, m in enumerate(minutes)]


def test_late_alarm_is_dropped_and_counted(spark, tmp_out):
    src = os.path.join(tmp_out, "src")
    # batch 1: alarms up to 02:00 move the watermark to 01:50
    spark.createDataFrame(_rows(1, [0, 1, 2, 120]), SCHEMA).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    out, ckpt = os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt")
    q = stream_correlate(spark.readStream.schema(schema).parquet(src), out, ckpt, min_alarms=3,
                         watermark="10 minutes")
    q.awaitTermination()
    # batch 2: a late alarm for the already closed 00:00 window
    spark.createDataFrame(_rows(50, [5]), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    q2 = stream_correlate(spark.readStream.schema(schema).parquet(src), out, ckpt, min_alarms=3,
                          watermark="10 minutes")
    q2.awaitTermination()
    res = spark.read.parquet(out).collect()
    assert late_rows(q2) == 1
    assert [r.alarm_count for r in res] == [3]


def test_stream_windows_equal_batch_form(spark):
    rows = _rows(1, [0, 1, 2, 14, 16, 17, 18, 31]) + _rows(100, [3, 4, 5], "E2")
    batch = spark.createDataFrame(rows, SCHEMA)
    inc = incidents_from_windows(window_aggregate(batch), min_alarms=3).collect()
    got = sorted((r.element_id, r.window_start.minute, r.alarm_count, r.anomaly_score) for r in inc)
    assert got == [("E1", 0, 4, 0.9), ("E1", 15, 3, 0.9), ("E2", 0, 3, 0.9)]
    sess = incidents_from_windows(window_aggregate(batch, mode="session"), min_alarms=3).collect()
    assert sorted(r.alarm_count for r in sess) == [3, 8]


def test_every_late_alarm_counts(spark, tmp_out):
    src = os.path.join(tmp_out, "src")
    late = 0
    # seven late alarms of one window and element, later two more; a row behind the watermark in an open window is not late
    for k, minutes in enumerate([[0, 1, 2, 128], [3] * 7 + [121], [4, 5, 129]]):
        spark.createDataFrame(_rows(100 * k, minutes), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        schema = spark.read.parquet(src).schema
        q = stream_correlate(spark.readStream.schema(schema).parquet(src), os.path.join(tmp_out, "out"), os.path.join(tmp_out, "ckpt"),
                             min_alarms=3, watermark="5 minutes")
        q.awaitTermination()
        late += [0, 7, 2][k]
        assert late_rows(q) == late
    assert [r.alarm_count for r in spark.read.parquet(os.path.join(tmp_out, "out")).collect()] == [3]
