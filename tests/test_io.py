import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from noctua.operators.lifecycle import expire_partitions
from noctua.sources import tables as T
from noctua.sources.quality import ALARMS_CONTRACT, split_valid, validate
from noctua.sources.store import Conflict, Store, day


def test_upsert_changes_only_listed_columns(spark):
    tgt = spark.createDataFrame([("r1", 1, "major", 0.1), ("r2", 2, "minor", 0.2)],
                                "incident_ref string, alarm_count int, severity string, anomaly_score double")
    src = spark.createDataFrame([("r1", 10, "critical", 0.9), ("r3", 3, "warning", 0.3)],
                                "incident_ref string, alarm_count int, severity string, anomaly_score double")
    out = {r.incident_ref: r for r in T.upsert(tgt, src, ["incident_ref"], ["alarm_count", "anomaly_score"]).collect()}
    assert (out["r1"].alarm_count, out["r1"].severity, out["r1"].anomaly_score) == (10, "major", 0.9)
    assert out["r2"].alarm_count == 2 and out["r3"].severity == "warning"


def test_upsert_rejects_repeated_source_key(spark):
    tgt = spark.createDataFrame([("r1", 1)], "k string, v int")
    src = spark.createDataFrame([("r1", 2), ("r1", 3)], "k string, v int")
    with pytest.raises(Exception, match="repeats key"):
        T.upsert(tgt, src, ["k"], ["v"]).collect()


def test_update_columns_and_snapshots(spark, tmp_out):
    tgt = spark.createDataFrame([(1, "open"), (2, "open")], "id long, status string")
    ch = spark.createDataFrame([(2, "resolved")], "id long, status string")
    nxt = T.update_columns(tgt, ch, ["id"], ["status"])
    base = os.path.join(tmp_out, "incidents")
    T.write_snapshot(tgt, base, 1)
    T.write_snapshot(nxt, base, 2)
    got = {r.id: r.status for r in T.read_latest(spark, base).collect()}
    assert got == {1: "open", 2: "resolved"}


def test_append_and_read_table(spark, tmp_out):
    p = os.path.join(tmp_out, "alarms")
    df = spark.createDataFrame([(1, "E1", dt.datetime(2024, 1, 1), '{"prb_util": 0.9}')],
                               "id long, element_id string, ts timestamp_ntz, metrics string")
    T.append(df, p)
    T.append(df.withColumn("id", F.lit(2).cast("long")), p)
    back = T.read_table(spark, p, "id long, element_id string, ts timestamp_ntz, metrics string")
    assert sorted(r.id for r in back.collect()) == [1, 2]


def test_labelled_round_trip_and_report(spark, tmp_out):
    src = os.path.join(tmp_out, "items.json")
    with open(src, "w") as f:
        json.dump([{"ticket_id": "t1", "text": "a", "true_subcat": "L1"}, {"text": "b", "true_subcat": "L2"}], f)
    items = T.load_labelled(spark, src)
    assert {(r.ticket_id, r.true_subcat) for r in items.collect()} == {("t1", "L1"), (None, "L2")}
    T.save_labelled(items, os.path.join(tmp_out, "saved"))
    T.write_report(items, os.path.join(tmp_out, "report"))
    assert spark.read.json(os.path.join(tmp_out, "saved")).count() == 2


def test_validate_reasons(spark):
    df = spark.createDataFrame([
        (1, "E", dt.datetime(2024, 1, 1), "major", "x", None),
        (2, None, dt.datetime(2024, 1, 1), "major", "x", None),
        (3, "E", dt.datetime(2024, 1, 1), "fatal", "x", None),
        (4, "E", dt.datetime(2024, 1, 1), "major", "x", "not json"),
        (4, "E", dt.datetime(2024, 1, 1), "major", "x", None),
    ], "id long, element_id string, ts timestamp_ntz, severity string, alarm_type string, metrics string")
    checked = validate(df, ALARMS_CONTRACT)
    reasons = sorted((r.id, r.reason) for r in checked.collect() if r.reason)
    assert reasons == [(2, "null:element_id"), (3, "enum:severity"), (4, "duplicate:id"), (4, "json:metrics")]
    good, bad = split_valid(checked)
    assert good.count() == 1 and bad.count() == 4


def test_append_alarms_stores_kpi_map_as_json(spark, tmp_out):
    p = os.path.join(tmp_out, "alarms_json")
    df = spark.createDataFrame([(1, {"prb_util": 0.97, "latency_ms": 210.0})], "id long, metrics map<string,double>")
    T.append_alarms(df, p)
    back = spark.read.parquet(p).collect()[0]
    assert json.loads(back.metrics) == {"prb_util": 0.97, "latency_ms": 210.0}


def test_half_written_version_is_not_read(spark, tmp_out):
    base = os.path.join(tmp_out, "t")
    assert T.read_latest(spark, base) is None and T.read_batches(spark, base) is None
    T.write_snapshot(spark.range(100), base, 1)
    store = Store(spark, base)
    store._written(spark.range(50), None)                  # a run that died before its manifest
    spark.createDataFrame([(None, "/nowhere")], "part string, folder string").write.parquet(f"{base}/manifests/x")       # and one before its commit
    assert T.read_latest(spark, base).count() == 100
    T.write_snapshot(spark.range(70), base, 2)
    assert T.read_latest(spark, base).count() == 70 and T.read_latest(spark, base, below=2).count() == 100
    T.write_snapshot(spark.range(5), base, 2)              # a replay leaves the finished version alone
    assert T.read_latest(spark, base).count() == 70


def dated(spark, days):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, d) if d else None, "a") for i, d in enumerate(days)], "id long, ts timestamp_ntz, v string")


def folders(store):
    return {r.part: r.folder for r in store._manifest(store.head()).collect()}


def test_only_touched_dates_are_rewritten_and_expiry_drops_partitions(spark, tmp_out):
    store = Store(spark, os.path.join(tmp_out, "alarms"))
    assert store.append(dated(spark, [1, 1, 2, 3, None]), "ingest", 1, by=day("ts"))
    before = folders(store)
    new = spark.createDataFrame([(2, dt.datetime(2024, 1, 2), "b"), (9, dt.datetime(2024, 1, 4), "c")], "id long, ts timestamp_ntz, v string")
    assert T.upsert_into(store, new, ["id"], ["v"], "ts", "fix", 1)
    after = folders(store)
    assert {p for p in before if before[p] == after[p]} == {"2024-01-01", "2024-01-03", "none"} and set(after) == set(before) | {"2024-01-04"}
    assert {r.id: r.v for r in store.read().collect()} == {0: "a", 1: "a", 2: "b", 3: "a", 4: "a", 9: "c"}
    assert {r.id for r in store.read(where=F.col("part") == "2024-01-01").collect()} == {0, 1}
    assert {r.part for r in expire_partitions(store, "2024-01-05 12:00:00", 2).collect()} == {"2024-01-01", "2024-01-02"}
    assert {r.id for r in store.read().collect()} == {3, 4, 9}
    assert {r.id for r in store.read(writer="fix").collect()} == {0, 1, 2, 3, 4, 9}     # the older version stays readable


def test_writers_with_equal_batches_do_not_meet(spark, tmp_out):
    base = os.path.join(tmp_out, "log")
    for _ in range(2):                                     # each batch, and its replay
        T.append_batch(spark.range(3).select("id", F.lit(1).alias("x")), base, 1, "one")
        T.append_batch(spark.range(4), base, 1, "two")
    T.append_batch(spark.range(0), base, 2, "one")
    got = T.read_batches(spark, base).groupBy("writer", "batch_version").agg(F.count("x").alias("x"), F.count("*").alias("n")).collect()
    assert {(r.writer, r.batch_version): (r.n, r.x) for r in got} == {("one", 1): (3, 3), ("two", 1): (4, 0)}


def test_second_commit_on_a_version_raises(spark, tmp_out):
    store = Store(spark, os.path.join(tmp_out, "race"))
    store.append(spark.range(1), "a", 1)
    stale = store.head()
    rows = store._manifest(stale)
    outcomes = []
    for writer in ("b", "c", "d"):                         # all on the version of "a"
        try:
            store._commit(stale, rows, spark.range(1).schema, writer, 1)
            outcomes.append(writer)
        except Conflict:
            pass
    assert "b" in outcomes and store.head()["seq"] == 2
    assert sum(store.done(w, 1) for w in "bcd") == 1


def test_commits_start_no_python_worker(spark, tmp_out, monkeypatch):
    from noctua.sources.store import Store
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, d string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("local rows"))
    store = Store(spark, f"{tmp_out}/t")
    assert store.append(rows, "w", 1, by=F.col("d")) and store.append(rows, "w", 2) and not store.append(rows, "w", 2)
    assert store.drop(F.col("part") < "2024-01-02", "r", 1)
    assert sorted(r["id"] for r in store.read().collect()) == [1, 2, 2]
