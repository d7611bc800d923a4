import datetime as dt

from pyspark.sql import functions as F

from noctua.config import DEFAULT_TUNING
from noctua.operators import alarms as A
from noctua.operators.anomaly import score_anomaly

T0 = dt.datetime(2024, 1, 1, 12, 0)
SCHEMA = "id long, element_id string, site_id string, ts timestamp_ntz, severity string, alarm_type string, metrics string"


def _alarms(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _a(i, el, site, minutes, sev="major", typ="prbUtilHigh", metrics=None):
    return (i, el, site, T0 + dt.timedelta(minutes=minutes), sev, typ, metrics)


def test_largest_group_wins_and_count_is_element_total(spark):
    rows = [_a(i, "E1", "S-A", i) for i in range(1, 4)] + [_a(10 + i, "E1", "S-B", 30 + i) for i in range(2)]
    t = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3, lookback_hours=6)
    inc = t.incidents.collect()
    assert len(inc) == 1
    r = inc[0]
    assert r.site_id == "S-A" and r.alarm_count == 5
    assert r.window_start == T0 + dt.timedelta(minutes=1) and r.window_end == T0 + dt.timedelta(minutes=3)
    assert r.incident_ref == "INC-E1-202401011201"
    marked = {x.id: x.correlated_incident for x in t.marked_alarms.collect()}
    assert set(marked.values()) == {"INC-E1-202401011201"}


def test_total_reaching_min_without_a_group_yields_nothing(spark):
    rows = [_a(1, "E2", "S-A", 1), _a(2, "E2", "S-A", 2), _a(3, "E2", "S-B", 3), _a(4, "E2", None, 4)]
    t = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3)
    assert t.incidents.count() == 0


def test_null_site_is_its_own_group(spark):
    rows = [_a(i, "E3", None, i) for i in range(3)]
    inc = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3).incidents.collect()
    assert len(inc) == 1 and inc[0].site_id is None


def test_info_and_clear_read_as_warning_and_dominant_tie_goes_to_first_seen(spark):
    rows = [_a(1, "E4", "S", 5, "info", "tempHigh"), _a(2, "E4", "S", 1, "clear", "vswrAlarm"),
            _a(3, "E4", "S", 6, "clear", "tempHigh"), _a(4, "E4", "S", 2, "info", "vswrAlarm")]
    r = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3).incidents.collect()[0]
    assert r.severity == "warning"
    assert r.dominant_type == "vswrAlarm" and r.subcategory == "Hardware-Card-Fault" and r.category == "hardware"


def test_unlisted_type_maps_to_default_subcategory(spark):
    rows = [_a(i, "E5", "S", i, "minor", "somethingElse") for i in range(3)]
    r = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3).incidents.collect()[0]
    assert r.subcategory == "RAN-PRB-Congestion" and r.category == "ran"


def test_lookback_lower_bound_inclusive(spark):
    as_of = T0 + dt.timedelta(hours=6, minutes=1)
    rows = [_a(1, "E6", "S", 1), _a(2, "E6", "S", 2), _a(3, "E6", "S", 0)]  # minute 0 is outside
    assert A.correlate_alarms(_alarms(spark, rows), as_of, min_alarms=3).incidents.count() == 0
    as_of = T0 + dt.timedelta(hours=6)
    assert A.correlate_alarms(_alarms(spark, rows), as_of, min_alarms=3).incidents.count() == 1


def _score(spark, pairs, tuning=DEFAULT_TUNING):
    worst = spark.createDataFrame([("E", m, float(v)) for m, v in pairs], "element_id string, metric string, worst double")
    return score_anomaly(worst, "element_id", tuning).collect()[0]


def test_value_at_threshold_is_not_kept(spark):
    r = _score(spark, [("latency_ms", 100.0)])
    assert r.anomaly_score == 0.0 and r.anomaly_breakdown == {}


def test_scores_are_weighted_and_max_of_rounded(spark):
    r = _score(spark, [("latency_ms", 400.0), ("packet_loss", 0.02)])
    assert r.anomaly_breakdown == {"latency_spike": 0.9, "packet_loss": 0.09}
    assert r.anomaly_score == 0.9


def test_prb_overload_alone_is_small(spark):
    r = _score(spark, [("prb_util", 1.0)])
    assert r.anomaly_score == 0.15


def test_threshold_knob_moves_thresholds(spark):
    r = _score(spark, [("latency_ms", 150.0)], DEFAULT_TUNING.with_(anomaly_threshold_scale=2.0))
    assert r.anomaly_score == 0.0


def test_kpi_json_with_text_value_keeps_other_keys(spark):
    rows = [_a(1, "E7", "S", 1, metrics='{"latency_ms": 400, "note": "n/a"}'),
            _a(2, "E7", "S", 2, metrics='{"temp_c": -5}')]
    w = A.worst_kpi(_alarms(spark, rows))
    got = {(r.metric, r.worst) for r in w.collect()}
    assert ("latency_ms", 400.0) in got and ("temp_c", 0.0) in got
    assert all(m != "note" for m, _ in got)


def test_domain_swap_changes_features_and_taxonomy(spark):
    from noctua.config import Domain
    from noctua.streaming.correlate import incidents_from_windows, window_aggregate
    dom = Domain(features=(("cpu_hot", "cpu", 0.5, 1.0, 0.5),), type_map=(("cpuHigh", "Compute-CPU"),),
                 default_subcategory="Compute-Other")
    rows = [_a(i, "H1", "S", i, "major", "cpuHigh", '{"cpu": 0.75}') for i in range(3)]
    r = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3, domain=dom).incidents.collect()[0]
    assert r.subcategory == "Compute-CPU" and r.category == "compute"
    assert r.anomaly_score == 0.5 and r.anomaly_breakdown == '{"cpu_hot":0.5}'
    s = incidents_from_windows(window_aggregate(_alarms(spark, rows), domain=dom), 3, domain=dom).collect()[0]
    assert s.subcategory == "Compute-CPU" and s.anomaly_score == 0.5


def test_hot_element_matches_plain_computation_and_is_pre_aggregated(spark):
    import random
    rnd = random.Random(3)
    rows, i = [], 0
    for el in ["HOT"] * 300 + [f"E{k}" for k in range(30) for _ in range(20)]:
        i += 1
        typ = rnd.choice(["prbUtilHigh", "sctpReset", "latencyHigh"])
        metric = {"prbUtilHigh": "prb_util", "sctpReset": "sctp_resets", "latencyHigh": "latency_ms"}[typ]
        val = {"prb_util": rnd.uniform(0.5, 1.0), "sctp_resets": rnd.randint(0, 10), "latency_ms": rnd.uniform(0, 400)}[metric]
        rows.append((i, el, rnd.choice(["S1", "S2"]), T0 + dt.timedelta(seconds=rnd.randint(0, 3600)),
                     rnd.choice(["major", "minor", "warning"]), typ, '{"%s": %r}' % (metric, val)))
    df = _alarms(spark, rows)
    t = A.correlate_alarms(df, T0 + dt.timedelta(hours=1), min_alarms=5)
    got = {r.element_id: (r.alarm_count, r.anomaly_score) for r in t.incidents.collect()}
    # plain computation of the totals and scores
    feats = {"prb_util": (0.85, 1.0, 1.0), "sctp_resets": (3.0, 0.8, 20.0), "latency_ms": (100.0, 0.9, 300.0)}
    want = {}
    for el in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == el]
        worst = {}
        for r in mine:
            for m, v in __import__("json").loads(r[6]).items():
                worst[m] = max(worst.get(m, 0.0), float(v))
        subs = []
        for m, v in worst.items():
            thr, w, sc = feats[m]
            if v >= thr:
                raw = min(1.0, max(0.0, (v - thr) / sc)) * w
                if raw > 0:
                    subs.append(round(raw, 3))
        want[el] = (len(mine), round(max(subs), 3) if subs else 0.0)
    assert got == want
    plan = t.incidents._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan


def test_write_triage_writes_all_outputs_from_one_aggregate(spark, tmp_out):
    from noctua.sources.tables import read_latest
    rows = [_a(i, "W1", "S", i) for i in range(4)] + [_a(10, "W2", "S", 1)]
    t = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3)
    paths = A.write_triage(t, tmp_out, 1)
    assert set(paths) == {"incidents", "agent_reasoning", "evidence", "network_alarms"}
    assert read_latest(spark, f"{tmp_out}/incidents").count() == 1
    assert read_latest(spark, f"{tmp_out}/evidence").count() == 4
    marked = {r.id: r.correlated_incident for r in read_latest(spark, f"{tmp_out}/network_alarms").collect()}
    assert marked[10] is None and marked[0] == "INC-W1-202401011200"


def test_two_runs_keep_history_and_a_replay_changes_nothing(spark, tmp_out):
    from noctua.sources.tables import read_batches, read_latest
    first = [_a(i, "W1", "S", i) for i in range(4)]
    second = first + [_a(20 + i, "W2", "S", 300 + i) for i in range(3)]
    run = lambda rows, hours: A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=hours), min_alarms=3)
    A.write_triage(run(first, 1), tmp_out, 1)
    for _ in range(2):                       # the second run, and its replay
        A.write_triage(run(second, 5), tmp_out, 2)
        got = {r.incident_ref: r.alarm_count for r in read_latest(spark, f"{tmp_out}/incidents").collect()}
        assert got == {"INC-W1-202401011200": 4, "INC-W2-202401011700": 3}
        assert read_batches(spark, f"{tmp_out}/evidence").filter("batch_version = 1").count() == 4
        assert read_batches(spark, f"{tmp_out}/agent_reasoning").count() == 3


def test_triage_and_remediation_of_one_version_keep_each_others_rows(spark, tmp_out):
    from noctua.operators.remediate import remediate, write_remediation
    from noctua.sources.tables import read_batches, read_latest
    rows = [_a(i, "W1", "S", i) for i in range(4)] + [_a(10 + i, "W2", "S", i) for i in range(3)]
    t = A.correlate_alarms(_alarms(spark, rows), T0 + dt.timedelta(hours=1), min_alarms=3)
    A.write_triage(t, tmp_out, 1)
    inc = read_latest(spark, f"{tmp_out}/incidents").withColumn("signature_vec", F.array(F.lit(1.0), F.lit(0.0)))
    mem = spark.createDataFrame([], "id long, scope string, category string, content string, confidence double, "
                                    "evidence_count long, status string, superseded_by long, memory_vec array<double>")
    rb = spark.createDataFrame([(7, "reset", "t", "[]", 0.6, 0, 0, "active", None, [1.0, 0.05])],
                               "id long, title string, trigger_condition string, steps string, confidence double, "
                               "success_count long, fail_count long, status string, superseded_by long, runbook_vec array<double>")
    for _ in range(2):                       # and its replay
        write_remediation(remediate(inc, mem, rb), inc, tmp_out, 1, T0)
    log = read_batches(spark, f"{tmp_out}/agent_reasoning").collect()
    assert sorted((r.writer, r.session_id.split("-")[0]) for r in log) == [("remediation", "remediation")] * 2 + [("triage", "triage")] * 2
    now = {r.element_id: (r.status, r.alarm_count) for r in read_latest(spark, f"{tmp_out}/incidents").collect()}
    assert now == {"W1": ("resolved", 4), "W2": ("resolved", 3)}
    assert read_batches(spark, f"{tmp_out}/evidence").count() == 7
