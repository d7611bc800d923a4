"""Alarm jobs over v_alarms: as_of = latest ts, 72 h lookback, min 3 alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alarms as A
from ..operators.anomaly import FEATURE_NAMES, score_anomaly, type_to_subcategory
from ..session import scratch_path
from ..sources.fixtures import view, with_views
from ..sources.tables import read_latest
from .catalog import query

LOOKBACK_H = 72
MIN_ALARMS = 3


def _alarms(spark, sf_dir):
    return view(spark, sf_dir, "v_alarms")


def _window(spark, sf_dir):
    return A.in_window(_alarms(spark, sf_dir), None, LOOKBACK_H)


_W = f"""
WITH a AS (SELECT max(ts) AS as_of FROM v_alarms),
w AS (SELECT v.* FROM v_alarms v, a WHERE v.ts >= a.as_of - INTERVAL {LOOKBACK_H} HOUR),
feat AS (SELECT * FROM (VALUES
  ('prb_overload', 'prb_util', 0.85e0, 1.0e0, 1.0e0), ('latency_spike', 'latency_ms', 100e0, 0.9e0, 300e0),
  ('packet_loss', 'packet_loss', 0.01e0, 0.9e0, 0.1e0), ('sctp_flap', 'sctp_resets', 3e0, 0.8e0, 20e0),
  ('rrc_failrate', 'rrc_fail_rate', 0.05e0, 0.7e0, 0.3e0), ('temp_high', 'temp_c', 55e0, 0.6e0, 30e0),
  ('vswr_high', 'vswr', 1.5e0, 0.7e0, 2.0e0)) AS f(feature, metric, threshold, weight, scale)),
worst AS (SELECT element_id, metric, greatest(0e0, max(value)) AS worst FROM w WHERE metric IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2),
subs AS (SELECT element_id, feature, round(least(1e0, greatest(0e0, (worst - threshold) / scale)) * weight, 3) AS sub
         FROM worst JOIN feat USING (metric)
         WHERE worst >= threshold AND least(1e0, greatest(0e0, (worst - threshold) / scale)) * weight > 0),
scored AS (SELECT e.element_id, coalesce(round(max(s.sub), 3), 0e0) AS anomaly_score,
    max(CASE WHEN feature = 'prb_overload' THEN sub END) AS b_prb_overload,
    max(CASE WHEN feature = 'latency_spike' THEN sub END) AS b_latency_spike,
    max(CASE WHEN feature = 'packet_loss' THEN sub END) AS b_packet_loss,
    max(CASE WHEN feature = 'sctp_flap' THEN sub END) AS b_sctp_flap,
    max(CASE WHEN feature = 'rrc_failrate' THEN sub END) AS b_rrc_failrate,
    max(CASE WHEN feature = 'temp_high' THEN sub END) AS b_temp_high,
    max(CASE WHEN feature = 'vswr_high' THEN sub END) AS b_vswr_high
  FROM (SELECT DISTINCT element_id FROM worst) e LEFT JOIN subs s USING (element_id) GROUP BY 1),
groups AS (SELECT element_id, site_id, count(*) AS alarm_count, min(ts) AS window_start, max(ts) AS window_end
           FROM w GROUP BY 1, 2 HAVING count(*) >= {MIN_ALARMS}),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY alarm_count DESC, site_id ASC NULLS FIRST) AS r
           FROM groups) WHERE r = 1),
hist AS (SELECT element_id, alarm_type, count(*) AS n, min((ts, id)) AS first_seen FROM w GROUP BY 1, 2),
dom AS (SELECT element_id, alarm_type AS dominant_type, n AS dominant_count FROM (SELECT *, row_number() OVER
           (PARTITION BY element_id ORDER BY n DESC, first_seen) AS r FROM hist) WHERE r = 1),
tot AS (SELECT element_id, count(*) AS alarm_count, max(CASE severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3
           WHEN 'minor' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS sev FROM w GROUP BY 1),
inc0 AS (SELECT c.element_id, c.site_id, c.window_start, c.window_end, t.alarm_count,
           CASE t.sev WHEN 4 THEN 'critical' WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'warning' END AS severity,
           CASE d.dominant_type WHEN 'prbUtilHigh' THEN 'RAN-PRB-Congestion' WHEN 'rrcSetupFail' THEN 'RAN-RRC-Failure'
             WHEN 'sctpReset' THEN 'Transport-SCTP-Flap' WHEN 'packetLoss' THEN 'Core-UPF-Packet-Loss'
             WHEN 'tempHigh' THEN 'Environmental-HighTemp' WHEN 'vswrAlarm' THEN 'Hardware-Card-Fault'
             WHEN 'latencyHigh' THEN 'Transport-Microwave-Fade' ELSE 'RAN-PRB-Congestion' END AS subcategory,
           d.dominant_type, coalesce(s.anomaly_score, 0e0) AS anomaly_score
         FROM chosen c JOIN tot t USING (element_id) JOIN dom d USING (element_id) LEFT JOIN scored s USING (element_id)),
inc AS (SELECT 'INC-' || element_id || '-' || strftime(window_start, '%Y%m%d%H%M') AS incident_ref, * FROM inc0)
"""


@query("alarm_groups", with_views(["v_alarms"], _W + "SELECT element_id, site_id, alarm_count, window_start, window_end FROM groups"))
def q_alarm_groups(spark, sf_dir):
    return A.alarm_groups(_window(spark, sf_dir), MIN_ALARMS)


@query("worst_kpi", with_views(["v_alarms"], _W + "SELECT element_id, metric, worst FROM worst"))
def q_worst_kpi(spark, sf_dir):
    return A.worst_kpi(_window(spark, sf_dir))


@query("type_histogram", with_views(["v_alarms"], _W + "SELECT element_id, alarm_type, n FROM hist"))
def q_type_histogram(spark, sf_dir):
    return A.type_histogram(_window(spark, sf_dir)).drop("first_seen")


@query("dominant_type", with_views(["v_alarms"], _W + "SELECT element_id, dominant_type, dominant_count FROM dom"))
def q_dominant_type(spark, sf_dir):
    return A.dominant_type(A.type_histogram(_window(spark, sf_dir)))


@query("anomaly_score", with_views(["v_alarms"], _W + "SELECT * FROM scored"))
def q_anomaly_score(spark, sf_dir):
    s = score_anomaly(A.worst_kpi(_window(spark, sf_dir)))
    return s.select("element_id", "anomaly_score", *[f"b_{f}" for f in FEATURE_NAMES])


@query("type_to_subcategory", with_views(["v_alarms"], """
SELECT alarm_type, count(*) AS n,
       CASE alarm_type WHEN 'prbUtilHigh' THEN 'RAN-PRB-Congestion' WHEN 'rrcSetupFail' THEN 'RAN-RRC-Failure'
         WHEN 'sctpReset' THEN 'Transport-SCTP-Flap' WHEN 'packetLoss' THEN 'Core-UPF-Packet-Loss'
         WHEN 'tempHigh' THEN 'Environmental-HighTemp' WHEN 'vswrAlarm' THEN 'Hardware-Card-Fault'
         WHEN 'latencyHigh' THEN 'Transport-Microwave-Fade' ELSE 'RAN-PRB-Congestion' END AS subcategory
FROM v_alarms GROUP BY alarm_type"""))
def q_type_to_subcategory(spark, sf_dir):
    a = _alarms(spark, sf_dir)
    return (a.groupBy("alarm_type").agg(F.count("*").alias("n"))
            .withColumn("subcategory", type_to_subcategory("alarm_type")))


@query("correlate_alarms", with_views(["v_alarms"], _W + """
SELECT incident_ref, element_id, site_id, window_start, window_end, alarm_count, severity,
       lower(split_part(subcategory, '-', 1)) AS category, subcategory,
       subcategory || ' on ' || element_id || ' (' || cast(alarm_count AS varchar) || ' correlated alarms)' AS title,
       anomaly_score, 'open' AS status
FROM inc"""))
def q_correlate_alarms(spark, sf_dir):
    t = A.correlate_alarms(_alarms(spark, sf_dir), None, MIN_ALARMS, LOOKBACK_H)
    return t.incidents.select("incident_ref", "element_id", "site_id", "window_start", "window_end", "alarm_count",
                              "severity", "category", "subcategory", "title", "anomaly_score", "status")


@query("incident_breakdown", with_views(["v_alarms"], _W + """
SELECT incident_ref, feature, s.sub AS sub_score, anomaly_score FROM inc LEFT JOIN subs s USING (element_id)"""))
def q_incident_breakdown(spark, sf_dir):
    """F2: the breakdown stored with every incident, one row per feature (one without a feature for incidents that score nothing)."""
    t = A.correlate_alarms(_alarms(spark, sf_dir), None, MIN_ALARMS, LOOKBACK_H)
    return t.incidents.select("incident_ref", "anomaly_score", F.explode_outer(F.from_json("anomaly_breakdown", "map<string,double>")).alias("feature", "sub_score"))


@query("mark_alarms", with_views(["v_alarms"], _W + """
SELECT v.id, v.element_id, CASE WHEN v.ts >= a.as_of - INTERVAL 72 HOUR THEN i.incident_ref END AS correlated_incident
FROM v_alarms v CROSS JOIN a LEFT JOIN inc i ON v.element_id = i.element_id"""))
def q_mark_alarms(spark, sf_dir):
    t = A.correlate_alarms(_alarms(spark, sf_dir), None, MIN_ALARMS, LOOKBACK_H)
    return t.marked_alarms.select("id", "element_id", "correlated_incident")


@query("triage_checkpoints", with_views(["v_alarms"], _W + """
SELECT 'triage-' || incident_ref AS session_id, incident_ref, element_id,
       'Likely ' || subcategory || ' (dominant alarm: ' || coalesce(dominant_type, 'None') || ')' AS hypothesis,
       CASE WHEN anomaly_score >= 0.5 THEN 'confirmed' ELSE 'dismissed' END AS resolution,
       least(0.95e0, 0.5e0 + anomaly_score / 2) AS confidence, alarm_count AS evidence_count
FROM inc"""))
def q_triage_checkpoints(spark, sf_dir):
    t = A.correlate_alarms(_alarms(spark, sf_dir), None, MIN_ALARMS, LOOKBACK_H)
    return t.checkpoints.drop("observation")


@query("triage_two_runs", with_views(["v_alarms"], f"""
WITH early AS (SELECT * FROM v_alarms WHERE ts <= (SELECT max(ts) - INTERVAL 24 HOUR FROM v_alarms)),
i1 AS ({_W.replace('v_alarms', 'early')} SELECT * FROM inc),
i2 AS ({_W} SELECT * FROM inc)
SELECT incident_ref, coalesce(i1.element_id, i2.element_id) AS element_id, coalesce(i1.severity, i2.severity) AS severity,
       coalesce(i1.window_start, i2.window_start) AS window_start, coalesce(i2.alarm_count, i1.alarm_count) AS alarm_count,
       coalesce(i2.anomaly_score, i1.anomaly_score) AS anomaly_score
FROM i1 FULL JOIN i2 USING (incident_ref)"""))
def q_triage_two_runs(spark, sf_dir):
    """The incident table after two triage runs a day apart: the first run's
    incidents stay, a known incident changes only its count, score and breakdown."""
    alarms = _alarms(spark, sf_dir)
    cut = alarms.select((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("t")).first()["t"]
    base = scratch_path(spark, "triage-two-runs")
    A.write_triage(A.correlate_alarms(alarms.filter(F.col("ts") <= F.lit(cut)), None, MIN_ALARMS, LOOKBACK_H), base, 1)
    A.write_triage(A.correlate_alarms(alarms, None, MIN_ALARMS, LOOKBACK_H), base, 2)
    return read_latest(spark, f"{base}/incidents").select("incident_ref", "element_id", "severity", "window_start", "alarm_count", "anomaly_score")


@query("triage_marks_stored", with_views(["v_alarms"], f"""
WITH n AS (SELECT max(ts) AS as_of, cast(max(ts) - INTERVAL {LOOKBACK_H} HOUR AS DATE) AS since FROM v_alarms),
early AS (SELECT * FROM v_alarms WHERE ts <= (SELECT as_of - INTERVAL 24 HOUR FROM n)),
i1 AS ({_W.replace('v_alarms', 'early')} SELECT * FROM inc),
i2 AS ({_W} SELECT * FROM inc)
SELECT v.id, v.element_id, CASE WHEN cast(v.ts AS DATE) >= since THEN CASE WHEN v.ts >= as_of - INTERVAL {LOOKBACK_H} HOUR THEN i2.incident_ref END
       WHEN v.ts >= as_of - INTERVAL {LOOKBACK_H + 24} HOUR THEN i1.incident_ref END AS correlated_incident
FROM v_alarms v CROSS JOIN n LEFT JOIN i1 ON v.element_id = i1.element_id LEFT JOIN i2 ON v.element_id = i2.element_id"""))
def q_triage_marks_stored(spark, sf_dir):
    """The stored alarm table after two triage runs a day apart: the second rewrites the
    dates of its lookback only, older marks stay."""
    alarms = _alarms(spark, sf_dir)
    cut = alarms.select((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("t")).first()["t"]
    base = scratch_path(spark, "triage-marks")
    A.write_triage(A.correlate_alarms(alarms.filter(F.col("ts") <= F.lit(cut)), None, MIN_ALARMS, LOOKBACK_H), base, 1)
    A.write_triage(A.correlate_alarms(alarms, None, MIN_ALARMS, LOOKBACK_H), base, 2)
    return read_latest(spark, f"{base}/network_alarms").select("id", "element_id", "correlated_incident")
