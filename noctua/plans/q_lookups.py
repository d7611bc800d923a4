"""Lookup, picking, validation and coverage jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources import quality as Q
from ..sources.fixtures import view, with_views
from .catalog import query


@query("element_profile", with_views(["v_alarms", "v_incidents", "v_elements"], """
WITH e AS (SELECT element_id AS entity_ref FROM v_alarms UNION SELECT element_id FROM v_incidents)
SELECT e.entity_ref,
       CASE WHEN el.element_id IS NOT NULL THEN '[T1 element] ' || el.element_id || ' type=' || coalesce(el.element_type, 'None')
            || ' vendor=' || coalesce(el.vendor, 'None') || '/' || coalesce(el.model, 'None') || ' sw=None site='
            || coalesce(el.site_id, 'None') || ' region=' || coalesce(el.region, 'None') || ' crit=' || coalesce(el.criticality, 'None') END AS t1_text,
       CASE WHEN e.entity_ref IS NULL THEN 'no_entity' WHEN el.element_id IS NULL THEN 'not_found' ELSE 'ok' END AS t1_status
FROM e LEFT JOIN v_elements el ON e.entity_ref = el.element_id"""))
def q_element_profile(spark, sf_dir):
    ents = (view(spark, sf_dir, "v_alarms").select(F.col("element_id").alias("entity_ref"))
            .union(view(spark, sf_dir, "v_incidents").select("element_id")).distinct())
    return L.element_profile(ents, view(spark, sf_dir, "v_elements"))


@query("recent_incidents", with_views(["v_incidents"], """
SELECT * FROM (SELECT element_id, incident_ref, severity, subcategory, anomaly_score, status, window_start,
       row_number() OVER (PARTITION BY element_id ORDER BY window_start DESC, incident_ref) AS rank
       FROM v_incidents WHERE element_id IS NOT NULL) WHERE rank <= 5"""))
def q_recent_incidents(spark, sf_dir):
    i = view(spark, sf_dir, "v_incidents")
    return L.recent_incidents(i).select("element_id", "incident_ref", "severity", "subcategory", "anomaly_score",
                                        "status", "window_start", "rank")


@query("recent_alarms", with_views(["v_alarms"], """
WITH a AS (SELECT max(ts) AS as_of FROM v_alarms),
c AS (SELECT element_id, severity, alarm_type, count(*) AS c FROM v_alarms, a
      WHERE ts >= as_of - INTERVAL 24 HOUR AND severity IN ('critical', 'major') GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY c DESC, severity, alarm_type) AS rank FROM c)
WHERE rank <= 5"""))
def q_recent_alarms(spark, sf_dir):
    return L.recent_alarms(view(spark, sf_dir, "v_alarms"))


@query("latest_checkpoint", with_views(["v_reasoning"], """
SELECT session_id, id, created_at, observation, hypothesis, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS r FROM v_reasoning) WHERE r = 1"""))
def q_latest_checkpoint(spark, sf_dir):
    return L.latest_checkpoint(view(spark, sf_dir, "v_reasoning")).select(
        "session_id", "id", "created_at", "observation", "hypothesis", "confidence")


@query("prior_outcomes", with_views(["v_reasoning"], """
SELECT * FROM (SELECT element_id, id, resolution, confidence, hypothesis, created_at,
       row_number() OVER (PARTITION BY element_id ORDER BY created_at DESC, id DESC) AS rank
       FROM v_reasoning WHERE resolution IN ('confirmed', 'promoted', 'escalated') AND element_id IS NOT NULL) WHERE rank <= 4"""))
def q_prior_outcomes(spark, sf_dir):
    return L.prior_outcomes(view(spark, sf_dir, "v_reasoning")).select(
        "element_id", "id", "resolution", "confidence", "hypothesis", "created_at", "rank")


@query("pick_incidents", with_views(["v_incidents"], """
SELECT * FROM (SELECT incident_ref, anomaly_score, window_start, 'latest' AS pick_mode,
       row_number() OVER (ORDER BY anomaly_score DESC NULLS LAST, window_start DESC, incident_ref) AS pick_rank
       FROM v_incidents WHERE status = 'open') WHERE pick_rank <= 10
UNION ALL
SELECT * FROM (SELECT incident_ref, anomaly_score, window_start, 'newest' AS pick_mode,
       row_number() OVER (ORDER BY window_start DESC, incident_ref) AS pick_rank
       FROM v_incidents WHERE status = 'open') WHERE pick_rank <= 10"""))
def q_pick_incidents(spark, sf_dir):
    i = view(spark, sf_dir, "v_incidents").select("incident_ref", "anomaly_score", "window_start", "status")
    cols = ["incident_ref", "anomaly_score", "window_start", "pick_mode", "pick_rank"]
    return (L.pick_incidents(i, "latest", 10).select(*cols)
            .unionByName(L.pick_incidents(i, "newest", 10).select(*cols)))


@query("validate_alarms", with_views(["v_alarms"], """
WITH d AS (SELECT id FROM v_alarms GROUP BY id HAVING count(*) > 1)
SELECT v.id, CASE WHEN v.id IS NULL THEN 'null:id' WHEN element_id IS NULL THEN 'null:element_id' WHEN ts IS NULL THEN 'null:ts'
  WHEN severity IS NULL THEN 'null:severity' WHEN alarm_type IS NULL THEN 'null:alarm_type'
  WHEN severity NOT IN ('critical', 'major', 'minor', 'warning', 'info', 'clear') THEN 'enum:severity'
  WHEN metrics IS NOT NULL AND NOT coalesce(json_valid(metrics) AND json_type(metrics) = 'OBJECT', false) THEN 'json:metrics'
  WHEN d.id IS NOT NULL THEN 'duplicate:id' END AS reason
FROM v_alarms v LEFT JOIN d ON v.id = d.id"""))
def q_validate_alarms(spark, sf_dir):
    return Q.validate(view(spark, sf_dir, "v_alarms"), Q.ALARMS_CONTRACT).select("id", "reason")


@query("validate_tickets", with_views(["v_tickets_text"], """
WITH d AS (SELECT ticket_id FROM v_tickets_text GROUP BY 1 HAVING count(*) > 1)
SELECT v.ticket_id, CASE WHEN v.ticket_id IS NULL THEN 'null:ticket_id' WHEN summary IS NULL THEN 'null:summary'
  WHEN priority NOT IN ('P1', 'P2', 'P3', 'P4') THEN 'enum:priority'
  WHEN embedding IS NOT NULL AND len(embedding) <> 64 THEN 'width:embedding'
  WHEN d.ticket_id IS NOT NULL THEN 'duplicate:ticket_id' END AS reason
FROM v_tickets_text v LEFT JOIN d ON v.ticket_id = d.ticket_id"""))
def q_validate_tickets(spark, sf_dir):
    return Q.validate(view(spark, sf_dir, "v_tickets_text"), Q.TICKETS_CONTRACT).select("ticket_id", "reason")


@query("vector_coverage", with_views(["v_tickets_text", "v_memory", "v_runbooks", "v_incidents"], """
SELECT 'tickets' AS table_name, count(*) AS rows, count(embedding) AS with_vector FROM v_tickets_text
UNION ALL SELECT 'incident_memory', count(*), count(memory_vec) FROM v_memory
UNION ALL SELECT 'runbook_memory', count(*), count(runbook_vec) FROM v_runbooks
UNION ALL SELECT 'incidents', count(*), count(signature_vec) FROM v_incidents"""))
def q_vector_coverage(spark, sf_dir):
    return Q.coverage({
        "tickets": (view(spark, sf_dir, "v_tickets_text"), "embedding"),
        "incident_memory": (view(spark, sf_dir, "v_memory"), "memory_vec"),
        "runbook_memory": (view(spark, sf_dir, "v_runbooks"), "runbook_vec"),
        "incidents": (view(spark, sf_dir, "v_incidents"), "signature_vec"),
    })
