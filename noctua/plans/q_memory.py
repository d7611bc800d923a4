"""Memory jobs: recall, routing, write control, runbook outcomes, decay and
incident upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING
from ..operators import alarms as A
from ..operators import memory as M
from ..sources import tables as T
from ..sources.fixtures import view, with_views
from .catalog import query
from .q_alarms import _W, LOOKBACK_H, MIN_ALARMS

_INC_Q = "q AS (SELECT incident_ref AS query_id, cast(signature_vec AS DOUBLE[]) AS v FROM v_incidents WHERE signature_vec IS NOT NULL)"
_MEM_NN = _INC_Q + """,
m AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL),
ms AS (SELECT q.query_id, m.id, m.scope, m.category, m.confidence, m.evidence_count,
              list_cosine_similarity(q.v, m.memory_vec) AS sim FROM q CROSS JOIN m),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM ms)"""


def incident_queries(spark, sf_dir):
    return view(spark, sf_dir, "v_incidents").select(F.col("incident_ref").alias("query_id"),
                                                     F.col("signature_vec").alias("query_vec"))


@query("recall_similar", with_views(["v_incidents", "v_memory"], "WITH " + _MEM_NN + """
SELECT query_id, id, scope, category, confidence, evidence_count, round(sim, 6) AS similarity, rank FROM mr WHERE rank <= 5"""))
def q_recall_similar(spark, sf_dir):
    r = M.recall_similar(incident_queries(spark, sf_dir), view(spark, sf_dir, "v_memory"), 5)
    return r.select("query_id", "id", "scope", "category", "confidence", "evidence_count",
                    F.round("similarity", 6).alias("similarity"), "rank")


@query("recall_similar_scoped", with_views(["v_incidents", "v_memory"], "WITH " + _INC_Q + """,
m AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND scope = 'global'),
ms AS (SELECT q.query_id, m.id, m.scope, m.confidence, list_cosine_similarity(q.v, m.memory_vec) AS sim FROM q CROSS JOIN m),
mr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM ms)
SELECT query_id, id, scope, confidence, round(sim, 6) AS similarity, rank FROM mr WHERE rank <= 5"""))
def q_recall_similar_scoped(spark, sf_dir):
    r = M.recall_similar(incident_queries(spark, sf_dir), view(spark, sf_dir, "v_memory"), 5, scope="global")
    return r.select("query_id", "id", "scope", "confidence", F.round("similarity", 6).alias("similarity"), "rank")


@query("recall_runbooks", with_views(["v_incidents", "v_runbooks"], "WITH " + _INC_Q + """,
rb AS (SELECT * FROM v_runbooks WHERE status = 'active' AND superseded_by IS NULL AND runbook_vec IS NOT NULL),
s AS (SELECT q.query_id, rb.id, rb.title, rb.confidence, rb.success_count, rb.fail_count,
             list_cosine_similarity(q.v, cast(rb.runbook_vec AS DOUBLE[])) AS sim FROM q CROSS JOIN rb),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT query_id, id, title, confidence, success_count, fail_count, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 3"""))
def q_recall_runbooks(spark, sf_dir):
    r = M.recall_runbooks(incident_queries(spark, sf_dir), view(spark, sf_dir, "v_runbooks"), 3)
    return r.select("query_id", "id", "title", "confidence", F.col("success_count").cast("int").alias("success_count"),
                    F.col("fail_count").cast("int").alias("fail_count"), F.round("similarity", 6).alias("similarity"), "rank")


ROUTE_SQL = "WITH " + _MEM_NN + """,
top3 AS (SELECT * FROM mr WHERE rank <= 3),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence * sim DESC, sim DESC, id) AS pr FROM top3
      WHERE coalesce(confidence, 0) >= {cg} AND coalesce(sim, 0) >= {sg}),
st AS (SELECT query_id, count(*) AS n_matches, count(*) FILTER (WHERE coalesce(confidence, 0) >= {cg} AND coalesce(sim, 0) >= {sg}) AS n_passing
       FROM top3 GROUP BY 1)
SELECT q.query_id, CASE WHEN p.id IS NOT NULL THEN 'SHORTCUT' ELSE 'EXPLORE' END AS path,
       CASE WHEN p.id IS NOT NULL THEN 0 ELSE 512 END AS thinking_budget,
       CASE WHEN p.id IS NOT NULL THEN 3 ELSE 15 END AS max_tool_rounds, p.id AS matched_id,
       coalesce(st.n_matches, 0) AS n_matches, coalesce(st.n_passing, 0) AS n_passing
FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN st USING (query_id) LEFT JOIN (SELECT * FROM p WHERE pr = 1) p USING (query_id)"""


@query("route", with_views(["v_incidents", "v_memory"], ROUTE_SQL.format(cg="0.85e0", sg="0.55e0")))
def q_route(spark, sf_dir):
    qs = incident_queries(spark, sf_dir)
    matches = M.recall_similar(qs, view(spark, sf_dir, "v_memory"), 3)
    r = M.route(qs.filter(F.col("query_vec").isNotNull()), matches, DEFAULT_TUNING)
    return r.select("query_id", "path", "thinking_budget", "max_tool_rounds", "matched_id", "n_matches", "n_passing")


@query("write_gate", with_views(["v_reasoning"], """
SELECT id, confidence, coalesce(confidence >= 0.80e0, false) AS accepted FROM v_reasoning"""))
def q_write_gate(spark, sf_dir):
    return M.write_gate(view(spark, sf_dir, "v_reasoning").select("id", "confidence"))


@query("runbook_outcomes", with_views(["v_runbooks", "v_outcomes"], """
WITH t AS (SELECT runbook_id, count(*) FILTER (WHERE succeeded) AS s, count(*) FILTER (WHERE NOT succeeded) AS f FROM v_outcomes GROUP BY 1)
SELECT id, cast(success_count + coalesce(s, 0) AS BIGINT) AS success_count, cast(fail_count + coalesce(f, 0) AS BIGINT) AS fail_count,
       CASE WHEN t.runbook_id IS NOT NULL THEN round((success_count + coalesce(s, 0)) / greatest(success_count + coalesce(s, 0) + fail_count + coalesce(f, 0), 1), 2)
            ELSE confidence END AS confidence
FROM v_runbooks r LEFT JOIN t ON r.id = t.runbook_id"""))
def q_runbook_outcomes(spark, sf_dir):
    r = M.apply_runbook_outcomes(view(spark, sf_dir, "v_runbooks"), view(spark, sf_dir, "v_outcomes"))
    return r.select("id", "success_count", "fail_count", "confidence")


@query("decay", with_views(["v_memory"], """
WITH m AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL),
a AS (SELECT max(coalesce(last_reinforced_at, created_at)) AS as_of FROM m),
d AS (SELECT id, confidence AS old_confidence,
             coalesce(date_diff('day', cast(coalesce(last_reinforced_at, created_at) AS DATE), cast(as_of AS DATE)), 0) AS days_unreinforced
      FROM m, a),
x AS (SELECT *, CASE WHEN days_unreinforced < 7 THEN 'skip_grace' WHEN old_confidence < 0.30e0 THEN 'skip_floor' ELSE 'decay' END AS action FROM d)
SELECT id, days_unreinforced, old_confidence, action,
       CASE WHEN action = 'decay' THEN round(old_confidence * exp(-ln(2e0) * days_unreinforced / 30e0), 2) END AS new_confidence,
       CASE WHEN action = 'decay' THEN round(old_confidence * exp(-ln(2e0) * days_unreinforced / 30e0), 2) < 0.85e0 END AS will_lose_routing
FROM x"""))
def q_decay(spark, sf_dir):
    d = M.decay_memory(view(spark, sf_dir, "v_memory"))
    return d.select("id", "days_unreinforced", "old_confidence", "action", "new_confidence", "will_lose_routing")


_UPSERT_COLS = ["incident_ref", "element_id", "window_start", "alarm_count", "severity", "subcategory", "title",
                "anomaly_score", "status"]


@query("upsert_incidents", with_views(["v_alarms", "v_incidents"], _W + """,
src AS (SELECT incident_ref, element_id, window_start, alarm_count, severity, subcategory,
               subcategory || ' on ' || element_id || ' (' || cast(alarm_count AS varchar) || ' correlated alarms)' AS title,
               anomaly_score, 'open' AS status FROM inc
        UNION ALL
        SELECT incident_ref, element_id, window_start, alarm_count * 2, 'minor', subcategory, 'changed', round(anomaly_score / 2, 3), status
        FROM v_incidents WHERE status = 'open')
SELECT coalesce(t.incident_ref, s.incident_ref) AS incident_ref,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.element_id ELSE s.element_id END AS element_id,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.window_start ELSE s.window_start END AS window_start,
       CASE WHEN s.incident_ref IS NOT NULL THEN s.alarm_count ELSE t.alarm_count END AS alarm_count,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.severity ELSE s.severity END AS severity,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.subcategory ELSE s.subcategory END AS subcategory,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.title ELSE s.title END AS title,
       CASE WHEN s.incident_ref IS NOT NULL THEN s.anomaly_score ELSE t.anomaly_score END AS anomaly_score,
       CASE WHEN t.incident_ref IS NOT NULL THEN t.status ELSE s.status END AS status
FROM v_incidents t FULL OUTER JOIN src s ON t.incident_ref = s.incident_ref"""))
def q_upsert_incidents(spark, sf_dir):
    target = view(spark, sf_dir, "v_incidents").select(*_UPSERT_COLS)
    new = A.correlate_alarms(view(spark, sf_dir, "v_alarms"), None, MIN_ALARMS, LOOKBACK_H).incidents.select(*_UPSERT_COLS)
    changed = target.filter(F.col("status") == "open").select(
        "incident_ref", "element_id", "window_start", (F.col("alarm_count") * 2).alias("alarm_count"),
        F.lit("minor").alias("severity"), "subcategory", F.lit("changed").alias("title"),
        F.round(F.col("anomaly_score") / 2, 3).alias("anomaly_score"), "status")
    return T.upsert(target, new.unionByName(changed), ["incident_ref"], ["alarm_count", "anomaly_score"])
