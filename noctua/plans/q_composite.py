"""Composite jobs: near pairs, consolidation, best runbook, context assembly
and batch remediation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, TIER_CAPS
from ..operators import context as C
from ..operators import dedup as D
from ..operators import lifecycle as LC
from ..operators import remediate as RM
from ..operators.alarms import correlate_alarms, write_triage
from ..operators.knn import near_pairs
from ..operators.memory import active_only
from ..session import scratch_path
from ..sources.fixtures import view, with_views
from ..sources.tables import read_batches
from .catalog import query
from .q_alarms import _W, LOOKBACK_H, MIN_ALARMS
from .q_eval import encoded_sql
from .q_memory import _INC_Q, incident_queries

CONTEXT_BUDGET = 120


@query("near_pairs", with_views(["v_memory"], """
WITH m AS (SELECT id, memory_vec FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL)
SELECT a.id AS id_a, b.id AS id_b, round(1 - list_cosine_similarity(a.memory_vec, b.memory_vec), 6) AS distance
FROM m a JOIN m b ON a.id < b.id WHERE 1 - list_cosine_similarity(a.memory_vec, b.memory_vec) < 0.15e0"""))
def q_near_pairs(spark, sf_dir):
    m = active_only(view(spark, sf_dir, "v_memory"))
    p = near_pairs(m, DEFAULT_TUNING.dedup_distance_threshold, id_col="id", vec_col="memory_vec")
    return p.select("id_a", "id_b", F.round("distance", 6).alias("distance"))


def lsh_pairs_sql(threshold: float, recall: float = LC.LSH_RECALL, bucket_rows: int = LC.BUCKET_ROWS, seed: int = 7) -> str:
    """CTEs up to `near` (id_a, id_b, distance): active patterns that share a bucket of sign projections
    and lie closer than the threshold."""
    return f"""
act AS (SELECT id, memory_vec AS v FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL),
design AS (SELECT bits, greatest(1, ceil(ln(1 - {recall}) / ln(1 - pow(1 - acos(1 - {threshold}) / pi(), bits)))) AS bands
  FROM (SELECT greatest(4, ceil(log2(greatest(count(*), 1) / {bucket_rows}.0))) AS bits FROM act)),
planes AS (SELECT num, bits, list(('0x' || substr(md5('{seed}:' || num || ':' || d), 1, 8))::BIGINT / 4294967296.0e0 - 0.5e0 ORDER BY d) AS p
  FROM (SELECT bits, unnest(range(cast(bits * bands AS BIGINT))) AS num FROM design),
       (SELECT unnest(range((SELECT max(len(v)) FROM act))) AS d) GROUP BY 1, 2),
sig AS (SELECT id, cast(num // bits AS BIGINT) AS band, string_agg(CASE WHEN list_inner_product(v, p) > 0 THEN '1' ELSE '0' END, '' ORDER BY num) AS bucket
  FROM act, planes GROUP BY 1, 2),
met AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM sig a JOIN sig b ON a.band = b.band AND a.bucket = b.bucket AND a.id < b.id),
near AS (SELECT * FROM (SELECT id_a, id_b, 1 - list_cosine_similarity(x.v, y.v) AS distance
  FROM met JOIN act x ON x.id = id_a JOIN act y ON y.id = id_b) WHERE distance < {threshold})"""


@query("consolidate", with_views(["v_memory"], "WITH RECURSIVE " + lsh_pairs_sql(0.15) + """,
links AS (SELECT id_a AS id, id_b AS other FROM near UNION ALL SELECT id_b, id_a FROM near),
nodes AS (SELECT row_number() OVER (ORDER BY id) AS k, m.id, coalesce(m.confidence, 0.7e0) AS conf, coalesce(m.evidence_count, 1)::BIGINT AS ev, l.others
  FROM v_memory m JOIN (SELECT id, list(other) AS others FROM links GROUP BY 1) l USING (id)),
greedy AS (
  SELECT 0::BIGINT AS k, (SELECT list(struct_pack(id := id, conf := conf, ev := ev, sup := NULL::BIGINT, hit := false, seen := false) ORDER BY id) FROM nodes) AS st
  UNION ALL
  SELECT k + 1, CASE WHEN sz < 2 THEN st ELSE list_transform(st, lambda x: CASE WHEN NOT list_contains(ids, x.id) THEN x
      WHEN x.id = keep THEN struct_pack(id := x.id, conf := x.conf, ev := total, sup := x.sup, hit := true, seen := true)
      ELSE struct_pack(id := x.id, conf := x.conf, ev := x.ev, sup := keep, hit := x.hit, seen := true) END) END
  FROM (SELECT k, st, len(mem) AS sz, list_transform(mem, lambda x: x.id) AS ids, list_sum(list_transform(mem, lambda x: x.ev))::BIGINT AS total,
               list_sort(list_transform(mem, lambda x: struct_pack(c := -x.conf, i := x.id)))[1].i AS keep
        FROM (SELECT g.k, g.st, CASE WHEN g.st[g.k + 1].seen THEN [] ELSE
                list_filter(g.st, lambda x: x.sup IS NULL AND (x.id = n.id OR list_contains(n.others, x.id))) END AS mem
              FROM greedy g JOIN nodes n ON n.k = g.k + 1))),
fin AS (SELECT u.* FROM (SELECT unnest(st) AS u FROM (SELECT st FROM greedy ORDER BY k DESC LIMIT 1)))
SELECT m.id, CASE WHEN f.sup IS NOT NULL THEN 'superseded' ELSE m.status END AS status, coalesce(f.sup, m.superseded_by) AS superseded_by,
       coalesce(f.ev, m.evidence_count)::BIGINT AS evidence_count,
       CASE WHEN f.hit THEN (SELECT max(coalesce(last_reinforced_at, created_at)) FROM v_memory) ELSE m.last_reinforced_at END AS last_reinforced_at
FROM v_memory m LEFT JOIN fin f USING (id)"""))
def q_consolidate(spark, sf_dir):
    """The memory table after one consolidation pass; the oracle takes one anchor after the other."""
    out = D.consolidate_memory(view(spark, sf_dir, "v_memory"))
    return out.select("id", "status", "superseded_by", F.col("evidence_count").cast("long").alias("evidence_count"), "last_reinforced_at")


@query("best_runbook", with_views(["v_incidents", "v_runbooks"], "WITH " + _INC_Q + """,
rb AS (SELECT * FROM v_runbooks WHERE status = 'active' AND superseded_by IS NULL AND runbook_vec IS NOT NULL),
s AS (SELECT q.query_id, rb.id, list_cosine_similarity(q.v, cast(rb.runbook_vec AS DOUBLE[])) AS sim FROM q CROSS JOIN rb),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) WHERE rank = 1)
SELECT q.query_id, r.id AS runbook_id, round(coalesce(r.sim, 0), 6) AS similarity,
       r.id IS NOT NULL AND coalesce(r.sim, 0) >= 0.45e0 AS applies
FROM (SELECT DISTINCT query_id FROM q) q LEFT JOIN r USING (query_id)"""))
def q_best_runbook(spark, sf_dir):
    qs = incident_queries(spark, sf_dir).filter(F.col("query_vec").isNotNull())
    b = RM.best_runbook(qs, view(spark, sf_dir, "v_runbooks"))
    return b.select("query_id", "runbook_id", F.round("similarity", 6).alias("similarity"), "applies")


def _trunc(x: str, cap: int) -> str:
    n = cap * 4
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '…' ELSE {x} END"


_CONTEXT_ENTS = """
WITH a AS (SELECT max(ts) AS as_of FROM v_alarms),
ents AS (SELECT incident_ref AS key, element_id AS entity_ref, 'S-' || cast(alarm_count AS varchar) AS session_id,
                cast(signature_vec AS DOUBLE[]) AS v FROM v_incidents)"""


def _context_sql(budget: int, start: str = _CONTEXT_ENTS, incidents: str = "v_incidents", reasoning: str = "v_reasoning", end: str | None = None) -> str:
    """`start`: CTEs up to `a` (as_of) and `ents` (key, entity_ref, session_id, v); `end`: what follows the context CTE `ctx`."""
    tiers = C.TIERS
    texts = {
        "t1_entity": "t1_raw",
        "t2_recent": "CASE WHEN t2_lines IS NOT NULL THEN '[T2 recent] ' || t2_lines END",
        "t3_active": "t3_raw",
        "t4_prior": "CASE WHEN t4_lines IS NOT NULL THEN '[T4 prior] ' || t4_lines END",
        "t5_semantic": "CASE WHEN t5_lines IS NOT NULL THEN '[T5 semantic] ' || t5_lines END",
    }
    empty_status = {
        "t1_entity": "CASE WHEN entity_ref IS NULL THEN 'no_entity' WHEN t1_raw IS NULL THEN 'not_found' ELSE 'ok' END",
        "t2_recent": "CASE WHEN entity_ref IS NULL THEN 'no_entity' ELSE 'empty' END",
        "t3_active": "NULL",
        "t4_prior": "CASE WHEN entity_ref IS NULL THEN 'no_entity' ELSE 'empty' END",
        "t5_semantic": "NULL",
    }
    txt_cols = ", ".join(f"{_trunc(f'({texts[n]})', TIER_CAPS[n])} AS x_{n}" for n in tiers)
    cost_cols = ", ".join(f"CASE WHEN x_{n} IS NOT NULL THEN greatest(1, length(x_{n}) // 4) END AS c_{n}" for n in tiers)
    chain = []
    prev = "0"
    for i, n in enumerate(tiers):
        chain.append(f"b{i} AS (SELECT *, coalesce(x_{n} IS NOT NULL AND {prev} + c_{n} <= {budget}, false) AS k_{n} FROM "
                     f"{'costs' if i == 0 else f'b{i - 1}'})")
        prev = f"({prev} + CASE WHEN k_{n} THEN c_{n} ELSE 0 END)"
    last = f"b{len(tiers) - 1}"
    tokens = ", ".join(
        f"CASE WHEN k_{n} THEN c_{n} WHEN x_{n} IS NULL AND ({empty_status[n]}) IS NOT NULL THEN 0 END AS {n}_tokens" for n in tiers)
    statuses = ", ".join(f"CASE WHEN k_{n} THEN 'ok' WHEN x_{n} IS NULL THEN {empty_status[n]} END AS {n}_status" for n in tiers)
    blocks = ", ".join(f"CASE WHEN k_{n} THEN x_{n} END" for n in tiers)
    return start + f""",
refs AS (SELECT DISTINCT entity_ref FROM ents WHERE entity_ref IS NOT NULL),
t1 AS (SELECT r.entity_ref, '[T1 element] ' || el.element_id || ' type=' || coalesce(el.element_type, 'None') || ' vendor='
              || coalesce(el.vendor, 'None') || '/' || coalesce(el.model, 'None') || ' sw=None site=' || coalesce(el.site_id, 'None')
              || ' region=' || coalesce(el.region, 'None') || ' crit=' || coalesce(el.criticality, 'None') AS t1_raw
       FROM refs r JOIN v_elements el ON el.element_id = r.entity_ref),
il AS (SELECT element_id AS entity_ref, rank AS o, 'inc ' || incident_ref || ' ' || coalesce(severity, 'None') || '/'
              || coalesce(subcategory, 'None') || ' anom=' || coalesce(printf('%.3f', anomaly_score), 'None') || ' ' || coalesce(status, 'None') AS l
       FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY window_start DESC, incident_ref) AS rank
             FROM {incidents} WHERE element_id IN (SELECT entity_ref FROM refs)) WHERE rank <= 5),
ac AS (SELECT element_id, severity, alarm_type, count(*) AS c FROM v_alarms, a
       WHERE ts >= as_of - INTERVAL 24 HOUR AND severity IN ('critical', 'major') AND element_id IN (SELECT entity_ref FROM refs) GROUP BY 1, 2, 3),
alr AS (SELECT element_id AS entity_ref, rank + 100 AS o, 'alarm ' || severity || ' ' || alarm_type || ' x' || cast(c AS varchar) || ' (24h)' AS l
        FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY c DESC, severity, alarm_type) AS rank FROM ac) WHERE rank <= 5),
t2 AS (SELECT entity_ref, string_agg(l, ' | ' ORDER BY o) AS t2_lines FROM (SELECT * FROM il UNION ALL SELECT * FROM alr) GROUP BY 1),
t3 AS (SELECT session_id, '[T3 active] obs=' || coalesce(observation, 'None') || ' | hyp=' || coalesce(hypothesis, 'None')
              || ' | conf=' || coalesce(printf('%.2f', confidence), 'None') AS t3_raw
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS r FROM {reasoning}
             WHERE session_id IN (SELECT session_id FROM ents)) WHERE r = 1),
t4 AS (SELECT element_id AS entity_ref, string_agg(coalesce(resolution, 'None') || ' (conf=' || coalesce(printf('%.2f', confidence), 'None')
              || '): ' || substring(coalesce(hypothesis, ''), 1, 80), ' | ' ORDER BY rank) AS t4_lines
       FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY created_at DESC, id DESC) AS rank FROM {reasoning}
             WHERE resolution IN ('confirmed', 'promoted', 'escalated') AND element_id IN (SELECT entity_ref FROM refs)) WHERE rank <= 4 GROUP BY 1),
m AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL),
ms AS (SELECT e.key, m.id, m.category, m.confidence, m.content, list_cosine_similarity(e.v, m.memory_vec) AS sim FROM ents e CROSS JOIN m WHERE e.v IS NOT NULL),
mr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, id) AS rank FROM ms) WHERE rank <= 3),
t5 AS (SELECT key, count(*) AS t5_n, arg_max(id, (confidence, -rank)) AS top_match_id,
              string_agg('mem=' || cast(id AS varchar) || ' cat=' || coalesce(category, 'None') || ' conf=' || coalesce(printf('%.2f', confidence), 'None')
                         || ' sim=' || printf('%.2f', sim) || ' :: ' || substring(coalesce(content, ''), 1, 80), ' | ' ORDER BY rank) AS t5_lines
       FROM mr GROUP BY 1),
j AS (SELECT e.key, e.entity_ref, e.session_id, t1.t1_raw, t2.t2_lines, t3.t3_raw, t4.t4_lines, t5.t5_lines, t5.t5_n, t5.top_match_id
      FROM ents e LEFT JOIN t1 USING (entity_ref) LEFT JOIN t2 USING (entity_ref) LEFT JOIN t3 USING (session_id)
      LEFT JOIN t4 USING (entity_ref) LEFT JOIN t5 USING (key)),
txts AS (SELECT *, {txt_cols} FROM j),
costs AS (SELECT *, {cost_cols} FROM txts),
{", ".join(chain)},
ctx AS (SELECT key, entity_ref, session_id, concat_ws(chr(10), {blocks}) AS system_context,
       cast({prev} AS INTEGER) AS budget_used, {budget} AS budget_total, {tokens}, {statuses},
       top_match_id, coalesce(t5_n, 0) AS n_vector_matches
FROM {last})
""" + (end or "SELECT * FROM ctx")


@query("assemble_context", with_views(["v_alarms", "v_incidents", "v_elements", "v_reasoning", "v_memory"],
                                      _context_sql(CONTEXT_BUDGET)))
def q_assemble_context(spark, sf_dir):
    return _context(spark, sf_dir, DEFAULT_TUNING.with_(context_budget_tokens=CONTEXT_BUDGET))


def _context(spark, sf_dir, tuning):
    inc = view(spark, sf_dir, "v_incidents")
    ents = inc.select(F.col("incident_ref").alias("key"), F.col("element_id").alias("entity_ref"),
                      F.concat(F.lit("S-"), F.col("alarm_count").cast("string")).alias("session_id"),
                      F.col("signature_vec").alias("query_vec"))
    return C.assemble_context(ents, view(spark, sf_dir, "v_elements"), inc, view(spark, sf_dir, "v_alarms"),
                              view(spark, sf_dir, "v_reasoning"), view(spark, sf_dir, "v_memory"),
                              tuning=tuning)


@query("assemble_context_full", with_views(["v_alarms", "v_incidents", "v_elements", "v_reasoning", "v_memory"],
                                           _context_sql(int(DEFAULT_TUNING.context_budget_tokens))))
def q_assemble_context_full(spark, sf_dir):
    """D11 under the default budget: every tier enters, long ones cut to their caps."""
    return _context(spark, sf_dir, DEFAULT_TUNING)


_REMEDIATE_CTES = """
WITH inc AS (SELECT * FROM v_incidents WHERE status = 'open'),
q AS (SELECT incident_ref AS query_id, cast(signature_vec AS DOUBLE[]) AS v FROM inc),
m AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL),
mr AS (SELECT * FROM (SELECT q.query_id, m.id, m.confidence, list_cosine_similarity(q.v, m.memory_vec) AS sim,
        row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, m.memory_vec) DESC, m.id) AS rank
        FROM q CROSS JOIN m WHERE q.v IS NOT NULL) WHERE rank <= 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence * sim DESC, sim DESC, id) AS pr FROM mr
      WHERE coalesce(confidence, 0) >= 0.85e0 AND coalesce(sim, 0) >= 0.55e0) WHERE pr = 1),
rb AS (SELECT * FROM v_runbooks WHERE status = 'active' AND superseded_by IS NULL AND runbook_vec IS NOT NULL),
r1 AS (SELECT * FROM (SELECT q.query_id, rb.id, rb.title, list_cosine_similarity(q.v, cast(rb.runbook_vec AS DOUBLE[])) AS sim,
        row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, cast(rb.runbook_vec AS DOUBLE[])) DESC, rb.id) AS rank
        FROM q CROSS JOIN rb WHERE q.v IS NOT NULL) WHERE rank = 1),
d AS (SELECT i.incident_ref, i.element_id, i.subcategory, i.severity, i.anomaly_score,
             CASE WHEN p.id IS NOT NULL THEN 'SHORTCUT' ELSE 'EXPLORE' END AS path, p.id AS matched_id,
             r1.id AS rb_id, r1.title AS rb_title, coalesce(r1.sim, 0e0) AS rb_sim,
             r1.id IS NOT NULL AND coalesce(r1.sim, 0e0) >= 0.45e0 AS chosen,
             least(0.95e0, 0.5e0 + (CASE WHEN i.anomaly_score IS NOT NULL AND i.anomaly_score <> 0 THEN i.anomaly_score ELSE 0.6e0 END) / 2) AS confidence
      FROM inc i LEFT JOIN p ON p.query_id = i.incident_ref LEFT JOIN r1 ON r1.query_id = i.incident_ref)"""


@query("remediate", with_views(["v_incidents", "v_memory", "v_runbooks"], _REMEDIATE_CTES + """
SELECT incident_ref, element_id, path, matched_id, CASE WHEN chosen THEN rb_id END AS chosen_runbook_id,
       round(rb_sim, 3) AS top_runbook_similarity, CASE WHEN chosen THEN 'confirmed' ELSE 'escalated' END AS resolution,
       CASE WHEN chosen THEN 'resolved' ELSE 'investigating' END AS new_status, confidence,
       'Incident ' || incident_ref || ' on ' || coalesce(element_id, 'None') || ': ' || coalesce(subcategory, 'None') || ' sev='
         || coalesce(severity, 'None') || ' anomaly=' || coalesce(printf('%.3f', anomaly_score), 'None') AS observation,
       CASE WHEN chosen THEN 'Apply runbook ''' || coalesce(rb_title, 'None') || '''' ELSE 'No matching runbook; escalate for manual investigation' END AS hypothesis,
       CASE WHEN chosen THEN confidence >= 0.80e0 END AS pattern_accepted
FROM d"""))
def q_remediate(spark, sf_dir):
    r = RM.remediate(view(spark, sf_dir, "v_incidents"), view(spark, sf_dir, "v_memory"), view(spark, sf_dir, "v_runbooks"))
    acc = r.patterns.select(F.element_at("source_refs", 1).alias("incident_ref"), F.col("accepted").alias("pattern_accepted"))
    return (r.decisions.join(acc, "incident_ref", "left")
            .select("incident_ref", "element_id", "path", "matched_id", "chosen_runbook_id", "top_runbook_similarity",
                    "resolution", "new_status", "confidence", "observation", "hypothesis", "pattern_accepted"))


@query("remediate_writeback", with_views(["v_incidents", "v_memory", "v_runbooks"], _REMEDIATE_CTES + """,
t AS (SELECT rb_id AS runbook_id, count(*) AS s FROM d WHERE chosen GROUP BY 1)
SELECT r.id, cast(r.success_count + coalesce(t.s, 0) AS BIGINT) AS success_count, cast(r.fail_count AS BIGINT) AS fail_count,
       CASE WHEN t.runbook_id IS NOT NULL
            THEN round((r.success_count + t.s) / greatest(r.success_count + t.s + r.fail_count, 1), 2)
            ELSE r.confidence END AS confidence
FROM v_runbooks r LEFT JOIN t ON r.id = t.runbook_id"""))
def q_remediate_writeback(spark, sf_dir):
    """Runbook table after one remediation batch (D18 write-back via D15)."""
    r = RM.remediate(view(spark, sf_dir, "v_incidents"), view(spark, sf_dir, "v_memory"), view(spark, sf_dir, "v_runbooks"))
    return r.runbooks.select("id", "success_count", "fail_count", "confidence")


@query("memory_after_remediate", with_views(["v_alarms", "v_incidents", "v_memory", "v_runbooks"], _REMEDIATE_CTES + f""",
t AS ({_W} SELECT 'triage-' || incident_ref AS session_id, element_id, CASE WHEN anomaly_score >= 0.5 THEN 'confirmed' ELSE 'dismissed' END AS resolution FROM inc)
SELECT 'triage' AS writer, session_id, element_id, resolution FROM t
UNION ALL SELECT 'remediation', 'remediation-' || incident_ref, element_id, CASE WHEN chosen THEN 'confirmed' ELSE 'escalated' END FROM d"""))
def q_memory_after_remediate(spark, sf_dir):
    """Episodic memory after a triage and a remediation run of the same version: both writers' rows."""
    base = scratch_path(spark, "memory-after")
    incidents = view(spark, sf_dir, "v_incidents")
    write_triage(correlate_alarms(view(spark, sf_dir, "v_alarms"), None, MIN_ALARMS, LOOKBACK_H), base, 1)
    r = RM.remediate(incidents, view(spark, sf_dir, "v_memory"), view(spark, sf_dir, "v_runbooks"))
    RM.write_remediation(r, incidents, base, 1, "2024-03-01 00:00:00")
    return read_batches(spark, f"{base}/agent_reasoning").select("writer", "session_id", "element_id", "resolution")


CHAIN_TUNING = DEFAULT_TUNING.with_(routing_similarity_gate=0.3, runbook_relevance_floor=0.25, context_budget_tokens=CONTEXT_BUDGET)

_CHAIN_START = _W.rstrip() + """,
opened AS (SELECT incident_ref, element_id, severity, subcategory, anomaly_score, window_start, 'open' AS status,
       subcategory || ' ' || subcategory || ' on ' || element_id || ' (' || cast(alarm_count AS varchar) || ' correlated alarms)' AS txt FROM inc),
episodes AS (SELECT id, session_id, element_id, created_at, observation, hypothesis, resolution, confidence FROM v_reasoning
  UNION ALL SELECT NULL, 'triage-' || incident_ref, element_id, (SELECT as_of FROM a), '',
       'Likely ' || subcategory || ' (dominant alarm: ' || coalesce(dominant_type, 'None') || ')',
       CASE WHEN anomaly_score >= 0.5 THEN 'confirmed' ELSE 'dismissed' END, round(least(0.95e0, 0.5e0 + anomaly_score / 2), 2) FROM inc),""" \
    + encoded_sql("opened", "incident_ref", "txt", "enc") + """,
ents AS (SELECT o.incident_ref AS key, o.element_id AS entity_ref, 'remediation-' || o.incident_ref AS session_id, enc.v
  FROM opened o JOIN enc USING (incident_ref))"""

_CHAIN_END = """,
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, id) AS rank FROM ms) WHERE rank <= 5),
sims AS (SELECT key, string_agg(cast(id AS varchar) || ':' || cast(round(sim, 4) AS varchar), ',' ORDER BY rank) AS near_ids FROM near GROUP BY 1),
gate AS (SELECT key, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, arg_max(id, (confidence * sim, sim, -id)) FILTER (WHERE ok) AS hit,
                arg_max(confidence, (confidence * sim, sim, -id)) FILTER (WHERE ok) AS hit_conf, arg_max(sim, (confidence * sim, sim, -id)) FILTER (WHERE ok) AS hit_sim
         FROM (SELECT *, confidence >= 0.85e0 AND sim >= 0.3e0 AS ok FROM mr) GROUP BY 1),
rb AS (SELECT * FROM v_runbooks WHERE status = 'active' AND superseded_by IS NULL AND runbook_vec IS NOT NULL),
r1 AS (SELECT * FROM (SELECT e.key, rb.id AS rb_id, rb.title AS rb_title, rb.steps, list_cosine_similarity(e.v, cast(rb.runbook_vec AS DOUBLE[])) AS rb_sim,
        row_number() OVER (PARTITION BY e.key ORDER BY list_cosine_similarity(e.v, cast(rb.runbook_vec AS DOUBLE[])) DESC, rb.id) AS r FROM ents e CROSS JOIN rb) WHERE r = 1),
d AS (SELECT o.*, c.system_context, c.budget_used, c.budget_total, g.n, g.n_ok, g.hit, g.hit_conf, g.hit_sim, r1.rb_id, r1.rb_title, r1.steps, r1.rb_sim,
             r1.rb_sim >= 0.25e0 AS chosen, s.near_ids, c.t4_prior_status, c.t5_semantic_tokens,
             least(0.95e0, 0.5e0 + (CASE WHEN o.anomaly_score <> 0 THEN o.anomaly_score ELSE 0.6e0 END) / 2) AS confidence
      FROM opened o JOIN ctx c ON c.key = o.incident_ref LEFT JOIN gate g ON g.key = o.incident_ref LEFT JOIN r1 ON r1.key = o.incident_ref
      LEFT JOIN sims s ON s.key = o.incident_ref)
SELECT incident_ref, element_id, subcategory, system_context, budget_used || '/' || budget_total AS context_budget, t4_prior_status, t5_semantic_tokens,
       CASE WHEN hit IS NOT NULL THEN 'SHORTCUT' ELSE 'EXPLORE' END AS path, hit AS matched_id,
       CASE WHEN n IS NULL THEN 'no semantic-memory matches (cold start)' WHEN hit IS NULL THEN 'scanned ' || n || ' matches; none passed both gates'
            ELSE n_ok || '/' || n || ' matches passed gates (conf≥0.85, sim≥0.3); chose mem ' || hit || ' (conf=' || printf('%.2f', hit_conf) || ', sim='
                 || printf('%.2f', hit_sim) || ') — substrate-driven shortcut' END AS reason,
       CASE WHEN chosen THEN rb_title END AS chosen_runbook, CASE WHEN chosen THEN steps END AS steps, round(rb_sim, 3) AS top_runbook_similarity,
       CASE WHEN chosen THEN 'resolved' ELSE 'investigating' END AS new_status, confidence, near_ids AS similar_patterns,
       CASE WHEN chosen THEN 'recorded success for runbook ' || rb_id
            ELSE 'nearest runbook similarity ' || printf('%.2f', rb_sim) || ' < floor 0.25 — no relevant runbook, escalating' END AS action,
       CASE WHEN chosen THEN confidence >= 0.80e0 END AS pattern_accepted
FROM d"""


@query("triage_to_remediation", with_views(["v_alarms", "v_elements", "v_reasoning", "v_memory", "v_runbooks"],
                                           _context_sql(CONTEXT_BUDGET, _CHAIN_START, "opened", "episodes", _CHAIN_END)))
def q_triage_to_remediation(spark, sf_dir):
    """Raw alarms to incidents to decisions in one batch, queries encoded from the incidents' own text."""
    v = {n: view(spark, sf_dir, f"v_{n}") for n in ("alarms", "elements", "reasoning", "memory", "runbooks")}
    _, r = RM.triage_to_remediation(v["alarms"], v["elements"], v["reasoning"], v["memory"], v["runbooks"], None, MIN_ALARMS, LOOKBACK_H, CHAIN_TUNING)
    acc = r.patterns.select(F.element_at("source_refs", 1).alias("incident_ref"), F.col("accepted").alias("pattern_accepted"))
    named = F.array_join(F.transform("similar_patterns", lambda s: F.concat(s["id"].cast("string"), F.lit(":"), F.round(s["similarity"], 4).cast("string"))), ",")
    return r.decisions.join(acc, "incident_ref", "left").select(
        "incident_ref", "element_id", "subcategory", "system_context", "context_budget", "t4_prior_status", "t5_semantic_tokens", "path", "matched_id", "reason",
        "chosen_runbook", "steps", "top_runbook_similarity", "new_status", "confidence", named.alias("similar_patterns"), "action", "pattern_accepted")
