import datetime as dt

from pyspark.sql import functions as F

from noctua.config import DEFAULT_TUNING
from noctua.operators import remediate as RM
from noctua.operators.alarms import correlate_alarms
from noctua.operators.context import assemble_context
from noctua.operators.encoder import hashing_encode
from noctua.operators.ranking import nearest_patterns

T = dt.datetime(2024, 1, 10, 12, 0)


def _inputs(spark):
    elements = spark.createDataFrame([("NE-1", "S1", "router", "V", "M", "EU", "gold")],
                                     "element_id string, site_id string, element_type string, vendor string, model string, "
                                     "region string, criticality string")
    incidents = spark.createDataFrame([("INC-1", "NE-1", T, "major", "L1", 0.5, "open")],
                                      "incident_ref string, element_id string, window_start timestamp_ntz, severity string, "
                                      "subcategory string, anomaly_score double, status string")
    alarms = spark.createDataFrame([(1, "NE-1", T, "critical", "tempHigh")],
                                   "id long, element_id string, ts timestamp_ntz, severity string, alarm_type string")
    reasoning = spark.createDataFrame([(1, "S-1", "NE-1", T, "obs " * 60, None, "confirmed", 0.7)],
                                      "id long, session_id string, element_id string, created_at timestamp_ntz, observation string, "
                                      "hypothesis string, resolution string, confidence double")
    memory = spark.createDataFrame([(1, "global", "pattern", "c", 0.9, 1, "active", None, [1.0, 0.0])],
                                   "id long, scope string, category string, content string, confidence double, "
                                   "evidence_count long, status string, superseded_by long, memory_vec array<double>")
    ents = spark.createDataFrame([("k1", "NE-1", "S-1", [1.0, 0.0]), ("k2", "NE-9", None, None), ("k3", None, None, None)],
                                 "key string, entity_ref string, session_id string, query_vec array<double>")
    return ents, elements, incidents, alarms, reasoning, memory


def test_statuses_and_full_budget(spark):
    ents, *rest = _inputs(spark)
    out = {r.key: r for r in assemble_context(ents, *rest, as_of=T).collect()}
    k1 = out["k1"]
    assert k1.t1_entity_status == "ok" and k1.t2_recent_status == "ok" and k1.t3_active_status == "ok"
    assert k1.t5_semantic_status == "ok" and k1.top_match_id == 1 and k1.n_vector_matches == 1
    assert k1.budget_used == sum(x for x in [k1.t1_entity_tokens, k1.t2_recent_tokens, k1.t3_active_tokens,
                                             k1.t4_prior_tokens, k1.t5_semantic_tokens] if x)
    assert k1.system_context.startswith("[T1 element] NE-1 type=router vendor=V/M sw=None site=S1 region=EU crit=gold")
    assert "alarm critical tempHigh x1 (24h)" in k1.system_context
    assert out["k2"].t1_entity_status == "not_found" and out["k2"].t1_entity_tokens == 0
    assert out["k2"].t2_recent_status == "empty" and out["k2"].t3_active_status is None
    assert out["k3"].t1_entity_status == "no_entity" and out["k3"].t4_prior_status == "no_entity"
    assert out["k3"].budget_used == 0


def test_small_budget_skips_a_tier_but_tries_later_ones(spark):
    ents, *rest = _inputs(spark)
    full = {r.key: r for r in assemble_context(ents, *rest, as_of=T).collect()}["k1"]
    budget = full.t1_entity_tokens + full.t2_recent_tokens + full.t4_prior_tokens + full.t5_semantic_tokens
    r = {x.key: x for x in assemble_context(ents, *rest, as_of=T,
                                            tuning=DEFAULT_TUNING.with_(context_budget_tokens=budget)).collect()}["k1"]
    assert r.t3_active_tokens is None and r.t3_active_status is None  # skipped: no entry
    assert r.t4_prior_status == "ok" and r.t5_semantic_status == "ok"
    assert r.budget_used == budget and "[T3 active]" not in r.system_context


CHAIN_AT = dt.datetime(2024, 1, 2, 12)


def _chain_tables(spark):
    alarms = [(i, "E1", "S", CHAIN_AT, "critical", "sctpReset", "sctp_resets", 30.0, '{"sctp_resets": 30}') for i in range(6)]
    alarms += [(10 + i, "E2", None, CHAIN_AT, "minor", "unlisted", None, None, None) for i in range(5)] + [(20, "E3", "S", CHAIN_AT, "major", "tempHigh", None, None, None)]
    alarms = spark.createDataFrame(alarms, "id long, element_id string, site_id string, ts timestamp, severity string, alarm_type string, metric string, value double, metrics string")
    elements = spark.createDataFrame([("E1", "S", "router", "V", "M", "R", "gold")], "element_id string, site_id string, element_type string, vendor string, model string, region string, criticality string")
    reasoning = spark.createDataFrame([], "id long, session_id string, element_id string, created_at timestamp, observation string, hypothesis string, resolution string, confidence double")
    memory = spark.createDataFrame([(i, "Transport-SCTP-Flap on E1" if i < 3 else f"note {i}", 0.9 if i == 2 else 0.5) for i in range(1, 8)],
                                   "id long, content string, confidence double").withColumns(
        {"scope": F.lit("global"), "category": F.lit("pattern"), "evidence_count": F.lit(1), "status": F.lit("active"), "superseded_by": F.lit(None).cast("long")})
    runbooks = spark.createDataFrame([(1, "Transport SCTP flap")], "id long, title string").withColumns(
        {"trigger_condition": F.lit("x"), "steps": F.lit('["reset"]'), "scope": F.lit("global"), "confidence": F.lit(0.6), "success_count": F.lit(0),
         "fail_count": F.lit(0), "status": F.lit("active"), "superseded_by": F.lit(None).cast("long"), "last_used": F.lit(None).cast("timestamp")})
    return (alarms, elements, reasoning, memory.join(hashing_encode(memory, "id", "content", out="memory_vec"), "id"),
            runbooks.join(hashing_encode(runbooks, "id", "title", out="runbook_vec"), "id"))


def test_alarms_to_incidents_to_decisions(spark):
    triage, r = RM.triage_to_remediation(*_chain_tables(spark), CHAIN_AT, 5, 6)
    assert triage.incidents.filter("signature_vec IS NOT NULL").count() == 2
    got = {d.element_id: d for d in r.decisions.collect()}
    assert set(got) == {"E1", "E2"}
    d = got["E1"]
    assert (d.path, d.matched_id, d.chosen_runbook, d.steps, d.new_status) == ("SHORTCUT", 2, "Transport SCTP flap", '["reset"]', "resolved")
    assert d.reason.startswith("1/3 matches passed gates") and d.action == "recorded success for runbook 1"
    assert len(d.similar_patterns) == 5 and [s.id for s in d.similar_patterns][:2] == [1, 2]
    assert "[T1 element] E1" in d.system_context and "[T4 prior] confirmed" in d.system_context and d.t1_entity_status == "ok"
    assert got["E2"].new_status == "investigating" and got["E2"].action.startswith("nearest runbook similarity")
    assert got["E2"].t1_entity_status == "not_found"
    assert r.runbooks.first().success_count == 1 and r.patterns.count() == 1
    assert {(s.incident_ref, s.status) for s in r.incident_status.collect()} == {(x.incident_ref, x.new_status) for x in got.values()}


def test_chain_without_memory_or_alarms(spark):
    alarms, elements, reasoning, memory, runbooks = _chain_tables(spark)
    _, r = RM.triage_to_remediation(alarms, elements, reasoning, memory.limit(0), runbooks.limit(0), CHAIN_AT, 5, 6)
    for d in r.decisions.collect():
        assert d.reason == "no semantic-memory matches (cold start)" and d.action == "no runbooks in memory — escalating" and d.similar_patterns == []
    _, r = RM.triage_to_remediation(alarms.limit(0), elements, reasoning, memory, runbooks, CHAIN_AT, 5, 6)
    assert r.decisions.count() == r.checkpoints.count() == 0
    plain = RM.remediate(correlate_alarms(alarms, CHAIN_AT, 5, 6).incidents, memory, runbooks)
    assert plain.decisions.count() == 2                  # incidents without a vector column are encoded first


def test_nearest_catalog_patterns_of_a_text(spark):
    catalog = spark.createDataFrame([("P1", "link flap", "transport"), ("P2", "fan broken", "hardware"), ("P3", "", "power")],
                                    "pattern_id string, pattern_name string, category string")
    catalog = catalog.join(hashing_encode(catalog, "pattern_id", "pattern_name", out="signature_vec"), "pattern_id")
    asked = spark.createDataFrame([(1, "the fan broken"), (2, ""), (3, None)], "query_id long, text string")
    got = nearest_patterns(asked, catalog, 1).collect()
    assert [(r.query_id, r["rank"], r.pattern_id, r.category) for r in got] == [(1, 1, "P2", "hardware")]
    assert nearest_patterns(asked.limit(0), catalog).count() == 0
