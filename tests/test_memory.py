import datetime as dt

import numpy as np
import pandas as pd

from noctua.config import DEFAULT_TUNING
from noctua.operators import memory as M
from noctua.operators.dedup import connected_components, consolidate_memory, greedy_clusters


def test_route_gates_inclusive_null_is_zero_and_tie_by_similarity(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    m = spark.createDataFrame([
        ("a", 1, 0.85, 0.55), ("a", 2, None, 0.99),
        ("b", 3, 0.90, 0.60), ("b", 4, 0.60, 0.90), ("b", 5, 0.90, 0.61),
    ], "query_id string, id long, confidence double, similarity double")
    r = {x.query_id: x for x in M.route(q, m, DEFAULT_TUNING).collect()}
    assert r["a"].path == "SHORTCUT" and r["a"].matched_id == 1 and r["a"].n_passing == 1
    assert r["b"].matched_id == 5 and r["b"].thinking_budget == 0 and r["b"].max_tool_rounds == 3
    assert r["c"].path == "EXPLORE" and r["c"].n_matches == 0 and r["c"].thinking_budget == 512


def test_decay_rules(spark):
    as_of = dt.datetime(2024, 3, 1)
    rows = [(1, "x", 0.9, as_of - dt.timedelta(days=3), None, "active", None),
            (2, "x", 0.2, as_of - dt.timedelta(days=40), None, "active", None),
            (3, "x", 0.9, as_of - dt.timedelta(days=300), as_of - dt.timedelta(days=30), "active", None),
            (4, "x", 0.9, as_of - dt.timedelta(days=30), None, "deprecated", None)]
    mem = spark.createDataFrame(rows, "id long, content string, confidence double, created_at timestamp_ntz, "
                                      "last_reinforced_at timestamp_ntz, status string, superseded_by long")
    out = {r.id: r for r in M.decay_memory(mem, as_of).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].action == "skip_grace" and out[2].action == "skip_floor"
    assert out[3].days_unreinforced == 30 and out[3].new_confidence == 0.45 and out[3].will_lose_routing


def test_first_outcome_replaces_prior(spark):
    rb = spark.createDataFrame([(7, 0, 0, 0.6), (8, 0, 0, 0.6)], "id long, success_count long, fail_count long, confidence double")
    oc = spark.createDataFrame([(7, True)], "runbook_id long, succeeded boolean")
    out = {r.id: r for r in M.apply_runbook_outcomes(rb, oc).collect()}
    assert out[7].confidence == 1.0 and out[7].success_count == 1 and out[8].confidence == 0.6


def test_write_gate(spark):
    p = spark.createDataFrame([(0.8,), (0.79,), (None,)], "confidence double")
    assert [r.accepted for r in M.write_gate(p).collect()] == [True, False, False]


def _plain_greedy(ids, conf, ev, vecs, thr):
    """Independent reference: the ledger's sequential pass over all rows."""
    live = {i: True for i in ids}
    sup, seen = {}, set()
    evc = dict(ev)
    for a in sorted(ids):
        if a in seen:
            continue
        dupes = []
        for b in ids:
            if b != a and live[b]:
                va, vb = vecs[a], vecs[b]
                if 1 - va @ vb / (np.linalg.norm(va) * np.linalg.norm(vb)) < thr:
                    dupes.append(b)
        if not dupes:
            continue
        cluster = [a] + dupes
        keep = max(cluster, key=lambda r: (conf[r], -r))
        total = sum(evc[r] for r in cluster)
        for r in cluster:
            if r != keep:
                sup[r] = keep
                live[r] = False
                seen.add(r)
        evc[keep] = total
        seen.add(keep)
    return sup, evc


def test_consolidate_equals_plain_greedy(spark):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(6, 5))
    rows, vecs, conf, ev = [], {}, {}, {}
    i = 0
    for c in centers:
        for _ in range(5):
            i += 1
            v = c + rng.normal(scale=0.25, size=5)
            vecs[i], conf[i], ev[i] = v, float(rng.choice([0.5, 0.7, 0.9])), int(rng.integers(1, 4))
            rows.append((i, v.tolist(), conf[i], ev[i], "active", None, dt.datetime(2024, 1, 1), None))
    mem = spark.createDataFrame(rows, "id long, memory_vec array<double>, confidence double, evidence_count long, "
                                      "status string, superseded_by long, created_at timestamp_ntz, last_reinforced_at timestamp_ntz")
    sup, evc = _plain_greedy(list(vecs), conf, ev, vecs, 0.15)
    assert sup, "fixture must contain duplicates"
    out = {r.id: r for r in consolidate_memory(mem, dt.datetime(2024, 2, 1)).collect()}
    for k in vecs:
        assert out[k].superseded_by == sup.get(k)
        assert out[k].status == ("superseded" if k in sup else "active")
        assert out[k].evidence_count == evc[k]


def test_greedy_is_not_connected_components(spark):
    # chain 1-2-3: anchor 1 takes {1,2}; 3 stays active (2 was superseded); NULL evidence counts as one
    nodes = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, None), (3, None, 1)], "id long, confidence double, evidence_count long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "id_a long, id_b long")
    out = {r.id: r for r in greedy_clusters(nodes, edges).collect()}
    assert out[2].superseded_by == 1 and out[3].superseded_by is None and out[1].evidence_count == 2


def test_greedy_clusters_of_many_links(spark, monkeypatch):
    """Long chains, dense groups and kept rows that later anchors meet; nothing is collected to be broadcast."""
    from noctua.operators import dedup
    rng = np.random.default_rng(2)
    n = 70
    edges = {(i, i + 1) for i in range(1, 9)} | {(i, j) for i in range(20, 32) for j in range(i + 1, 32) if rng.random() < 0.6}
    edges |= {tuple(sorted(map(int, rng.choice(np.arange(32, n), 2, replace=False)))) for _ in range(25)}
    conf, ev = {i: float(rng.choice([0.5, 0.7, 0.9])) for i in range(1, n)}, {i: int(rng.integers(1, 4)) for i in range(1, n)}
    near = {i: {a + b - i for a, b in edges if i in (a, b)} for i in range(1, n)}
    live, seen, sup, evc = set(conf), set(), {}, dict(ev)
    for a in sorted(conf):
        cluster = [] if a in seen else [a, *(near[a] & live)]
        if len(cluster) > 1:
            keep, total = max(cluster, key=lambda r: (conf[r], -r)), sum(evc[r] for r in cluster)
            sup |= {r: keep for r in cluster if r != keep}
            live -= set(cluster) - {keep}
            seen |= set(cluster)
            evc[keep] = total
    plans, write = [], dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    out = greedy_clusters(spark.createDataFrame([(i, conf[i], ev[i]) for i in conf], "id long, confidence double, evidence_count long"),
                          spark.createDataFrame(sorted(edges), "id_a long, id_b long")).collect()
    assert {r.id: (r.superseded_by, r.evidence_count) for r in out} == {i: (sup.get(i), evc[i]) for i in conf if near[i]}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_connected_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (4, 3)], "id_a long, id_b long")
    got = {r.id: r.component for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}


def test_apply_decay_updates_only_decayed_rows(spark):
    as_of = dt.datetime(2024, 3, 1)
    rows = [(1, "x", 0.9, as_of - dt.timedelta(days=3), None, "active", None),
            (3, "x", 0.9, as_of - dt.timedelta(days=300), as_of - dt.timedelta(days=30), "active", None)]
    mem = spark.createDataFrame(rows, "id long, content string, confidence double, created_at timestamp_ntz, "
                                      "last_reinforced_at timestamp_ntz, status string, superseded_by long")
    nxt = {r.id: r.confidence for r in M.apply_decay(mem, M.decay_memory(mem, as_of)).collect()}
    assert nxt == {1: 0.9, 3: 0.45}


def test_write_remediation(spark, tmp_out):
    from noctua.operators.remediate import remediate, write_remediation
    from noctua.sources.tables import read_batches, read_latest
    inc = spark.createDataFrame([("I1", "E1", "L1", "t", "major", 0.7, "open", [1.0, 0.0]),
                                 ("I2", "E2", "L2", "t", "major", 0.0, "open", [0.0, 1.0])],
                                "incident_ref string, element_id string, subcategory string, title string, severity string, "
                                "anomaly_score double, status string, signature_vec array<double>")
    mem = spark.createDataFrame([(1, "global", "pattern", "c", 0.9, 1, "active", None, [1.0, 0.0])],
                                "id long, scope string, category string, content string, confidence double, "
                                "evidence_count long, status string, superseded_by long, memory_vec array<double>")
    rb = spark.createDataFrame([(7, "reset", "t", "[]", 0.6, 0, 0, "active", None, [1.0, 0.05])],
                               "id long, title string, trigger_condition string, steps string, confidence double, "
                               "success_count long, fail_count long, status string, superseded_by long, runbook_vec array<double>")
    r = remediate(inc, mem, rb)
    paths = write_remediation(r, inc, tmp_out, 1, dt.datetime(2024, 1, 1))
    status = {x.incident_ref: x.status for x in read_latest(spark, f"{tmp_out}/incidents").collect()}
    assert status == {"I1": "resolved", "I2": "investigating"}
    rbn = read_latest(spark, f"{tmp_out}/runbook_memory").collect()[0]
    assert rbn.success_count == 1 and rbn.confidence == 1.0
    assert read_batches(spark, paths["agent_reasoning"]).count() == 2
    pats = read_batches(spark, paths["incident_memory_new"]).collect()
    assert len(pats) == 1 and pats[0].confidence == 0.85


def test_nothing_is_resolved_without_auto_resolve_and_last_used_moves(spark):
    from noctua.operators.remediate import remediate
    inc = spark.createDataFrame([("I1", "E1", "L1", "t", "major", 0.7, "open", [1.0, 0.0])],
                                "incident_ref string, element_id string, subcategory string, title string, severity string, "
                                "anomaly_score double, status string, signature_vec array<double>")
    mem = spark.createDataFrame([], "id long, scope string, category string, content string, confidence double, "
                                    "evidence_count long, status string, superseded_by long, memory_vec array<double>")
    rb = spark.createDataFrame([(7, "reset", "t", "[]", 0.6, 0, 0, "active", None, dt.datetime(2024, 1, 1), [1.0, 0.05])],
                               "id long, title string, trigger_condition string, steps string, confidence double, success_count long, "
                               "fail_count long, status string, superseded_by long, last_used timestamp_ntz, runbook_vec array<double>")
    r = remediate(inc, mem, rb, auto_resolve=False)
    assert r.patterns.count() == 0 and r.incident_status.first()["status"] == "investigating"
    at = dt.datetime(2024, 3, 1)
    out = spark.createDataFrame([(7, True, at), (7, False, dt.datetime(2023, 1, 1))], "runbook_id long, succeeded boolean, at timestamp_ntz")
    assert M.apply_runbook_outcomes(rb, out).first()["last_used"] == at


def test_vectors_of_another_width_do_not_break_a_block(spark):
    from noctua.operators.knn import knn_join
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, query_vec array<double>")
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)] + [(99, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    got = [(r.query_id, r.neighbour_id) for r in knn_join(q, c, 3, block_rows=7).orderBy("rank").collect()]
    assert got == [(1, 0), (1, 1), (1, 2)]                 # ties over blocks: smaller ids
