import __spark_entry__ as entry


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"subcategory", "recent_avg_per_day", "baseline_mean", "baseline_stddev", "z_score", "verdict"}


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in set(q) - set(o) if n != "pipeline" and not n.startswith("op")}     # without the optional subpackage
    assert own == set()


def test_fast_queries_run_on_smoke_data(spark):
    q = entry.queries()
    for name in ["correlate_alarms", "hybrid_rerank", "assemble_context", "remediate", "evaluate"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_sweep_monotone_in_gates(spark):
    rows = entry.queries()["sweep"](spark, "/root/testdata/sf0.01").collect()
    by = {}
    for r in rows:
        by.setdefault(r.knob, []).append(r)
    sg = sorted(by["routing_similarity_gate"], key=lambda r: r.value)
    fl = sorted(by["runbook_relevance_floor"], key=lambda r: r.value)
    assert all(a.shortcut_rate >= b.shortcut_rate for a, b in zip(sg, sg[1:]))
    assert all(a.escalation_rate <= b.escalation_rate for a, b in zip(fl, fl[1:]))
    assert len(by["alpha"]) == 3 and all(r.n_items == rows[0].n_items for r in rows)
