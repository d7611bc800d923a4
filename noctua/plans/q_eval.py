"""Text -> vector and evaluation jobs: banding, embedding backfill, labelled
set, evaluation, sweep and latency summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, SWEEP_GRID
from ..functions.text import band_text
from ..operators import encoder as E
from ..operators import evaluation as EV
from ..session import scratch_path
from ..sources.fixtures import table, view, with_views
from ..sources.tables import load_labelled, save_labelled
from .catalog import query
from .q_vectors import _BM25_STATS, _BM25_TERM

_STRIP = "'^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


_TICKET_BAND = _strip("'ticket category=None/' || coalesce(subcategory, 'None') || ' priority=' || coalesce(priority, 'None')"
                      " || ' region=' || coalesce(region, 'None') || '. ' || coalesce(summary, '') || '. '"
                      " || coalesce(description, '') || '. resolution: '")


@query("band_text", with_views(["v_tickets_text", "v_memory", "v_runbooks", "v_reasoning", "v_incidents"], f"""
SELECT 'tickets' AS table_name, cast(ticket_id AS varchar) AS row_id, {_TICKET_BAND} AS band_text FROM v_tickets_text
UNION ALL
SELECT 'incident_memory', cast(id AS varchar), {_strip("'[' || coalesce(category, 'None') || '] ' || coalesce(content, '')")} FROM v_memory
UNION ALL
SELECT 'runbook_memory', cast(id AS varchar), {_strip("'runbook ' || coalesce(title, 'None') || ' :: trigger: ' || coalesce(trigger_condition, '') || '. steps: ' || coalesce(steps, '')")} FROM v_runbooks
UNION ALL
SELECT 'agent_reasoning', cast(id AS varchar), {_strip("'observation: ' || coalesce(observation, '') || '. hypothesis: ' || coalesce(hypothesis, '') || '. resolution: ' || coalesce(resolution, '')")} FROM v_reasoning
UNION ALL
SELECT 'incidents', incident_ref, {_strip("'incident severity=' || coalesce(severity, 'None') || ' category=None/' || coalesce(subcategory, 'None') || ' element=' || coalesce(element_id, 'None') || ' site=None alarms=' || coalesce(cast(alarm_count AS varchar), 'None') || ' anomaly=' || coalesce(printf('%.3f', anomaly_score), 'None') || ' breakdown= ' || coalesce(title, '') || '. '")} FROM v_incidents"""))
def q_band_text(spark, sf_dir):
    parts = [
        ("tickets", view(spark, sf_dir, "v_tickets_text"), "ticket_id"),
        ("incident_memory", view(spark, sf_dir, "v_memory"), "id"),
        ("runbook_memory", view(spark, sf_dir, "v_runbooks"), "id"),
        ("agent_reasoning", view(spark, sf_dir, "v_reasoning"), "id"),
        ("incidents", view(spark, sf_dir, "v_incidents"), "incident_ref"),
    ]
    out = None
    for table, df, key in parts:
        b = band_text(df, table).select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_id"),
                                        "band_text")
        out = b if out is None else out.unionByName(b)
    return out


@query("embed_backfill", with_views(["v_tickets_text"], f"""
WITH todo AS (SELECT ticket_id, {_TICKET_BAND} AS txt FROM v_tickets_text WHERE embedding IS NULL),
toks AS (SELECT ticket_id, unnest(list_filter(regexp_split_to_array(lower(txt), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM todo),
h AS (SELECT ticket_id, md5(t) AS m FROM toks),
b AS (SELECT ticket_id, cast(('0x' || substr(m, 1, 8))::BIGINT % 64 AS INTEGER) AS dim_index,
             CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM h),
pb AS (SELECT ticket_id, dim_index, cast(sum(s) AS DOUBLE) AS v FROM b GROUP BY 1, 2),
nrm AS (SELECT ticket_id, sqrt(sum(v * v)) AS n FROM pb GROUP BY 1)
SELECT nrm.ticket_id, g.dim_index, round(cast(cast(coalesce(pb.v, 0e0) / nrm.n AS FLOAT) AS DOUBLE), 6) AS value
FROM nrm CROSS JOIN (SELECT cast(range AS INTEGER) AS dim_index FROM range(64)) g
LEFT JOIN pb ON pb.ticket_id = nrm.ticket_id AND pb.dim_index = g.dim_index
WHERE nrm.n > 0"""))
def q_embed_backfill(spark, sf_dir):
    t = view(spark, sf_dir, "v_tickets_text")
    _, filled = E.embed_backfill(t, "tickets", 64)
    return (filled.filter(F.col("embedding").isNotNull())
            .select("ticket_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim_index", "value"))
            .select("ticket_id", F.col("dim_index").cast("int").alias("dim_index"), F.round("value", 6).alias("value")))


_ITEMS = f"""
items AS (SELECT ticket_id AS query_id, subcategory AS true_subcat, cast(embedding AS DOUBLE[]) AS v,
                 {_strip("coalesce(summary, 'None') || '. ' || coalesce(description, '')")} AS qtext
          FROM (SELECT *, row_number() OVER (PARTITION BY subcategory ORDER BY md5('7:' || cast(ticket_id AS varchar)), ticket_id) AS r
                FROM v_tickets_text WHERE subcategory IS NOT NULL AND embedding IS NOT NULL) WHERE r <= 4)"""


@query("eval_set", with_views(["v_tickets_text"], "WITH " + _ITEMS + """
SELECT query_id AS ticket_id, qtext AS text, true_subcat FROM items"""))
def q_eval_set(spark, sf_dir):
    return EV.eval_set(view(spark, sf_dir, "v_tickets_text"), 4, 7).drop("query_vec")


def encoded_sql(source: str, key: str, text: str, out: str) -> str:
    """CTE `out` (key, v): the hashed vector of every row of CTE `source` that has tokens."""
    return f"""
{out}_b AS (SELECT {key}, cast(('0x' || substr(m, 1, 8))::BIGINT % 64 AS INTEGER) AS d, CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END AS s
  FROM (SELECT {key}, md5(unnest(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda x: x <> ''))) AS m FROM {source})),
{out}_p AS (SELECT {key}, d, cast(sum(s) AS DOUBLE) AS x FROM {out}_b GROUP BY 1, 2),
{out} AS (SELECT n.{key}, list(coalesce(p.x, 0e0) / n.norm ORDER BY g.d) AS v
  FROM (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {out}_p GROUP BY 1) n CROSS JOIN (SELECT cast(range AS INTEGER) AS d FROM range(64)) g
  LEFT JOIN {out}_p p ON p.{key} = n.{key} AND p.d = g.d WHERE n.norm > 0 GROUP BY 1)"""


def _eval_sql(settings: str, items: str = _ITEMS, not_own: str = "doc_id <> query_id") -> str:
    """Evaluation over a settings table (knob, value, alpha, sg, fl)."""
    return "WITH " + items + ",\n" + _BM25_STATS + f""",
settings AS (SELECT * FROM (VALUES {settings}) AS s(knob, value, alpha, sg, fl)),
c AS (SELECT ticket_id AS doc_id, cast(embedding AS DOUBLE[]) AS v FROM v_tickets_text WHERE embedding IS NOT NULL),
cand AS (SELECT * FROM (SELECT i.query_id, c.doc_id, list_cosine_similarity(i.v, c.v) AS sim,
          row_number() OVER (PARTITION BY i.query_id ORDER BY list_cosine_similarity(i.v, c.v) DESC, c.doc_id) AS vec_rank
          FROM items i CROSS JOIN c) WHERE vec_rank <= 16),
qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id,
       unnest(list_filter(regexp_split_to_array(lower(qtext), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM items)),
ft AS (SELECT c.query_id, c.doc_id, sum({_BM25_TERM}) AS score
       FROM cand c JOIN qt ON c.query_id = qt.query_id JOIN tf ON tf.doc_id = c.doc_id AND tf.term = qt.term
       JOIN df ON df.term = qt.term JOIN dl ON dl.doc_id = c.doc_id CROSS JOIN stats GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(ft.score, 0e0) AS raw FROM cand c LEFT JOIN ft USING (query_id, doc_id)),
nz AS (SELECT *, raw / CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN max(raw) OVER (PARTITION BY query_id) ELSE 1e0 END AS ftn FROM j),
alphas AS (SELECT DISTINCT alpha FROM settings),
h AS (SELECT nz.*, a.alpha, round(a.alpha * sim + (1 - a.alpha) * ftn, 4) AS hs FROM nz CROSS JOIN alphas a),
r1 AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY hs DESC, vec_rank) AS rk FROM h),
r2 AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY rk) AS rank FROM r1 WHERE {not_own}),
hits AS (SELECT r2.alpha, r2.query_id, r2.rank, t.subcategory AS label, i.true_subcat
         FROM r2 JOIN v_tickets_text t ON t.ticket_id = r2.doc_id JOIN items i ON i.query_id = r2.query_id WHERE r2.rank <= 10),
per AS (SELECT alpha, query_id, count(*) AS n_ret, count(*) FILTER (WHERE label = true_subcat) AS n_match,
               min(CASE WHEN label = true_subcat THEN rank END) AS first_hit FROM hits GROUP BY 1, 2),
votes AS (SELECT alpha, query_id, label, count(*) AS votes, min(rank) AS best FROM hits GROUP BY 1, 2, 3),
mode AS (SELECT alpha, query_id, label AS mode_label FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY votes DESC, best) AS lr
         FROM votes) WHERE lr = 1),
qual AS (SELECT a.alpha, i.query_id, CASE WHEN p.n_ret > 0 THEN p.n_match / p.n_ret ELSE 0e0 END AS prec,
                CASE WHEN p.first_hit IS NOT NULL THEN 1e0 / p.first_hit ELSE 0e0 END AS rr,
                coalesce(m.mode_label = i.true_subcat, false) AS top1
         FROM items i CROSS JOIN alphas a LEFT JOIN per p ON p.alpha = a.alpha AND p.query_id = i.query_id
         LEFT JOIN mode m ON m.alpha = a.alpha AND m.query_id = i.query_id),
mem AS (SELECT * FROM v_memory WHERE status = 'active' AND superseded_by IS NULL AND memory_vec IS NOT NULL),
mm AS (SELECT * FROM (SELECT i.query_id, mem.id, mem.confidence, list_cosine_similarity(i.v, mem.memory_vec) AS sim,
        row_number() OVER (PARTITION BY i.query_id ORDER BY list_cosine_similarity(i.v, mem.memory_vec) DESC, mem.id) AS rank
        FROM items i CROSS JOIN mem) WHERE rank <= 3),
rb AS (SELECT * FROM v_runbooks WHERE status = 'active' AND superseded_by IS NULL AND runbook_vec IS NOT NULL),
rt AS (SELECT * FROM (SELECT i.query_id, list_cosine_similarity(i.v, cast(rb.runbook_vec AS DOUBLE[])) AS sim,
        row_number() OVER (PARTITION BY i.query_id ORDER BY list_cosine_similarity(i.v, cast(rb.runbook_vec AS DOUBLE[])) DESC, rb.id) AS rank
        FROM items i CROSS JOIN rb) WHERE rank = 1),
outc AS (SELECT s.knob, s.value, i.query_id,
                EXISTS (SELECT 1 FROM mm WHERE mm.query_id = i.query_id AND coalesce(mm.confidence, 0) >= 0.85e0
                        AND coalesce(mm.sim, 0) >= s.sg) AS shortcut,
                coalesce(rt.sim, 0e0) < s.fl AS escalate
         FROM settings s CROSS JOIN items i LEFT JOIN rt ON rt.query_id = i.query_id)
SELECT s.knob, s.value, count(*) AS n_items,
       round(avg(cast(q.top1 AS DOUBLE)), 3) AS classification_top1_accuracy, round(avg(q.prec), 3) AS rerank_precision_at_k,
       round(avg(q.rr), 3) AS rerank_mrr, round(avg(cast(o.shortcut AS DOUBLE)), 3) AS shortcut_rate,
       round(avg(cast(o.escalate AS DOUBLE)), 3) AS escalation_rate
FROM settings s JOIN qual q ON q.alpha = s.alpha JOIN outc o ON o.knob = s.knob AND o.value = s.value AND o.query_id = q.query_id
GROUP BY 1, 2"""


def _settings_values() -> str:
    rows = []
    for knob, values in SWEEP_GRID.items():
        for v in values:
            alpha = v if knob == "alpha" else 0.7
            sg = v if knob == "routing_similarity_gate" else 0.55
            fl = v if knob == "runbook_relevance_floor" else 0.45
            rows.append(f"('{knob}', {v}e0, {alpha}e0, {sg}e0, {fl}e0)")
    return ", ".join(rows)


def _tables(spark, sf_dir):
    t = view(spark, sf_dir, "v_tickets_text")
    return t, EV.eval_set(t, 4, 7), view(spark, sf_dir, "v_memory"), view(spark, sf_dir, "v_runbooks")


@query("evaluate", with_views(["v_tickets_text", "v_memory", "v_runbooks"], _eval_sql("('default', 0.7e0, 0.7e0, 0.55e0, 0.45e0)")))
def q_evaluate(spark, sf_dir):
    t, items, mem, rb = _tables(spark, sf_dir)
    e = EV.evaluate(items, t, mem, rb, k=10, alpha=0.7)
    return e.select(F.lit("default").alias("knob"), F.lit(0.7).alias("value"), "n_items", "classification_top1_accuracy",
                    "rerank_precision_at_k", "rerank_mrr", "shortcut_rate", "escalation_rate")


_LABELLED = _ITEMS.replace("items AS", "sampled AS", 1) + """,
raw AS (SELECT CASE WHEN query_id % 3 = 0 THEN NULL ELSE cast(query_id AS varchar) END AS self_id, qtext, true_subcat FROM sampled
  UNION ALL SELECT NULL, qtext, true_subcat FROM sampled WHERE query_id % 3 = 0
  UNION ALL SELECT NULL, text, 'L' || cast(item_id % 5 AS varchar) FROM benchmark),
numbered AS (SELECT row_number() OVER () AS query_id, * FROM raw),""" + encoded_sql("numbered", "query_id", "qtext", "enc") + """,
items AS (SELECT n.*, enc.v FROM numbered n JOIN enc USING (query_id))"""


@query("evaluate_labelled", with_views(["v_tickets_text", "v_memory", "v_runbooks"], _eval_sql(
    "('labelled', 0.7e0, 0.7e0, 0.3e0, 0.25e0)", _LABELLED,
    "cast(doc_id AS varchar) IS DISTINCT FROM (SELECT self_id FROM items i WHERE i.query_id = r1.query_id)")))
def q_evaluate_labelled(spark, sf_dir):
    """A labelled file through S6 and D22: sampled tickets (a third without their id, and those twice) and benchmark passages."""
    t, sampled, mem, rb = _tables(spark, sf_dir)
    nameless = F.col("ticket_id") % 3 == 0
    text = sampled.select(F.when(~nameless, F.col("ticket_id").cast("string")).alias("ticket_id"), "text", "true_subcat", nameless.alias("again"))
    bench = table(spark, sf_dir, "benchmark").select(F.lit(None).cast("string").alias("ticket_id"), "text",
                                                     F.concat(F.lit("L"), (F.col("item_id") % 5).cast("string")).alias("true_subcat"))
    path = scratch_path(spark, "labelled")
    save_labelled(text.drop("again").unionByName(text.filter("again").drop("again")).unionByName(bench), path)
    e = EV.evaluate_labelled(load_labelled(spark, path, lines=True), t, mem, rb, k=10, alpha=0.7,
                             tuning=DEFAULT_TUNING.with_(routing_similarity_gate=0.3, runbook_relevance_floor=0.25))
    return e.select(F.lit("labelled").alias("knob"), F.lit(0.7).alias("value"), "n_items", "classification_top1_accuracy",
                    "rerank_precision_at_k", "rerank_mrr", "shortcut_rate", "escalation_rate")


@query("sweep", with_views(["v_tickets_text", "v_memory", "v_runbooks"], _eval_sql(_settings_values())))
def q_sweep(spark, sf_dir):
    t, items, mem, rb = _tables(spark, sf_dir)
    return EV.sweep(items, t, mem, rb, k=10)


@query("latency_summary", """
SELECT event_type, count(value) AS n, round(avg(value), 1) AS mean_ms, round(quantile_cont(value, 0.5), 1) AS p50_ms,
       round(quantile_cont(value, 0.95), 1) AS p95_ms
FROM events GROUP BY event_type""")
def q_latency_summary(spark, sf_dir):
    return EV.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])


_REASONING_BAND = _strip("'observation: ' || coalesce(observation, '') || '. hypothesis: ' || coalesce(hypothesis, '')"
                         " || '. resolution: ' || coalesce(resolution, '')")


@query("embed_backfill_reasoning", with_views(["v_reasoning"], f"""
WITH todo AS (SELECT id, {_REASONING_BAND} AS txt FROM v_reasoning),
toks AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(txt), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM todo),
h AS (SELECT id, md5(t) AS m FROM toks),
b AS (SELECT id, cast(('0x' || substr(m, 1, 8))::BIGINT % 64 AS INTEGER) AS dim_index,
             CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM h),
pb AS (SELECT id, dim_index, cast(sum(s) AS DOUBLE) AS v FROM b GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(sum(v * v)) AS n FROM pb GROUP BY 1)
SELECT nrm.id, g.dim_index, round(cast(cast(coalesce(pb.v, 0e0) / nrm.n AS FLOAT) AS DOUBLE), 6) AS value
FROM nrm CROSS JOIN (SELECT cast(range AS INTEGER) AS dim_index FROM range(64)) g
LEFT JOIN pb ON pb.id = nrm.id AND pb.dim_index = g.dim_index
WHERE nrm.n > 0"""))
def q_embed_backfill_reasoning(spark, sf_dir):
    """Checkpoints carry no vector yet: every row is banded and encoded."""
    r = view(spark, sf_dir, "v_reasoning").withColumn("reasoning_vec", F.lit(None).cast("array<float>"))
    _, filled = E.embed_backfill(r, "agent_reasoning", 64)
    return (filled.filter(F.col("reasoning_vec").isNotNull())
            .select("id", F.posexplode(F.col("reasoning_vec").cast("array<double>")).alias("dim_index", "value"))
            .select("id", F.col("dim_index").cast("int").alias("dim_index"), F.round("value", 6).alias("value")))
