"""Batch remediation (D18) of all open incidents, best runbook (J6) and the
remediation checkpoints (D14).

`remediate` answers with decisions from the incidents' stored vectors; `remediate_in_context`
is the whole chain of one incident (D11 context, text recall, similar patterns, steps, actions)
for all of them, and `triage_to_remediation` starts it from raw alarms.

One batch reads memory and runbooks as they were at batch start (decision:
the reference lets each incident see the previous one's write-back).  The
incident vector is the query vector, computed once and reused by the
context, routing and runbook recall.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, Tuning
from ..functions.scalar import empty_text, fmt2
from .alarms import Triage, correlate_alarms
from .common import as_of_col, stored
from .context import TIERS, assemble_context
from .encoder import DEFAULT_DIM, embed_backfill, hashing_encode
from .memory import apply_runbook_outcomes, recall_runbooks, recall_similar, route, write_gate


def best_runbook(queries: DataFrame, runbooks: DataFrame, tuning: Tuning = DEFAULT_TUNING, *,
                 query_id: str = "query_id") -> DataFrame:
    """Nearest active runbook per query (similarity 0 when none) and
    whether it clears the relevance floor."""
    top = recall_runbooks(queries, runbooks, 1, query_id=query_id).select(
        "query_id", F.col("id").alias("runbook_id"), "title", "steps", "similarity")
    q = queries.select(F.col(query_id).alias("query_id")).distinct()
    j = q.join(top, "query_id", "left")
    sim = F.coalesce(F.col("similarity"), F.lit(0.0))
    return j.select("query_id", "runbook_id", "title", "steps", sim.alias("similarity"),
                    (F.col("runbook_id").isNotNull() & (sim >= tuning.runbook_relevance_floor)).alias("applies"))


@dataclass
class Remediation:
    decisions: DataFrame
    checkpoints: DataFrame
    patterns: DataFrame
    runbooks: DataFrame
    incident_status: DataFrame


def remediate(incidents: DataFrame, memory: DataFrame, runbooks: DataFrame, tuning: Tuning = DEFAULT_TUNING,
              auto_resolve: bool = True) -> Remediation:
    """D18 for every open incident: route from the 3 nearest active patterns,
    apply the nearest runbook when it clears the floor (resolved, success
    outcome, pattern offered to the write gate), else investigate.  Without
    `auto_resolve` nothing is resolved, so no pattern and no outcome arises.  Incidents
    without a vector column (as triage returns them) are encoded first."""
    open_inc = with_signatures(incidents.filter(F.col("status") == "open"))
    q = open_inc.select(F.col("incident_ref").alias("query_id"), F.col("signature_vec").alias("query_vec"))
    matches = recall_similar(q, memory, 3)
    r = route(q, matches, tuning).select("query_id", "path", "matched_id")
    rb = best_runbook(q, runbooks, tuning).withColumnRenamed("title", "rb_title").drop("steps")
    j = (open_inc.join(r, open_inc["incident_ref"] == r["query_id"], "left").drop("query_id")
         .join(rb, open_inc["incident_ref"] == rb["query_id"], "left").drop("query_id"))
    return _outputs(stored(_decisions(j, auto_resolve), "decisions"), runbooks, tuning, auto_resolve)


def with_signatures(incidents: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """Incidents with `signature_vec`: the stored one, or the encoder's vector of the banded text (D19, D20) where it is missing."""
    known = incidents if "signature_vec" in incidents.columns else incidents.withColumn("signature_vec", F.lit(None).cast("array<double>"))
    return known if known is incidents else embed_backfill(known, "incidents", dim)[0]


def _decisions(j: DataFrame, auto_resolve: bool, *more) -> DataFrame:
    """One row per open incident from its joined route and nearest runbook; `more`: further columns of `j`."""
    anom = F.col("anomaly_score").cast("double")
    conf_in = F.when(anom.isNotNull() & (anom != 0), anom).otherwise(F.lit(0.6))
    confidence = F.least(F.lit(0.95), F.lit(0.5) + conf_in / 2)
    chosen = F.coalesce(F.col("applies"), F.lit(False))
    anom_txt = F.coalesce(F.format_string("%.3f", anom), F.lit("None"))
    return j.select(
        "incident_ref", "element_id", "subcategory", "path", "matched_id",
        F.when(chosen, F.col("runbook_id")).alias("chosen_runbook_id"),
        F.when(chosen, F.col("rb_title")).alias("chosen_runbook"),
        F.round(F.col("similarity"), 3).alias("top_runbook_similarity"),
        F.when(chosen, F.lit("confirmed")).otherwise(F.lit("escalated")).alias("resolution"),
        F.when(chosen & F.lit(auto_resolve), F.lit("resolved")).otherwise(F.lit("investigating")).alias("new_status"),
        confidence.alias("confidence"),
        F.concat(F.lit("Incident "), F.col("incident_ref"), F.lit(" on "), F.coalesce("element_id", F.lit("None")),
                 F.lit(": "), F.coalesce("subcategory", F.lit("None")), F.lit(" sev="), F.coalesce("severity", F.lit("None")),
                 F.lit(" anomaly="), anom_txt).alias("observation"),
        F.when(chosen, F.concat(F.lit("Apply runbook '"), F.coalesce("rb_title", F.lit("None")), F.lit("'")))
        .otherwise(F.lit("No matching runbook; escalate for manual investigation")).alias("hypothesis"),
        F.when(chosen & F.lit(auto_resolve), F.concat(F.coalesce("subcategory", F.lit("None")), F.lit(" on element resolved by runbook '"),
                                F.coalesce("rb_title", F.lit("None")), F.lit("' (anomaly "), anom_txt, F.lit(").")))
        .alias("pattern_content"),
        *more,
    )


def _outputs(decisions: DataFrame, runbooks: DataFrame, tuning: Tuning, auto_resolve: bool) -> Remediation:
    """Checkpoints, gated patterns, runbook outcomes and statuses of a batch of decisions."""
    checkpoints = decisions.select(
        F.concat(F.lit("remediation-"), F.col("incident_ref")).alias("session_id"), "incident_ref", "element_id",
        "observation", "hypothesis", "resolution", "confidence")
    offered = decisions.filter(F.col("pattern_content").isNotNull()).select(
        F.col("pattern_content").alias("content"), F.lit("pattern").alias("category"), F.lit("global").alias("scope"),
        "confidence", F.array(F.col("incident_ref")).alias("source_refs"))
    patterns = write_gate(offered, tuning)
    outcomes = decisions.filter(F.col("chosen_runbook_id").isNotNull()).select(
        F.col("chosen_runbook_id").alias("runbook_id"), F.lit(True).alias("succeeded"))
    new_runbooks = apply_runbook_outcomes(runbooks, outcomes) if auto_resolve else runbooks
    status = decisions.select("incident_ref", F.col("new_status").alias("status"))
    return Remediation(decisions, checkpoints, patterns, new_runbooks, status)


def recall_text():
    """Query text of an incident: subcategory and title, else the description, else its reference."""
    text = F.trim(F.concat(empty_text("subcategory"), F.lit(" "), empty_text("title")))
    return F.coalesce(*[F.when(F.length(t) > 0, t) for t in (text, empty_text("description"))], F.col("incident_ref"))


def route_reason(tuning: Tuning):
    """Why `route` chose its path, from its own columns."""
    total, passing = F.col("n_matches").cast("string"), F.col("n_passing").cast("string")
    gates = f" matches passed gates (conf≥{tuning.routing_confidence_gate}, sim≥{tuning.routing_similarity_gate}); chose mem "
    return (F.when(F.col("n_matches") == 0, F.lit("no semantic-memory matches (cold start)"))
            .when(F.col("matched_id").isNull(), F.concat(F.lit("scanned "), total, F.lit(" matches; none passed both gates")))
            .otherwise(F.concat(passing, F.lit("/"), total, F.lit(gates), F.col("matched_id").cast("string"), F.lit(" (conf="),
                                fmt2("matched_confidence"), F.lit(", sim="), fmt2("matched_similarity"), F.lit(") — substrate-driven shortcut"))))


def remediate_in_context(incidents: DataFrame, elements: DataFrame, alarms: DataFrame, reasoning: DataFrame, memory: DataFrame,
                         runbooks: DataFrame, as_of=None, tuning: Tuning = DEFAULT_TUNING, auto_resolve: bool = True, *,
                         similar: int = 5, dim: int = DEFAULT_DIM, encoder=None) -> Remediation:
    """The whole of D18 for every open incident.

    Each incident asks with the vector of its own text (`recall_text`), encoded in this job (`encoder` as in
    `embed_backfill`).  Its nearest patterns are found once: the first 3 feed the context (D11) and the route (D12),
    all `similar` of them are returned.  The decisions are stored; checkpoints, patterns, runbook outcomes and
    statuses are derived from the stored rows, so no output computes them again.

    Decisions carry, beside the columns of `remediate`: system_context, context_budget, tokens and status per tier,
    reason, steps, similar_patterns (array of id, similarity, content; nearest first) and action.  An incident whose
    text has no token has no vector: no matches, no runbook, escalated."""
    open_inc = incidents.filter(F.col("status") == "open").withColumn("_text", recall_text())
    enc = encoder or (lambda d, i, t: hashing_encode(d, i, t, dim, "_vec"))
    vectors = enc(open_inc.select("incident_ref", "_text"), "incident_ref", "_text")
    vectors = vectors.withColumnRenamed(next(c for c in vectors.columns if c != "incident_ref"), "_vec")
    open_inc = stored(open_inc.join(vectors, "incident_ref"), "open-incidents")
    q = open_inc.select(F.col("incident_ref").alias("query_id"), F.col("_vec").alias("query_vec"))
    near = stored(recall_similar(q, memory, max(similar, 3)), "similar-patterns")
    matches = near.filter("rank <= 3")
    ents = open_inc.select(F.col("incident_ref").alias("key"), F.col("element_id").alias("entity_ref"),
                           F.concat(F.lit("remediation-"), "incident_ref").alias("session_id"), F.col("_vec").alias("query_vec"))
    tiers = [f"{t}_{x}" for t in TIERS for x in ("tokens", "status")]
    ctx = assemble_context(ents, elements, incidents, alarms, reasoning, memory, as_of, tuning, matches).select(
        F.col("key").alias("incident_ref"), "system_context",
        F.concat(F.col("budget_used").cast("string"), F.lit("/"), F.col("budget_total").cast("string")).alias("context_budget"), *tiers)
    r = route(q, matches, tuning).withColumn("reason", route_reason(tuning)).select(F.col("query_id").alias("incident_ref"), "path", "matched_id", "reason")
    rb = best_runbook(q, runbooks, tuning).withColumnsRenamed({"title": "rb_title", "query_id": "incident_ref"})
    listed = (near.filter(F.col("rank") <= similar).groupBy(F.col("query_id").alias("incident_ref"))       # at most `similar` rows each
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity", "content"))),
                               lambda s: F.struct(s["id"].alias("id"), s["similarity"].alias("similarity"), s["content"].alias("content"))).alias("similar_patterns")))
    j = open_inc.join(ctx, "incident_ref", "left").join(r, "incident_ref", "left").join(rb, "incident_ref", "left").join(listed, "incident_ref", "left")
    chosen, floor = F.coalesce("applies", F.lit(False)), str(tuning.runbook_relevance_floor)
    action = (F.when(chosen & F.lit(auto_resolve), F.concat(F.lit("recorded success for runbook "), F.col("runbook_id").cast("string")))
              .when(chosen, F.concat(F.lit("runbook '"), empty_text("rb_title"), F.lit("' proposed, not applied")))
              .when(F.col("runbook_id").isNull(), F.lit("no runbooks in memory — escalating"))
              .otherwise(F.concat(F.lit("nearest runbook similarity "), fmt2("similarity"), F.lit(f" < floor {floor} — no relevant runbook, escalating"))))
    decisions = _decisions(j, auto_resolve, "system_context", "context_budget", *tiers, "reason", F.when(chosen, F.col("steps")).alias("steps"),
                           F.coalesce("similar_patterns", F.array().cast("array<struct<id:bigint,similarity:double,content:string>>")).alias("similar_patterns"),
                           action.alias("action"))
    return _outputs(stored(decisions, "decisions"), runbooks, tuning, auto_resolve)


def triage_to_remediation(alarms: DataFrame, elements: DataFrame, reasoning: DataFrame, memory: DataFrame, runbooks: DataFrame, as_of=None,
                          min_alarms: int = 5, lookback_hours: int = 6, tuning: Tuning = DEFAULT_TUNING,
                          auto_resolve: bool = True) -> tuple[Triage, Remediation]:
    """Alarm to incident to fix in one batch: D1, vectors of the new incidents (D20), then D18 over them.

    The context sees the incidents of this triage and its checkpoints beside the given `reasoning`."""
    now = as_of_col(as_of, alarms, "ts")
    t = correlate_alarms(alarms, now, min_alarms, lookback_hours, tuning).materialize()
    t.incidents = stored(with_signatures(t.incidents), "triaged")
    # episodic confidence is kept to two decimals
    checkpoints = t.checkpoints.withColumns({"created_at": now, "confidence": F.round("confidence", 2)})
    episodes = reasoning.unionByName(checkpoints, allowMissingColumns=True)
    return t, remediate_in_context(t.incidents, elements, alarms, episodes, memory, runbooks, now, tuning, auto_resolve)


def write_remediation(r: Remediation, incidents: DataFrame, base: str, version: int, as_of=None) -> dict:
    """D18 write-back, as writer `remediation` of stored tables under `base`: incident
    status (S4; only the dates of the decided incidents), the runbook table with outcomes
    (D15), the checkpoints and accepted patterns (S5, write control D13).  New rows carry
    an id (a hash of content and version), created_at, and patterns a vector and their source
    incidents, so they can be recalled.  A replay changes nothing."""
    from ..sources.store import Store
    from ..sources.tables import append_batch, update_columns, upsert_into, write_snapshot
    from .memory import gated_patterns
    now = as_of if as_of is not None else F.current_timestamp()
    root, writer = base.rstrip("/"), "remediation"
    spark = incidents.sparkSession
    decided = incidents.join(r.incident_status.select("incident_ref"), "incident_ref", "left_semi")
    changed = update_columns(decided, r.incident_status, ["incident_ref"], ["status"])
    store = Store(spark, f"{root}/incidents")
    if "window_start" in incidents.columns:
        upsert_into(store, changed, ["incident_ref"], ["status"], "window_start", writer, version)
    else:                                    # undated incidents: the whole table is the unit
        before = store.read()
        store.overwrite(update_columns(incidents if before is None else before, r.incident_status, ["incident_ref"], ["status"]), writer, version)
    write_snapshot(r.runbooks, f"{root}/runbook_memory", version, writer)
    checkpoints = r.checkpoints.withColumns({"id": row_id("session_id", version), "created_at": as_of_col(now)})
    append_batch(checkpoints, f"{root}/agent_reasoning", version, writer)
    accepted = gated_patterns(r.patterns.filter("accepted").drop("accepted"), now).withColumns(
        {"id": row_id(F.concat_ws("|", "content", F.array_join("source_refs", ",")), version), "created_at": as_of_col(now)})
    vectors = hashing_encode(accepted, "id", "content", out="memory_vec")
    append_batch(accepted.join(vectors, "id"), f"{root}/incident_memory_new", version, writer)
    return {name: f"{root}/{name}" for name in ("incidents", "runbook_memory", "agent_reasoning", "incident_memory_new")}


def row_id(what, version: int):
    """A repeatable positive id for a new row of one batch."""
    return F.xxhash64(what, F.lit(int(version))).bitwiseAND(F.lit((1 << 62) - 1))
