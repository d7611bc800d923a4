"""Pattern memory custody: active filter (P1), recall of patterns (D9) and
runbooks (D10), routing (D12), write control (D13), runbook outcomes (D15)
and confidence decay (D17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, ROUTE_EXPLORE, ROUTE_SHORTCUT, Tuning
from ..functions.scalar import decay_factor
from .common import as_of_col
from .knn import knn_join


def active_only(df: DataFrame) -> DataFrame:
    """status = 'active' AND superseded_by IS NULL."""
    return df.filter((F.col("status") == "active") & F.col("superseded_by").isNull())


def recall_similar(queries: DataFrame, memory: DataFrame, k: int = 5, scope: str | None = None, *,
                   query_id="query_id", query_vec="query_vec") -> DataFrame:
    """The k active patterns nearest each query (optionally one scope)."""
    m = active_only(memory)
    if scope:
        m = m.filter(F.col("scope") == F.lit(scope))
    nn = knn_join(queries, m, k, query_id=query_id, query_vec=query_vec, corpus_id="id", corpus_vec="memory_vec")
    cols = m.select("id", "scope", "category", "content", "confidence", "evidence_count")
    return nn.join(cols, nn["neighbour_id"] == cols["id"]).drop("neighbour_id")


def recall_runbooks(queries: DataFrame, runbooks: DataFrame, k: int = 3, *,
                    query_id="query_id", query_vec="query_vec") -> DataFrame:
    """The k active runbooks nearest each query."""
    r = active_only(runbooks)
    nn = knn_join(queries, r, k, query_id=query_id, query_vec=query_vec, corpus_id="id", corpus_vec="runbook_vec")
    cols = r.select("id", "title", "trigger_condition", "steps", "confidence", "success_count", "fail_count")
    return nn.join(cols, nn["neighbour_id"] == cols["id"]).drop("neighbour_id")


def route(queries: DataFrame, matches: DataFrame, tuning: Tuning = DEFAULT_TUNING, *,
          query_id: str = "query_id") -> DataFrame:
    """SHORTCUT when any match passes both (inclusive) gates, else
    EXPLORE.  NULL confidence / similarity read 0; winner by conf*sim, then
    sim, then id."""
    cg, sg = tuning.routing_confidence_gate, tuning.routing_similarity_gate
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    sim = F.coalesce(F.col("similarity").cast("double"), F.lit(0.0))
    m = matches.select(F.col(query_id).alias("_q"), "id", conf.alias("_c"), sim.alias("_s"))
    stats = m.groupBy("_q").agg(F.count("*").alias("n_matches"),
                                F.count_if((F.col("_c") >= cg) & (F.col("_s") >= sg)).alias("n_passing"))
    w = Window.partitionBy("_q").orderBy((F.col("_c") * F.col("_s")).desc(), F.col("_s").desc(), F.col("id"))
    best = (m.filter((F.col("_c") >= cg) & (F.col("_s") >= sg))
            .withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("_q", F.col("id").alias("matched_id"), F.col("_c").alias("matched_confidence"),
                    F.col("_s").alias("matched_similarity")))
    q = queries.select(F.col(query_id).alias("_q")).distinct()
    j = q.join(stats, "_q", "left").join(best, "_q", "left")
    short = F.col("matched_id").isNotNull()
    return j.select(
        F.col("_q").alias(query_id),
        F.when(short, F.lit(ROUTE_SHORTCUT[0])).otherwise(F.lit(ROUTE_EXPLORE[0])).alias("path"),
        F.when(short, F.lit(ROUTE_SHORTCUT[1])).otherwise(F.lit(ROUTE_EXPLORE[1])).alias("thinking_budget"),
        F.when(short, F.lit(ROUTE_SHORTCUT[2])).otherwise(F.lit(ROUTE_EXPLORE[2])).alias("max_tool_rounds"),
        "matched_id", "matched_confidence", "matched_similarity",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.coalesce("n_passing", F.lit(0)).alias("n_passing"))


def write_gate(patterns: DataFrame, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """`accepted` = confidence >= floor (the rest is the rejected output)."""
    return patterns.withColumn("accepted", F.coalesce(F.col("confidence") >= tuning.write_control_min_confidence,
                                                      F.lit(False)))


def gated_patterns(patterns: DataFrame, as_of, tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """Accepted patterns as new memory rows (evidence 1, reinforced now)."""
    acc = write_gate(patterns, tuning).filter("accepted")
    return acc.select(
        "content", F.coalesce("category", F.lit("pattern")).alias("category"),
        F.coalesce("scope", F.lit("global")).alias("scope"), "confidence",
        F.lit(1).alias("evidence_count"), F.lit("active").alias("status"),
        F.lit(None).cast("bigint").alias("superseded_by"), as_of_col(as_of).alias("last_reinforced_at"),
        *[F.col("source_refs")] if "source_refs" in patterns.columns else [])


def runbook_tallies(outcomes: DataFrame) -> DataFrame:
    """Success / fail counts per runbook."""
    return (outcomes.groupBy("runbook_id")
            .agg(F.count_if(F.col("succeeded")).alias("successes"),
                 F.count_if(~F.col("succeeded")).alias("failures"),
                 *[F.max("at").alias("used_at")] if "at" in outcomes.columns else []))


def apply_runbook_outcomes(runbooks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add the tallies; confidence = round(s / greatest(s + f, 1), 2) for
    runbooks with outcomes (the first outcome replaces the prior).  A runbook
    table with `last_used` gets the latest outcome time (`at`), never an earlier one."""
    t = runbook_tallies(outcomes)
    j = runbooks.join(t, runbooks["id"] == t["runbook_id"], "left")
    s = F.col("success_count") + F.coalesce("successes", F.lit(0))
    f = F.col("fail_count") + F.coalesce("failures", F.lit(0))
    conf = F.when(F.col("runbook_id").isNotNull(), F.round(s / F.greatest(s + f, F.lit(1)), 2)).otherwise(F.col("confidence"))
    return j.select(*[s.cast("long").alias(c) if c == "success_count" else f.cast("long").alias(c) if c == "fail_count"
                      else conf.cast("double").alias(c) if c == "confidence"
                      else F.greatest("last_used", F.col("used_at").cast(runbooks.schema[c].dataType)).alias(c)
                      if c == "last_used" and "used_at" in t.columns else F.col(c) for c in runbooks.columns])


def decay_memory(memory: DataFrame, as_of=None, half_life_days: int = 30, grace_days: int = 7, floor: float = 0.30,
                 tuning: Tuning = DEFAULT_TUNING) -> DataFrame:
    """D17 plan for every active row: days since reinforcement (calendar),
    action (skip_grace / skip_floor / decay) and the decayed confidence."""
    m = active_only(memory)
    ref = F.coalesce("last_reinforced_at", "created_at")
    now = as_of_col(as_of, m.select(ref.alias("_t")), "_t")
    days = F.coalesce(F.datediff(F.to_date(now), F.to_date(ref)), F.lit(0)).cast("long")
    old = F.col("confidence").cast("double")
    new = F.round(F.col("old_confidence") * decay_factor(F.col("days_unreinforced"), half_life_days), 2)
    out = m.select("id", "content", old.alias("old_confidence"), days.alias("days_unreinforced"))
    action = (F.when(F.col("days_unreinforced") < grace_days, "skip_grace")
              .when(F.col("old_confidence") < floor, "skip_floor").otherwise("decay"))
    out = out.withColumn("action", action)
    dec = F.col("action") == "decay"
    return out.select("id", "days_unreinforced", "old_confidence", "action",
                      F.when(dec, new).alias("new_confidence"),
                      F.when(dec, new < tuning.routing_confidence_gate).alias("will_lose_routing"),
                      F.when(dec, F.substring("content", 1, 60)).alias("snippet"))


def apply_decay(memory: DataFrame, plan: DataFrame) -> DataFrame:
    """D17 with dry_run=False: next memory snapshot with the decayed
    confidences (S4); last_reinforced_at is untouched, so runs compound."""
    from ..sources.tables import update_columns
    changes = plan.filter(F.col("action") == "decay").select("id", F.col("new_confidence").alias("confidence"))
    return update_columns(memory, changes, ["id"], ["confidence"])
