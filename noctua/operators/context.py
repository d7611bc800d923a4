"""Context assembly under a token budget (D11) for a whole table of entities.

Each tier is a per-key DataFrame (element, session or query), built with the
lookups operators and joined to the entities; at most 5 + 5, 1, 4 and 3
lines per tier, so the per-entity `collect_list` is bounded.  The budget is
a fixed chain of column expressions: a tier is added when used + cost <=
budget, otherwise skipped while later tiers are still tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING, TIER_CAPS, Tuning
from ..functions.scalar import approx_tokens, empty_text, fmt2, none_text, truncate_tokens
from . import lookups as L
from .common import as_of_col
from .memory import recall_similar

TIERS = ["t1_entity", "t2_recent", "t3_active", "t4_prior", "t5_semantic"]


def _joined_lines(df: DataFrame, key: str, order: Column, line: Column, alias: str) -> DataFrame:
    return (df.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("_s"))
            .select(key, F.array_join(F.transform("_s", lambda s: s["l"]), " | ").alias(alias),
                    F.size("_s").alias(alias + "_n")))


def tier_texts(entities: DataFrame, elements: DataFrame, incidents: DataFrame, alarms: DataFrame,
               reasoning: DataFrame, memory: DataFrame, as_of=None, matches: DataFrame | None = None) -> DataFrame:
    """entities (key, entity_ref, session_id, query_vec) -> one row per key with
    the raw text, line count and status of every tier plus T5 matches.  `matches`: the
    3 nearest patterns per key (as `recall_similar` gives them) where the caller has them."""
    ents = entities.select("key", "entity_ref", "session_id", "query_vec")
    now = as_of_col(as_of, alarms, "ts")
    refs = ents.select("entity_ref").filter(F.col("entity_ref").isNotNull()).distinct()

    t1 = L.element_profile(refs, elements, "entity_ref").select("entity_ref", F.col("t1_text").alias("t1_raw"))

    inc_lines = L.recent_incidents(incidents.join(refs, incidents["element_id"] == refs["entity_ref"], "left_semi"), 5)
    inc_lines = inc_lines.select(
        F.col("element_id").alias("entity_ref"), F.col("rank").alias("o"),
        F.concat(F.lit("inc "), none_text("incident_ref"), F.lit(" "), none_text("severity"), F.lit("/"),
                 none_text("subcategory"), F.lit(" anom="),
                 F.coalesce(F.format_string("%.3f", F.col("anomaly_score").cast("double")), F.lit("None")),
                 F.lit(" "), none_text("status")).alias("l"))
    al = L.recent_alarms(alarms.join(refs, alarms["element_id"] == refs["entity_ref"], "left_semi"), now)
    al_lines = al.select(F.col("element_id").alias("entity_ref"), (F.col("rank") + 100).alias("o"),
                         F.concat(F.lit("alarm "), none_text("severity"), F.lit(" "), none_text("alarm_type"),
                                  F.lit(" x"), F.col("c").cast("string"), F.lit(" (24h)")).alias("l"))
    t2 = _joined_lines(inc_lines.unionByName(al_lines), "entity_ref", F.col("o"), F.col("l"), "t2_lines")

    sessions = ents.select("session_id").filter(F.col("session_id").isNotNull()).distinct()
    t3 = (L.latest_checkpoint(reasoning.join(sessions, "session_id", "left_semi"))
          .select("session_id", F.concat(F.lit("[T3 active] obs="), none_text("observation"), F.lit(" | hyp="),
                                         none_text("hypothesis"), F.lit(" | conf="),
                                         F.coalesce(fmt2("confidence"), F.lit("None"))).alias("t3_raw")))

    prior = L.prior_outcomes(reasoning.join(refs, reasoning["element_id"] == refs["entity_ref"], "left_semi"), 4)
    t4 = _joined_lines(prior.select(F.col("element_id").alias("entity_ref"), F.col("rank").alias("o"),
                                    F.concat(none_text("resolution"), F.lit(" (conf="),
                                             F.coalesce(fmt2("confidence"), F.lit("None")), F.lit("): "),
                                             F.substring(empty_text("hypothesis"), 1, 80)).alias("l")),
                       "entity_ref", F.col("o"), F.col("l"), "t4_lines")

    q = ents.select(F.col("key").alias("query_id"), "query_vec").filter(F.col("query_vec").isNotNull())
    nn = recall_similar(q, memory, 3) if matches is None else matches
    t5 = (nn.groupBy("query_id")
          .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "category", "confidence", "similarity", "content"))).alias("_m"),
               F.max_by(F.col("id"), F.struct(F.col("confidence"), -F.col("rank"))).alias("top_match_id"))
          .select(F.col("query_id").alias("key"), "top_match_id", F.size("_m").alias("t5_n"),
                  F.array_join(F.transform("_m", lambda m: F.concat(
                      F.lit("mem="), m["id"].cast("string"), F.lit(" cat="), none_text(m["category"]),
                      F.lit(" conf="), F.coalesce(fmt2(m["confidence"]), F.lit("None")),
                      F.lit(" sim="), fmt2(m["similarity"]), F.lit(" :: "), F.substring(empty_text(m["content"]), 1, 80))),
                      " | ").alias("t5_lines")))

    return (ents.join(t1, "entity_ref", "left").join(t2, "entity_ref", "left")
            .join(t3, "session_id", "left").join(t4, "entity_ref", "left").join(t5, "key", "left"))


def assemble_context(entities: DataFrame, elements: DataFrame, incidents: DataFrame, alarms: DataFrame,
                     reasoning: DataFrame, memory: DataFrame, as_of=None, tuning: Tuning = DEFAULT_TUNING,
                     matches: DataFrame | None = None) -> DataFrame:
    """Per entity key, the system context, budget used, per-tier tokens
    (NULL = no entry) and statuses, and the T5 top match."""
    budget = int(tuning.context_budget_tokens)
    t = tier_texts(entities, elements, incidents, alarms, reasoning, memory, as_of, matches)
    t1_status = (F.when(F.col("entity_ref").isNull(), "no_entity")
                 .when(F.col("t1_raw").isNull(), "not_found").otherwise("ok"))
    t24_status = F.when(F.col("entity_ref").isNull(), "no_entity")
    texts = {
        "t1_entity": F.col("t1_raw"),
        "t2_recent": F.when(F.col("t2_lines").isNotNull(), F.concat(F.lit("[T2 recent] "), F.col("t2_lines"))),
        "t3_active": F.col("t3_raw"),
        "t4_prior": F.when(F.col("t4_lines").isNotNull(), F.concat(F.lit("[T4 prior] "), F.col("t4_lines"))),
        "t5_semantic": F.when(F.col("t5_lines").isNotNull(), F.concat(F.lit("[T5 semantic] "), F.col("t5_lines"))),
    }
    status_when_text = {
        "t1_entity": F.lit("ok"), "t2_recent": F.lit("ok"), "t3_active": F.lit("ok"), "t4_prior": F.lit("ok"),
        "t5_semantic": F.lit("ok"),
    }
    status_when_empty = {
        "t1_entity": t1_status,
        "t2_recent": t24_status.otherwise("empty"),
        "t3_active": F.lit(None).cast("string"),
        "t4_prior": t24_status.otherwise("empty"),
        "t5_semantic": F.lit(None).cast("string"),
    }
    cols = [F.col(c) for c in t.columns]
    out = t.select(*cols, *[truncate_tokens(texts[n], TIER_CAPS[n]).alias(f"_{n}_txt") for n in TIERS])
    used = F.lit(0)
    blocks, tokens, statuses = [], [], []
    for n in TIERS:
        txt = F.col(f"_{n}_txt")
        cost = F.when(txt.isNotNull(), approx_tokens(txt))
        take = txt.isNotNull() & (used + cost <= budget)
        blocks.append(F.when(take, txt))
        tokens.append(F.when(take, cost).when(txt.isNull() & status_when_empty[n].isNotNull(), F.lit(0))
                      .cast("long").alias(f"{n}_tokens"))
        statuses.append(F.when(take, status_when_text[n]).when(txt.isNull(), status_when_empty[n]).alias(f"{n}_status"))
        used = used + F.when(take, cost).otherwise(F.lit(0))
    return out.select("key", "entity_ref", "session_id",
                      F.concat_ws("\n", *blocks).alias("system_context"),
                      used.cast("int").alias("budget_used"), F.lit(budget).alias("budget_total"),
                      *tokens, *statuses, "top_match_id",
                      F.coalesce(F.col("t5_n"), F.lit(0)).cast("long").alias("n_vector_matches"))
