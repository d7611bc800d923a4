"""Per-entity lookups turned into joins and per-key windows: entity profile
(J3), recent incidents (W2), recent alarm summary (A9), latest checkpoint
(W1), prior outcomes (W3) and incident picking (P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import none_text
from .common import as_of_col, minus_interval, top_n


def element_profile(entities: DataFrame, elements: DataFrame, entity_col: str = "entity_ref") -> DataFrame:
    """Left lookup of each entity's element row -> (entity, t1_text, t1_status).

    status: no_entity (NULL entity), not_found (no element row), ok."""
    el = elements.select("element_id", "site_id", "element_type", "vendor", "model",
                         *(["sw_version"] if "sw_version" in elements.columns else []), "region", "criticality")
    if "sw_version" not in el.columns:
        el = el.withColumn("sw_version", F.lit(None).cast("string"))
    j = entities.join(el, entities[entity_col] == el["element_id"], "left")
    text = F.concat(F.lit("[T1 element] "), none_text(F.col("element_id")), F.lit(" type="), none_text("element_type"),
                    F.lit(" vendor="), none_text("vendor"), F.lit("/"), none_text("model"),
                    F.lit(" sw="), none_text("sw_version"), F.lit(" site="), none_text("site_id"),
                    F.lit(" region="), none_text("region"), F.lit(" crit="), none_text("criticality"))
    status = (F.when(F.col(entity_col).isNull(), "no_entity")
              .when(F.col("element_id").isNull(), "not_found").otherwise("ok"))
    return j.select(F.col(entity_col), F.when(F.col("element_id").isNotNull(), text).alias("t1_text"),
                    status.alias("t1_status"))


def recent_incidents(incidents: DataFrame, k: int = 5) -> DataFrame:
    """The element's last k incidents by window_start (ties: ref)."""
    return top_n(incidents.filter(F.col("element_id").isNotNull()), "element_id",
                 [F.col("window_start").desc(), F.col("incident_ref")], k)


def recent_alarms(alarms: DataFrame, as_of=None, hours: int = 24, k: int = 5,
                  severities=("critical", "major")) -> DataFrame:
    """Count by (severity, alarm_type) per element in the last `hours`
    for the given severities, top k by count (ties: severity, type)."""
    now = as_of_col(as_of, alarms, "ts")
    c = (alarms.filter((F.col("ts") >= minus_interval(now, hours, "HOUR")) & F.col("severity").isin(*severities))
         .groupBy("element_id", "severity", "alarm_type").agg(F.count("*").alias("c")))
    return top_n(c, "element_id", [F.col("c").desc(), F.col("severity"), F.col("alarm_type")], k)


def latest_checkpoint(reasoning: DataFrame) -> DataFrame:
    """Newest checkpoint per session (ties: higher id)."""
    return top_n(reasoning, "session_id", [F.col("created_at").desc(), F.col("id").desc()], 1).drop("rank")


def prior_outcomes(reasoning: DataFrame, k: int = 4,
                   resolutions=("confirmed", "promoted", "escalated")) -> DataFrame:
    """The element's last k checkpoints with a resolving outcome."""
    r = reasoning.filter(F.col("resolution").isin(*resolutions) & F.col("element_id").isNotNull())
    return top_n(r, "element_id", [F.col("created_at").desc(), F.col("id").desc()], k)


def pick_order(mode: str) -> list:
    if mode == "latest":
        return [F.col("anomaly_score").desc_nulls_last(), F.col("window_start").desc(), F.col("incident_ref")]
    if mode == "newest":
        return [F.col("window_start").desc(), F.col("incident_ref")]
    raise ValueError(f"unknown pick mode {mode}")


def pick_incidents(incidents: DataFrame, mode: str = "latest", n: int = 1, incident_ref: str | None = None) -> DataFrame:
    """By reference; or the top-n open incidents by (anomaly, start) for
    `latest`, by start for `newest`.  Planned as a distributed top-n
    (TakeOrderedAndProject), never a global single-partition sort."""
    if incident_ref is not None:
        return incidents.filter(F.col("incident_ref") == F.lit(incident_ref))
    order = pick_order(mode)
    top = incidents.filter(F.col("status") == "open").orderBy(*order).limit(n)
    return top_n(top, F.lit(mode), order, None, "pick_rank").withColumn("pick_mode", F.lit(mode))
