"""Alarm correlation (D1) and its parts: groups (A1), worst KPI (A2), top
severity (A3), dominant type (A4), type histogram (A5), marking (S4) and
triage checkpoints (D14).

Plan shape: one filtered scan of the lookback window feeds several partial
aggregates - by (element, site), by element, by (element, metric) and by
(element, alarm_type).  Each exchange carries map-side partial results, so
an element holding a third of the alarms is reduced before the shuffle.
The per-element results are small and joined on element_id.  Evidence is
not collected into per-incident arrays: the marked-alarm output is the
evidence table (incident_ref, alarm id, ts).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_DOMAIN, DEFAULT_TUNING, Domain, Tuning
from ..functions.scalar import category_of, incident_ref, parse_kpis, severity_name, severity_rank
from .anomaly import score_anomaly, type_to_subcategory
from .common import as_of_col, minus_interval


def in_window(alarms: DataFrame, as_of=None, lookback_hours: int = 6) -> DataFrame:
    """Uncorrelated alarms with ts >= as_of - lookback (no upper bound)."""
    now = as_of_col(as_of, alarms, "ts")
    cond = F.col("ts") >= minus_interval(now, lookback_hours, "HOUR")
    if "correlated_incident" in alarms.columns:
        cond = cond & F.col("correlated_incident").isNull()
    return alarms.filter(cond)


def alarm_groups(window: DataFrame, min_alarms: int = 5) -> DataFrame:
    """A1: count, first and last ts by (element, site); NULL site is a group."""
    return (window.groupBy("element_id", "site_id")
            .agg(F.count("*").alias("alarm_count"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))
            .filter(F.col("alarm_count") >= min_alarms))


def worst_kpi(window: DataFrame) -> DataFrame:
    """A2: per (element, metric) the worst value, floored at 0."""
    kv = window.select("element_id", F.explode(parse_kpis("metrics")).alias("metric", "v"))
    return (kv.filter(F.col("v").isNotNull()).groupBy("element_id", "metric")
            .agg(F.greatest(F.lit(0.0), F.max("v")).alias("worst")))


def type_histogram(window: DataFrame) -> DataFrame:
    """A5: count per (element, alarm_type) with the first sighting (ts, id)."""
    return (window.groupBy("element_id", "alarm_type")
            .agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first_seen")))


def dominant_type(hist: DataFrame) -> DataFrame:
    """A4: most frequent type per element; ties go to the type seen first."""
    w = Window.partitionBy("element_id").orderBy(F.col("n").desc(), F.col("first_seen"))
    return (hist.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("element_id", F.col("alarm_type").alias("dominant_type"), F.col("n").alias("dominant_count")))


def element_totals(window: DataFrame) -> DataFrame:
    """Element total and A3 top severity rank."""
    return (window.groupBy("element_id")
            .agg(F.count("*").alias("alarm_count"), F.max(severity_rank("severity")).alias("severity_rank")))


def pick_groups(groups: DataFrame) -> DataFrame:
    """The element's largest group wins (ties: site ascending, NULL first)."""
    w = Window.partitionBy("element_id").orderBy(F.col("alarm_count").desc(), F.col("site_id").asc_nulls_first())
    return (groups.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
            .select("element_id", "site_id", "window_start", "window_end"))


@dataclass
class Triage:
    incidents: DataFrame
    marked_alarms: DataFrame
    checkpoints: DataFrame
    evidence: DataFrame
    window: DataFrame | None = None
    alarms: DataFrame | None = None
    as_of: object = None
    lookback_hours: int = 6

    def materialize(self) -> "Triage":
        """Compute the incident aggregate once (reliable checkpoint into the
        shared folder) and derive the other outputs from it, so writing all
        of them scans and aggregates the alarms once."""
        inc = self.incidents.checkpoint()
        refs = inc.select("element_id", "incident_ref")
        evidence = (self.window.join(refs, "element_id")
                    .select("incident_ref", F.col("id").alias("alarm_id"), "ts", "element_id"))
        marked = mark_alarms(self.alarms, refs, self.as_of, self.lookback_hours)
        return Triage(inc, marked, triage_checkpoints(inc), evidence, self.window, self.alarms, self.as_of,
                      self.lookback_hours)


def write_triage(t: Triage, base: str, version: int) -> dict:
    """Sink for D1, as writer `triage` of stored tables under `base`.  Incidents are
    upserted on incident_ref (a known incident changes only its count, score and
    breakdown; its status and history stay), in the partitions of their window's
    date; checkpoints and evidence are appended; of the alarm table only the dates of
    the lookback are rewritten.  A replay of a version changes nothing.  Returns
    whether each table took the batch now."""
    from ..sources.store import Store, day
    from ..sources.tables import append_batch, upsert_into
    m = t.materialize()
    spark, root, writer = m.incidents.sparkSession, base.rstrip("/"), "triage"
    taken = {"incidents": upsert_into(Store(spark, f"{root}/incidents"), m.incidents, ["incident_ref"],
                                      ["alarm_count", "anomaly_score", "anomaly_breakdown"], "window_start", writer, version)}
    for name, rows in (("agent_reasoning", m.checkpoints), ("evidence", m.evidence)):
        taken[name] = append_batch(rows, f"{root}/{name}", version, writer)
    store = Store(spark, f"{root}/network_alarms")
    if store.head() is None:
        taken["network_alarms"] = store.overwrite(m.marked_alarms, writer, version, by=day("ts"))
    else:
        since = F.to_date(minus_interval(as_of_col(t.as_of, t.alarms, "ts"), t.lookback_hours, "HOUR"))
        recent = m.marked_alarms.filter(F.to_date("ts") >= since)
        taken["network_alarms"] = store.replace(recent, writer, version, day("ts"), recent.select(day("ts").alias("part")))
    return taken


def correlate_alarms(alarms: DataFrame, as_of=None, min_alarms: int = 5, lookback_hours: int = 6,
                     tuning: Tuning = DEFAULT_TUNING, domain: Domain = DEFAULT_DOMAIN) -> Triage:
    """One scored incident per element that has some (element, site) group
    of at least `min_alarms` uncorrelated alarms in the lookback.

    The incident takes window and site from the element's largest group and
    everything else from all of the element's alarms in the window."""
    now = as_of_col(as_of, alarms, "ts")
    window = in_window(alarms, now, lookback_hours)
    chosen = pick_groups(alarm_groups(window, min_alarms))
    totals = element_totals(window)
    hist = type_histogram(window)
    dom = dominant_type(hist)
    worst = worst_kpi(window)
    scored = score_anomaly(worst, "element_id", tuning, domain)
    hist_json = (hist.groupBy("element_id")
                 .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
                     F.struct(F.coalesce("alarm_type", F.lit("None")), "n"))))).alias("types_json")))
    worst_json = (worst.groupBy("element_id")
                  .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "worst"))))).alias("kpis_json")))

    base = (chosen.join(totals, "element_id").join(dom, "element_id")
            .join(scored, "element_id", "left").join(hist_json, "element_id", "left").join(worst_json, "element_id", "left"))
    sub = type_to_subcategory("dominant_type", domain)
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    n = F.col("alarm_count").cast("string")
    bjson = F.coalesce(F.to_json("anomaly_breakdown"), F.lit("{}"))
    incidents = base.select(
        incident_ref("element_id", "window_start").alias("incident_ref"),
        "element_id", "site_id", "window_start", "window_end", "alarm_count",
        severity_name("severity_rank").alias("severity"),
        category_of(sub).alias("category"),
        sub.alias("subcategory"),
        F.concat(sub, F.lit(" on "), F.col("element_id"), F.lit(" ("), n, F.lit(" correlated alarms)")).alias("title"),
        F.concat(F.lit("Correlated "), n, F.lit(" alarms on "), F.col("element_id"), F.lit(" (types: "),
                 F.coalesce("types_json", F.lit("{}")), F.lit("). Worst KPIs: "), F.coalesce("kpis_json", F.lit("{}")),
                 F.lit(". Anomaly "), score.cast("string"), F.lit(" breakdown "), bjson, F.lit(".")).alias("description"),
        score.alias("anomaly_score"),
        bjson.alias("anomaly_breakdown"),
        F.lit("open").alias("status"),
        F.lit(None).cast("string").alias("region"),
        "dominant_type",
    )

    refs = incidents.select("element_id", "incident_ref")
    evidence = (window.join(refs, "element_id")
                .select("incident_ref", F.col("id").alias("alarm_id"), "ts", "element_id"))
    marked = mark_alarms(alarms, refs, now, lookback_hours)
    checkpoints = triage_checkpoints(incidents)
    return Triage(incidents, marked, checkpoints, evidence, window, alarms, now, lookback_hours)


def mark_alarms(alarms: DataFrame, refs: DataFrame, as_of, lookback_hours: int) -> DataFrame:
    """Set correlated_incident on the element's uncorrelated alarms in the
    lookback; every other alarm keeps its value."""
    now = as_of_col(as_of, alarms, "ts")
    src = alarms if "correlated_incident" in alarms.columns else alarms.withColumn(
        "correlated_incident", F.lit(None).cast("string"))
    hit = (F.col("incident_ref").isNotNull() & F.col("correlated_incident").isNull()
           & (F.col("ts") >= minus_interval(now, lookback_hours, "HOUR")))
    cols = [c for c in src.columns if c != "correlated_incident"]
    return (src.join(refs, "element_id", "left")
            .select(*cols, F.when(hit, F.col("incident_ref")).otherwise(F.col("correlated_incident")).alias("correlated_incident")))


def triage_checkpoints(incidents: DataFrame) -> DataFrame:
    """D14 for triage: outcome-only episodic rows."""
    score = F.col("anomaly_score")
    return incidents.select(
        F.concat(F.lit("triage-"), F.col("incident_ref")).alias("session_id"),
        "incident_ref", "element_id",
        F.concat(F.col("alarm_count").cast("string"), F.lit(" alarms correlated on "), F.col("element_id"),
                 F.lit("; anomaly="), score.cast("string"), F.lit(" "), F.col("anomaly_breakdown")).alias("observation"),
        F.concat(F.lit("Likely "), F.col("subcategory"), F.lit(" (dominant alarm: "),
                 F.coalesce(F.col("dominant_type"), F.lit("None")), F.lit(")")).alias("hypothesis"),
        F.when(score >= 0.5, "confirmed").otherwise("dismissed").alias("resolution"),
        F.least(F.lit(0.95), F.lit(0.5) + score / 2).alias("confidence"),
        F.col("alarm_count").alias("evidence_count"),
    )
