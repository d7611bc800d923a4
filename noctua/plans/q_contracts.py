"""Contracts of all eight tables (S8) over the views with planted faults.

Every planted table is its whole view in which the key's remainder by 41 decides which single
rule a row breaks; one remainder is appended a second time (repeated keys).  The same text runs
in both engines; the oracle states each rule in its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import band_text
from ..operators import encoder as E
from ..operators import lookups as L
from ..operators import ranking as R
from ..session import scratch_path
from ..sources import quality as Q
from ..sources.fixtures import register, table, view, with_views
from .catalog import query
from .q_eval import _strip, encoded_sql

PERIOD = 41
_NUMBER = "cast(substring(element_id, 4) AS bigint)"
_DATE_KEY = "(cast(alarm_count AS bigint) * 7 + cast(substring(element_id, 4) AS bigint))"
_LONG = "{c} || repeat('x', 70)"

# table -> (view, row number, {column: [broken values, one remainder each]})
PLANTED = {
    "network_elements": ("v_elements", _NUMBER, {
        "element_id": ["NULL", _LONG], "site_id": ["NULL"], "element_type": ["NULL", "'satellite'"], "criticality": ["'iron'"]}),
    "network_alarms": ("v_alarms", "id", {
        "id": ["NULL"], "element_id": ["NULL", "'NE-none'"], "ts": ["NULL"], "severity": ["NULL", "'fatal'"], "alarm_type": ["NULL", _LONG],
        "metrics": ["'not json'", "'[1]'"]}),
    "incidents": ("v_incidents", _DATE_KEY, {
        "incident_ref": ["NULL"], "element_id": ["'NE-none'"], "window_start": ["NULL"], "window_end": ["NULL"], "severity": ["NULL", "'info'"],
        "status": ["'done'"], "signature_vec": ["CASE WHEN {c} IS NOT NULL THEN array_append({c}, cast(0 AS float)) END"], "anomaly_score": ["1.5e0", "-0.1e0"]}),
    "incident_catalog": ("v_catalog", "cast(substring(pattern_id, 3) AS bigint)", {
        "pattern_id": ["NULL", _LONG], "pattern_name": ["NULL"], "category": ["NULL", "'weather'"], "root_cause": ["NULL"],
        "symptoms": ["NULL", "'{\"a\":1}'", "'['"], "resolution": ["NULL"], "severity": ["NULL", "'clear'"],
        "signature_vec": ["CASE WHEN {c} IS NOT NULL THEN array_append({c}, cast(0 AS float)) END"]}),
    "tickets": ("v_tickets_text", "ticket_id", {
        "ticket_id": ["NULL"], "summary": ["NULL"], "priority": ["'P9'"], "embedding": ["CASE WHEN {c} IS NOT NULL THEN array_append({c}, cast(0 AS float)) END"]}),
    "agent_reasoning": ("v_reasoning", "id", {
        "id": ["NULL"], "session_id": ["NULL"], "observation": ["NULL"], "resolution": ["NULL", "'ignored'"], "confidence": ["1.01e0"],
        "element_id": ["'NE-none'"]}),
    "incident_memory": ("v_memory", "id", {
        "id": ["NULL"], "category": ["NULL", "'rumour'"], "scope": ["NULL"], "content": ["NULL"], "status": ["'lost'"],
        "memory_vec": ["CASE WHEN {c} IS NOT NULL THEN array_append({c}, 0e0) END"], "confidence": ["-1e0"], "superseded_by": ["-1"]}),
    "runbook_memory": ("v_runbooks", "id", {
        "id": ["NULL"], "title": ["NULL"], "scope": ["NULL"], "trigger_condition": ["NULL"], "steps": ["NULL", "'reset'", "'{}'"],
        "status": ["'old'"], "runbook_vec": ["CASE WHEN {c} IS NOT NULL THEN array_append({c}, cast(0 AS float)) END"], "confidence": ["2e0"], "superseded_by": ["-1"]}),
}


def planted_sql(name: str) -> str:
    view, number, faults = PLANTED[name]
    cols, at = [], 0
    for c, values in faults.items():
        whens = ""
        for v in values:
            at += 1
            whens += f" WHEN {number} % {PERIOD} = {at} THEN {v.replace('{c}', c)}"
        cols.append(f"CASE{whens} ELSE {c} END AS {c}")
    again = f"SELECT {', '.join(faults)} FROM {view} WHERE {number} % {PERIOD} = {at + 1}"
    return f"SELECT {', '.join(cols)} FROM {view} UNION ALL {again}"


def _reason_sql(contract: Q.Contract) -> str:
    def words(xs):
        return ", ".join(f"'{x}'" for x in xs)

    cases = [f"WHEN {c} IS NULL THEN 'null:{c}'" for c in contract.not_null]
    cases += [f"WHEN {c} NOT IN ({words(allowed)}) THEN 'enum:{c}'" for c, allowed in contract.enums.items()]
    for names, shape in ((contract.json_object, "OBJECT"), (contract.json_array, "ARRAY")):
        cases += [f"WHEN {c} IS NOT NULL AND CASE WHEN json_valid({c}) THEN json_type({c}) <> '{shape}' ELSE true END THEN 'json:{c}'" for c in names]
    cases += [f"WHEN len({c}) <> {n} THEN 'width:{c}'" for c, n in contract.vector_width.items()]
    cases += [f"WHEN length({c}) > {n} THEN 'length:{c}'" for c, n in contract.max_length.items()]
    cases += [f"WHEN {c} < {low} OR {c} > {high} THEN 'range:{c}'" for c, (low, high) in contract.ranges.items()]
    cases += [f"WHEN {c} IS NOT NULL AND {c} NOT IN (SELECT {to} FROM p_{t} WHERE {to} IS NOT NULL) THEN 'reference:{c}'"
              for c, (t, to) in contract.references.items()]
    return "CASE " + " ".join(cases) + f" WHEN count(*) OVER (PARTITION BY {contract.key[0]}) > 1 THEN 'duplicate:{contract.key[0]}' END"


def _oracle() -> str:
    planted = ",\n".join(f"p_{n} AS ({planted_sql(n)})" for n in PLANTED)
    parts = [f"SELECT '{n}' AS table_name, coalesce(cast({Q.CONTRACTS[n].key[0]} AS varchar), '') AS row_key, {_reason_sql(Q.CONTRACTS[n])} AS reason FROM p_{n}"
             for n in PLANTED]
    return "WITH " + planted + "\nSELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE reason IS NOT NULL"


def planted_tables(spark, sf_dir) -> dict:
    register(spark, sf_dir, [view for view, *_ in PLANTED.values()])
    return {n: spark.sql(planted_sql(n)) for n in PLANTED}


@query("quarantine", with_views([view for view, *_ in PLANTED.values()], _oracle()))
def q_quarantine(spark, sf_dir):
    """All rows of all eight tables that break their contract, with the first broken rule."""
    return Q.quarantine_report(Q.intake_all(planted_tables(spark, sf_dir), scratch_path(spark, "intake")))


@query("element_profile_gaps", with_views(["v_alarms", "v_elements"], f"""
WITH p_network_alarms AS ({planted_sql("network_alarms")})
SELECT e.entity_ref, CASE WHEN el.element_id IS NOT NULL THEN '[T1 element] ' || el.element_id || ' type=' || el.element_type || ' vendor=' || el.vendor || '/'
         || el.model || ' sw=None site=' || el.site_id || ' region=' || el.region || ' crit=' || el.criticality END AS t1_text,
       CASE WHEN e.entity_ref IS NULL THEN 'no_entity' WHEN el.element_id IS NULL THEN 'not_found' ELSE 'ok' END AS t1_status
FROM (SELECT DISTINCT element_id AS entity_ref FROM p_network_alarms) e LEFT JOIN v_elements el ON e.entity_ref = el.element_id"""))
def q_element_profile_gaps(spark, sf_dir):
    """J3 for the elements of the planted alarms: known, unknown and missing ones."""
    alarms = planted_tables(spark, sf_dir)["network_alarms"]
    return L.element_profile(alarms.select(F.col("element_id").alias("entity_ref")).distinct(), view(spark, sf_dir, "v_elements"))


@query("band_text_catalog", with_views(["v_catalog"], f"""
WITH p AS ({planted_sql("incident_catalog")})
SELECT pattern_name AS name, {_strip("'pattern ' || coalesce(pattern_name, 'None') || ' category=' || coalesce(category, 'None') || ' severity=' || coalesce(severity, 'None') || '. root_cause: ' || coalesce(root_cause, 'None') || '. symptoms: ' || coalesce(symptoms, '') || '. resolution: ' || coalesce(resolution, 'None')")} AS band_text
FROM p"""))
def q_band_text_catalog(spark, sf_dir):
    """D19 for the catalog, missing fields included."""
    return band_text(planted_tables(spark, sf_dir)["incident_catalog"], "incident_catalog").select(F.col("pattern_name").alias("name"), "band_text")


@query("catalog_patterns", with_views(["v_catalog"], "WITH " + encoded_sql("benchmark", "item_id", "text", "enc").lstrip() + """,
c AS (SELECT *, cast(signature_vec AS DOUBLE[]) AS v FROM v_catalog WHERE signature_vec IS NOT NULL)
SELECT query_id, rank, pattern_id, pattern_name, category, round(sim, 6) AS similarity FROM (
  SELECT enc.item_id AS query_id, pattern_id, pattern_name, category, list_cosine_similarity(enc.v, c.v) AS sim,
         row_number() OVER (PARTITION BY enc.item_id ORDER BY list_cosine_similarity(enc.v, c.v) DESC, pattern_id) AS rank FROM enc CROSS JOIN c) WHERE rank <= 5"""))
def q_catalog_patterns(spark, sf_dir):
    """The catalog patterns nearest each benchmark passage, taken as an incident's description."""
    near = R.nearest_patterns(table(spark, sf_dir, "benchmark"), view(spark, sf_dir, "v_catalog"), 5, query_id="item_id")
    return near.withColumn("similarity", F.round("similarity", 6))


@query("embed_catalog", with_views(["v_catalog"], """
WITH todo AS (SELECT pattern_id, 'pattern ' || coalesce(pattern_name, 'None') || ' category=' || category || ' severity=' || severity || '. root_cause: ' || root_cause
  || '. symptoms: ' || symptoms || '. resolution: ' || coalesce(resolution, 'None') AS txt FROM v_catalog WHERE signature_vec IS NULL),"""
  + encoded_sql("todo", "pattern_id", "txt", "enc") + """
SELECT pattern_id, filled, cast(unnest(range(len(v))) AS INTEGER) AS dim_index, round(unnest(v), 5) AS value FROM (
  SELECT c.pattern_id, c.signature_vec IS NULL AS filled, cast(coalesce(c.signature_vec, cast(enc.v AS FLOAT[])) AS DOUBLE[]) AS v FROM v_catalog c LEFT JOIN enc USING (pattern_id))"""))
def q_embed_catalog(spark, sf_dir):
    """The next snapshot of the catalog, vectors it had and vectors filled in."""
    catalog = view(spark, sf_dir, "v_catalog")
    after, filled = E.embed_backfill(catalog, "incident_catalog")
    new = filled.select("pattern_id", F.lit(True).alias("filled"))
    return (after.join(new, "pattern_id", "left")
            .select("pattern_id", F.coalesce("filled", F.lit(False)).alias("filled"), F.posexplode(F.col("signature_vec").cast("array<double>")).alias("dim_index", "value"))
            .withColumn("value", F.round("value", 5)))
