"""Data contracts (S8) and vector coverage."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import ALARM_SEVERITIES

VECTOR_WIDTH = 64          # width of the default encoder's vectors


@dataclass(frozen=True)
class Contract:
    """Rules of one table, checked in this order: not_null, enums, json_object, json_array, vector_width,
    max_length, ranges (inclusive), references (column -> (table, column); NULL refers to nothing), key."""
    key: tuple = ()
    not_null: tuple = ()
    enums: dict = field(default_factory=dict)
    vector_width: dict = field(default_factory=dict)
    json_object: tuple = ()
    json_array: tuple = ()
    max_length: dict = field(default_factory=dict)
    ranges: dict = field(default_factory=dict)
    references: dict = field(default_factory=dict)


ALARMS_CONTRACT = Contract(
    key=("id",),
    not_null=("id", "element_id", "ts", "severity", "alarm_type"),
    enums={"severity": ALARM_SEVERITIES},
    json_object=("metrics",),
)

TICKETS_CONTRACT = Contract(
    key=("ticket_id",),
    not_null=("ticket_id", "summary"),
    enums={"priority": ["P1", "P2", "P3", "P4"]},
    vector_width={"embedding": 64},
)

# ---------------------------------------------------------------------------
# FIXED VALUES - the rules of the eight tables.
# ---------------------------------------------------------------------------
INCIDENT_SEVERITIES = ["critical", "major", "minor", "warning"]
MEMORY_STATUS = ["active", "deprecated", "superseded"]

CONTRACTS = {
    "network_elements": Contract(
        key=("element_id",),
        not_null=("element_id", "site_id", "element_type"),
        enums={"element_type": ["cell_site", "enodeb", "gnodeb", "bts", "router", "switch", "transport", "core", "firewall", "dns", "other"],
               "criticality": ["gold", "silver", "bronze"]},
        max_length={"element_id": 48},
    ),
    "network_alarms": Contract(
        key=("id",),
        not_null=("id", "element_id", "ts", "severity", "alarm_type"),
        enums={"severity": ALARM_SEVERITIES},
        json_object=("metrics",),
        max_length={"alarm_type": 64},
        references={"element_id": ("network_elements", "element_id")},
    ),
    "incidents": Contract(
        key=("incident_ref",),
        not_null=("incident_ref", "window_start", "window_end", "severity"),
        enums={"severity": INCIDENT_SEVERITIES, "status": ["open", "investigating", "resolved", "closed"]},
        vector_width={"signature_vec": VECTOR_WIDTH},
        ranges={"anomaly_score": (0.0, 1.0)},
        references={"element_id": ("network_elements", "element_id")},
    ),
    "incident_catalog": Contract(
        key=("pattern_id",),
        not_null=("pattern_id", "pattern_name", "category", "root_cause", "symptoms", "resolution", "severity"),
        enums={"category": ["radio", "transport", "core", "power", "environmental", "congestion", "config", "security", "hardware", "unknown"],
               "severity": INCIDENT_SEVERITIES},
        json_array=("symptoms",),
        vector_width={"signature_vec": VECTOR_WIDTH},
        max_length={"pattern_id": 32},
    ),
    "tickets": Contract(
        key=("ticket_id",),
        not_null=("ticket_id", "summary"),
        enums={"priority": ["P1", "P2", "P3", "P4"]},
        vector_width={"embedding": VECTOR_WIDTH},
    ),
    "agent_reasoning": Contract(
        key=("id",),
        not_null=("id", "session_id", "observation", "resolution"),
        enums={"resolution": ["confirmed", "dismissed", "escalated", "promoted"]},
        ranges={"confidence": (0.0, 1.0)},
        references={"element_id": ("network_elements", "element_id")},
    ),
    "incident_memory": Contract(
        key=("id",),
        not_null=("id", "category", "scope", "content"),
        enums={"category": ["pattern", "preference", "hardware_note", "site_context", "vendor_bug", "seasonal", "operational_rule"],
               "status": MEMORY_STATUS},
        vector_width={"memory_vec": VECTOR_WIDTH},
        ranges={"confidence": (0.0, 1.0)},
        references={"superseded_by": ("incident_memory", "id")},
    ),
    "runbook_memory": Contract(
        key=("id",),
        not_null=("id", "title", "scope", "trigger_condition", "steps"),
        enums={"status": MEMORY_STATUS},
        json_array=("steps",),
        vector_width={"runbook_vec": VECTOR_WIDTH},
        ranges={"confidence": (0.0, 1.0)},
        references={"superseded_by": ("runbook_memory", "id")},
    ),
}
# ---------------------------------------------------------------------------


def _column_rules(contract: Contract) -> list[tuple[Column, str]]:
    """(broken when, name) of the rules that look at one row only.  A value that no JSON reader accepts breaks its rule."""
    c = F.col
    rules = [(c(n).isNull(), f"null:{n}") for n in contract.not_null]
    rules += [(~c(n).isin(*allowed), f"enum:{n}") for n, allowed in contract.enums.items()]
    for names, shape in ((contract.json_object, "map<string,string>"), (contract.json_array, "array<string>")):
        rules += [(c(n).isNotNull() & F.from_json(c(n), shape).isNull(), f"json:{n}") for n in names]
    rules += [(c(n).isNotNull() & (F.size(c(n)) != width), f"width:{n}") for n, width in contract.vector_width.items()]
    rules += [(F.length(c(n)) > most, f"length:{n}") for n, most in contract.max_length.items()]
    rules += [(~c(n).between(low, high), f"range:{n}") for n, (low, high) in contract.ranges.items()]
    return rules


def rule_names(contract: Contract) -> list[str]:
    """Every reason the contract can give, first ones first."""
    refs = [f"reference:{n}" for n in contract.references]
    return [name for _, name in _column_rules(contract)] + refs + ([f"duplicate:{','.join(contract.key)}"] if contract.key else [])


def validate(df: DataFrame, contract: Contract, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every row with `reason`: NULL when valid, else the first broken rule
    (null:, enum:, json:, width:, length:, range:, reference:<col>, duplicate:<key>).

    `tables` holds the tables that references name; without a table its references are not checked.
    Both table-wide rules are reduced first: repeated keys by a partial count, dangling references to
    the distinct unknown values, so a key or an element with a third of all rows is one row of the side
    that is joined back.  All copies of a repeated key are invalid."""
    checks = _column_rules(contract)
    out, extra = df, []
    for i, (col, (name, target)) in enumerate(contract.references.items()):
        if not tables or name not in tables:
            continue
        known = tables[name].select(F.col(target).alias("_v")).distinct()
        dangling = (df.select(F.col(col).alias("_v")).filter("_v IS NOT NULL").distinct().join(known, "_v", "left_anti")
                    .select(F.col("_v").alias(f"_v{i}"), F.lit(True).alias(f"_dangling{i}")))
        out = out.join(dangling, F.col(col) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        checks.append((F.col(f"_dangling{i}").isNotNull(), f"reference:{col}"))
        extra.append(f"_dangling{i}")
    if contract.key:
        keys = list(contract.key)
        dup = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        out = out.join(dup, keys, "left")
        checks.append((F.col("_n").isNotNull(), "duplicate:" + ",".join(keys)))
        extra.append("_n")
    reason = F.lit(None).cast("string")
    for cond, name in reversed(checks):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return out.withColumn("reason", reason).select(*df.columns, "reason")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows with reason)."""
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


@dataclass
class Intake:
    accepted: DataFrame
    quarantine: DataFrame
    counts: dict                # rows, accepted and rows per reason, observed while writing


def intake(df: DataFrame, contract: Contract, path: str, tables: dict[str, DataFrame] | None = None) -> Intake:
    """Validate a table and write both outputs in one pass: `path`/accepted=true and `path`/accepted=false.
    The counters are observed on the rows as they are written, so no second scan counts them."""
    names = rule_names(contract)
    checked = validate(df, contract, tables).withColumn("accepted", F.col("reason").isNull())
    seen = Observation()
    counters = [F.count(F.lit(1)).alias("rows"), F.count_if("accepted").alias("accepted"),
                *[F.count_if(F.coalesce(F.col("reason") == n, F.lit(False))).alias(n) for n in names]]
    checked.observe(seen, *counters).write.partitionBy("accepted").parquet(path)
    schema = checked.schema
    back = df.sparkSession.read.schema(schema).parquet(path)
    return Intake(back.filter("accepted").drop("accepted", "reason"), back.filter("NOT accepted").drop("accepted"), seen.get)


def intake_all(tables: dict[str, DataFrame], base: str, contracts: dict[str, Contract] = CONTRACTS) -> dict[str, Intake]:
    """Every table that has a contract, each against the others' raw rows; one job a table, below `base`/<table>."""
    return {name: intake(df, contracts[name], f"{base.rstrip('/')}/{name}", tables) for name, df in tables.items() if name in contracts}


def quarantine_report(intakes: dict[str, Intake], contracts: dict[str, Contract] = CONTRACTS) -> DataFrame:
    """(table_name, row_key, reason) of all quarantined rows."""
    return reduce(DataFrame.unionByName, [
        i.quarantine.select(F.lit(name).alias("table_name"), F.concat_ws("|", *contracts[name].key).alias("row_key"), "reason")
        for name, i in intakes.items()])


def coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table, row count and rows with a vector."""
    parts = [df.agg(F.count("*").alias("rows"), F.count(vec).alias("with_vector"))
             .select(F.lit(name).alias("table_name"), "rows", "with_vector")
             for name, (df, vec) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
