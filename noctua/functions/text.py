"""Text helpers: tokeniser (JVM-side) and row banding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import empty_text, none_text

TOKEN_SPLIT = "[^a-z0-9]+"
_WS = "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$"


def strip_ws(c) -> Column:
    """Strip leading / trailing whitespace (space, tab, CR, LF, FF)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(col, _WS, "")


def tokenize(c) -> Column:
    """Lower-case, split on non-alphanumerics, drop empty tokens."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(col), TOKEN_SPLIT), lambda t: t != F.lit(""))


def _cat(*parts) -> Column:
    return strip_ws(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


# D19 builders: which NULLs print as '' and which as 'None' follows the
# reference field by field (`or ''` -> empty_text, bare value -> none_text).
def incident_text() -> Column:
    return _cat("incident severity=", none_text("severity"), " category=", none_text("category"), "/",
                none_text("subcategory"), " element=", none_text("element_id"), " site=", none_text("site_id"),
                " alarms=", none_text("alarm_count"), " anomaly=",
                F.coalesce(F.format_string("%.3f", F.col("anomaly_score").cast("double")), F.lit("None")),
                " breakdown=", empty_text("anomaly_breakdown"), " ", empty_text("title"), ". ",
                empty_text("description"))


def catalog_text() -> Column:
    return _cat("pattern ", none_text("pattern_name"), " category=", none_text("category"), " severity=",
                none_text("severity"), ". root_cause: ", none_text("root_cause"), ". symptoms: ",
                empty_text("symptoms"), ". resolution: ", none_text("resolution"))


def ticket_text() -> Column:
    return _cat("ticket category=", none_text("category"), "/", none_text("subcategory"), " priority=",
                none_text("priority"), " region=", none_text("region"), ". ", empty_text("summary"), ". ",
                empty_text("description"), ". resolution: ", empty_text("resolution"))


def reasoning_text() -> Column:
    return _cat("observation: ", empty_text("observation"), ". hypothesis: ", empty_text("hypothesis"),
                ". resolution: ", empty_text("resolution"))


def memory_text() -> Column:
    return _cat("[", none_text("category"), "] ", empty_text("content"))


def runbook_text() -> Column:
    return _cat("runbook ", none_text("title"), " :: trigger: ", empty_text("trigger_condition"), ". steps: ",
                empty_text("steps"))


# table -> (builder, id column, vector column)
BANDERS = {
    "incidents": (incident_text, "incident_ref", "signature_vec"),
    "incident_catalog": (catalog_text, "pattern_id", "signature_vec"),
    "tickets": (ticket_text, "ticket_id", "embedding"),
    "agent_reasoning": (reasoning_text, "id", "reasoning_vec"),
    "incident_memory": (memory_text, "id", "memory_vec"),
    "runbook_memory": (runbook_text, "id", "runbook_vec"),
}


def band_text(df, table: str, out: str = "band_text"):
    """Add the text to embed for a row of `table`; absent columns read as NULL."""
    builder = BANDERS[table][0]
    needed = {"incidents": ["severity", "category", "subcategory", "element_id", "site_id", "alarm_count",
                            "anomaly_score", "anomaly_breakdown", "title", "description"],
              "incident_catalog": ["pattern_name", "category", "severity", "root_cause", "symptoms", "resolution"],
              "tickets": ["category", "subcategory", "priority", "region", "summary", "description", "resolution"],
              "agent_reasoning": ["observation", "hypothesis", "resolution"],
              "incident_memory": ["category", "content"],
              "runbook_memory": ["title", "trigger_condition", "steps"]}[table]
    src = df
    for c in needed:
        if c not in src.columns:
            src = src.withColumn(c, F.lit(None).cast("string"))
    return src.withColumn(out, builder()).select(*df.columns, out)
