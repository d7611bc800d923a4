"""Views that map the driver tables onto the incident schema.

The same SQL text runs in Spark and in DuckDB (the oracle); only the vector
cast and the 0/1-based lambda index differ.  In Spark the views are temp
views over the parquet files of one scale directory; in DuckDB they become
CTEs in front of the oracle query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, scratch_path

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_DIALECT = {
    "spark": {
        "{DARR}": "array<double>",
        "{SHIFT_0_4}": "transform(cast(embedding AS array<double>), (x, i) -> CASE WHEN i = 0 THEN x + 0.4e0 ELSE x END)",
        "{SHIFT_0_6}": "transform(cast(embedding AS array<double>), (x, i) -> CASE WHEN i = 0 THEN x + 0.6e0 ELSE x END)",
    },
    "duckdb": {
        "{DARR}": "DOUBLE[]",
        "{SHIFT_0_4}": "list_transform(cast(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i = 1 THEN x + 0.4e0 ELSE x END)",
        "{SHIFT_0_6}": "list_transform(cast(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i = 1 THEN x + 0.6e0 ELSE x END)",
    },
}

VIEWS: dict[str, str] = {
    "v_elements": """
SELECT 'NE-' || lpad(cast(c_custkey AS string), 5, '0') AS element_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'SITE-A' ELSE 'SITE-B' END AS site_id,
       CASE c_custkey % 4 WHEN 0 THEN 'gnodeb' WHEN 1 THEN 'router' WHEN 2 THEN 'core' ELSE 'switch' END AS element_type,
       n_name AS vendor, c_mktsegment AS model, r_name AS region,
       CASE c_custkey % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'bronze' END AS criticality
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_alarms": """
SELECT id, element_id, site_id, ts, severity, alarm_type, metric, value,
       CASE WHEN metric IS NULL THEN NULL ELSE '{"' || metric || '":' || cast(value AS string) || '}' END AS metrics
FROM (
  SELECT event_id AS id, 'NE-' || lpad(cast(user_id AS string), 5, '0') AS element_id,
         CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'SITE-B' ELSE 'SITE-A' END AS site_id, ts,
         CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'major' WHEN 'signup' THEN 'minor'
                         WHEN 'click' THEN 'warning' ELSE 'clear' END AS severity,
         CASE event_id % 8 WHEN 0 THEN 'prbUtilHigh' WHEN 1 THEN 'rrcSetupFail' WHEN 2 THEN 'sctpReset' WHEN 3 THEN 'packetLoss'
                           WHEN 4 THEN 'tempHigh' WHEN 5 THEN 'vswrAlarm' WHEN 6 THEN 'latencyHigh' ELSE 'unlisted' END AS alarm_type,
         CASE event_id % 8 WHEN 0 THEN 'prb_util' WHEN 1 THEN 'rrc_fail_rate' WHEN 2 THEN 'sctp_resets' WHEN 3 THEN 'packet_loss'
                           WHEN 4 THEN 'temp_c' WHEN 5 THEN 'vswr' WHEN 6 THEN 'latency_ms' ELSE NULL END AS metric,
         CASE event_id % 8 WHEN 0 THEN 0.8e0 + k / 500 WHEN 1 THEN k / 300 WHEN 2 THEN k / 4 WHEN 3 THEN k / 1000
                           WHEN 4 THEN k - 10 WHEN 5 THEN k / 50 WHEN 6 THEN k * 4 ELSE NULL END AS value
  FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS double) AS k FROM events) AS e
) AS a""",
    "v_tickets_volume": """
SELECT 'TKT-' || cast(o_orderkey AS string) AS ticket_id, o_orderdate AS created_at, r_name AS region,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE c_mktsegment END AS subcategory
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_tickets_text": """
SELECT doc_id AS ticket_id, lang AS region, 'L' || cast(label AS string) AS subcategory,
       CASE doc_id % 4 WHEN 0 THEN 'P1' WHEN 1 THEN 'P2' WHEN 2 THEN 'P3' ELSE 'P4' END AS priority,
       text AS summary, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'reported by ' || source END AS description,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE embedding END AS embedding
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "v_outcomes": """
SELECT (l_partkey % (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 7)) * 10 + 7 AS runbook_id,
       l_returnflag <> 'R' AS succeeded, l_shipdate AS at FROM lineitem""",
    "v_reasoning": """
SELECT conv_id * 1000 + turn AS id, 'S-' || cast(conv_id AS string) AS session_id,
       'NE-' || lpad(cast(conv_id % 15 AS string), 5, '0') AS element_id,
       timestamp '2024-01-01 00:00:00' + (conv_id * 60 + turn) * interval '1' minute AS created_at,
       text AS observation, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS hypothesis,
       CASE turn % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'dismissed' WHEN 2 THEN 'escalated' ELSE 'promoted' END AS resolution,
       cast(50 + (conv_id + turn) % 46 AS double) / 100 AS confidence
FROM conversations""",
    "v_memory": """
SELECT id, CASE id % 3 WHEN 0 THEN 'global' ELSE 'vendor:X' END AS scope, CASE WHEN id % 5 = 0 THEN 'vendor_bug' ELSE 'pattern' END AS category,
       'pattern ' || cast(id AS string) AS content, cast(25 + (id * 7) % 74 AS double) / 100 AS confidence, 1 + id % 5 AS evidence_count,
       CASE WHEN id % 17 = 0 THEN 'deprecated' ELSE 'active' END AS status, cast(NULL AS bigint) AS superseded_by,
       timestamp '2024-01-01 00:00:00' + (id % 90) * interval '1' day AS created_at,
       CASE WHEN id % 4 = 0 THEN NULL ELSE timestamp '2024-01-15 12:00:00' + (id % 80) * interval '1' day END AS last_reinforced_at,
       memory_vec
FROM (SELECT vec_id AS id, cast(embedding AS {DARR}) AS memory_vec FROM embeddings
      UNION ALL SELECT vec_id + 100000, {SHIFT_0_4} FROM embeddings WHERE vec_id % 5 = 0
      UNION ALL SELECT vec_id + 200000, {SHIFT_0_6} FROM embeddings WHERE vec_id % 10 = 0) AS m""",
    "v_runbooks": """
SELECT vec_id AS id, p_name AS title, 'type ' || p_type AS trigger_condition, '["check","reset"]' AS steps, 'global' AS scope,
       0.6e0 AS confidence, 0 AS success_count, 0 AS fail_count, 'active' AS status, cast(NULL AS bigint) AS superseded_by, embedding AS runbook_vec
FROM embeddings LEFT JOIN part ON p_partkey = vec_id WHERE vec_id % 10 = 7""",
    "v_catalog": """
SELECT 'P-' || cast(p_partkey AS string) AS pattern_id, p_name AS pattern_name,
       CASE p_partkey % 4 WHEN 0 THEN 'radio' WHEN 1 THEN 'transport' WHEN 2 THEN 'core' ELSE 'power' END AS category,
       'worn ' || p_type AS root_cause, '["' || p_type || '"]' AS symptoms, 'replace ' || p_name AS resolution,
       CASE p_partkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'minor' END AS severity, embedding AS signature_vec
FROM part LEFT JOIN embeddings ON vec_id = p_partkey""",
    "v_incidents": """
SELECT 'INC-' || element_id || '-' || cast(d AS string) AS incident_ref, element_id, window_start, window_end, alarm_count, severity,
       'L' || cast(label AS string) AS subcategory, 'L' || cast(label AS string) || ' on ' || element_id AS title,
       CASE WHEN pick % 9 = 0 THEN 0.0e0 ELSE cast(pick % 100 AS double) / 100 END AS anomaly_score,
       CASE WHEN pick % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, embedding AS signature_vec
FROM (SELECT 'NE-' || lpad(cast(user_id AS string), 5, '0') AS element_id, cast(ts AS date) AS d, min(ts) AS window_start, max(ts) AS window_end,
             count(*) AS alarm_count, max(CASE WHEN event_type = 'error' THEN 'critical' ELSE 'major' END) AS severity,
             (min(event_id) * 7) % (SELECT count(*) FROM embeddings) AS pick
      FROM events GROUP BY 1, 2 HAVING count(*) >= 4) AS g JOIN embeddings ON vec_id = pick""",
}


def view_sql(name: str, dialect: str) -> str:
    sql = VIEWS[name]
    for k, v in _DIALECT[dialect].items():
        sql = sql.replace(k, v)
    return sql.strip()


# Base tables each view reads.
VIEW_DEPS = {
    "v_elements": ["customer", "nation", "region"],
    "v_alarms": ["events"],
    "v_tickets_volume": ["orders", "customer", "nation", "region"],
    "v_tickets_text": ["documents", "embeddings"],
    "v_outcomes": ["lineitem", "embeddings"],
    "v_reasoning": ["conversations"],
    "v_memory": ["embeddings"],
    "v_runbooks": ["embeddings", "part"],
    "v_catalog": ["part", "embeddings"],
    "v_incidents": ["events", "embeddings"],
}

# Session settings that remember what is registered (temp views are per session).
_DIR, _DONE = "noctua.fixtures.dir", "noctua.fixtures.done"


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None, tables: list[str] | None = None,
             materialize: bool = False) -> None:
    """Register the fixture views `names` (all when None) and base `tables`
    of `sf_dir` in Spark, skipping what this session already has for it.

    With `materialize` each view is also written as parquet under the shared
    checkpoint folder and re-registered over the files."""
    prepare(spark)
    done = set()
    if spark.conf.get(_DIR, "") == sf_dir:
        done = set(filter(None, spark.conf.get(_DONE, "").split(",")))
    views = list(VIEWS) if names is None else list(names)
    bases = set(tables or [])
    for v in views:
        bases.update(VIEW_DEPS[v])
    for t in sorted(bases - done):
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)
        done.add(t)
    for v in views:
        if v not in done:
            spark.sql(f"CREATE OR REPLACE TEMP VIEW {v} AS {view_sql(v, 'spark')}")
            if materialize:
                path = scratch_path(spark, f"fixture-{v}")
                spark.table(v).write.parquet(path)
                spark.read.parquet(path).createOrReplaceTempView(v)
            done.add(v)
    spark.conf.set(_DIR, sf_dir)
    spark.conf.set(_DONE, ",".join(sorted(done)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, [name])
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver base table of `sf_dir`."""
    register(spark, sf_dir, [], [name])
    return spark.table(name)


def with_views(names: list[str], body: str) -> str:
    """DuckDB text: the named views as CTEs in front of `body`.

    `body` may itself start with WITH; its CTEs are appended after the views."""
    ctes = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in names]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join(ctes) + ",\n" + body[len(start):]
    return "WITH " + ",\n".join(ctes) + "\n" + body
