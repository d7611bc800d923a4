"""Streaming, approximate and lifecycle jobs.

The streaming jobs read a table's rows as arrived files below the shared
checkpoint folder, run with an AvailableNow trigger and return what the sink wrote.
Append mode emits a window once the watermark has passed its end, so one
sentinel row far in the future closes every window of the data; the sentinel's own
(a single row) is never emitted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_TUNING
from ..operators import lifecycle as LC
from ..operators.memory import active_only
from ..session import scratch_path
from ..sources.fixtures import view, with_views
from ..sources.store import Store, day
from ..streaming.correlate import stream_correlate
from ..streaming.embed import stream_embed
from ..streaming.upsert import stream_incidents
from .catalog import ORACLES, query
from .q_composite import lsh_pairs_sql
from .q_eval import q_embed_backfill  # noqa: F401  (registers the shared oracle)

WINDOW_HOURS = 6        # tumbling window size
SESSION_GAP_HOURS = 1   # session gap
WATERMARK_MIN = 10
STREAM_MIN_ALARMS = 3


def _arrived(spark, df, path: str) -> str:
    """The rows as arrived files; a stream's next trigger takes all new ones."""
    df.write.mode("append").parquet(path)
    return path


def _run_correlate(spark, sf_dir, mode: str):
    size = f"{WINDOW_HOURS} hours" if mode == "tumbling" else f"{SESSION_GAP_HOURS} hours"
    alarms = view(spark, sf_dir, "v_alarms")
    last = alarms.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    sentinel = last.select(*[F.col("ts") if c == "ts" else F.lit("~sentinel").alias(c) if c == "element_id"
                             else F.lit(None).cast(t).alias(c) for c, t in alarms.dtypes])
    src = _arrived(spark, alarms.unionByName(sentinel), scratch_path(spark, "arrived-alarms"))
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    out, ckpt = scratch_path(spark, "stream-incidents"), scratch_path(spark, "stream-ckpt")
    q = stream_correlate(stream, out, ckpt, mode=mode, size=size, watermark=f"{WATERMARK_MIN} minutes",
                         min_alarms=STREAM_MIN_ALARMS, tuning=DEFAULT_TUNING)
    q.awaitTermination()
    res = spark.read.parquet(out)
    return (res.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
            .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
            .select("incident_ref", "element_id", "window_start", "window_end", "alarm_count", "severity",
                    "dominant_type", "subcategory", "anomaly_score"))


def _stream_sql(grouping: str) -> str:
    return f"""
WITH {grouping},
feat AS (SELECT * FROM (VALUES
  ('prb_overload', 'prb_util', 0.85e0, 1.0e0, 1.0e0), ('latency_spike', 'latency_ms', 100e0, 0.9e0, 300e0),
  ('packet_loss', 'packet_loss', 0.01e0, 0.9e0, 0.1e0), ('sctp_flap', 'sctp_resets', 3e0, 0.8e0, 20e0),
  ('rrc_failrate', 'rrc_fail_rate', 0.05e0, 0.7e0, 0.3e0), ('temp_high', 'temp_c', 55e0, 0.6e0, 30e0),
  ('vswr_high', 'vswr', 1.5e0, 0.7e0, 2.0e0)) AS f(feature, metric, threshold, weight, scale)),
base AS (SELECT element_id, window_start, window_end, count(*) AS alarm_count,
                max(CASE severity WHEN 'critical' THEN 4 WHEN 'major' THEN 3 WHEN 'minor' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS sev
         FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {STREAM_MIN_ALARMS}),
worst AS (SELECT element_id, window_start, metric, greatest(0e0, max(value)) AS worst FROM g
          WHERE metric IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2, 3),
subs AS (SELECT element_id, window_start, round(least(1e0, greatest(0e0, (worst - threshold) / scale)) * weight, 3) AS sub
         FROM worst JOIN feat USING (metric) WHERE worst >= threshold AND least(1e0, greatest(0e0, (worst - threshold) / scale)) * weight > 0),
sc AS (SELECT element_id, window_start, round(max(sub), 3) AS score FROM subs GROUP BY 1, 2),
ty AS (SELECT element_id, window_start,
              CASE WHEN alarm_type IN ('latencyHigh', 'packetLoss', 'prbUtilHigh', 'rrcSetupFail', 'sctpReset', 'tempHigh', 'vswrAlarm')
                   THEN alarm_type ELSE 'other' END AS tk, count(*) AS n, min((ts, id)) AS f FROM g GROUP BY 1, 2, 3),
dom AS (SELECT element_id, window_start, tk AS dominant_type FROM (SELECT *, row_number() OVER
          (PARTITION BY element_id, window_start ORDER BY n DESC, f, tk) AS r FROM ty) WHERE r = 1)
SELECT 'INC-' || b.element_id || '-' || strftime(b.window_start, '%Y%m%d%H%M') AS incident_ref, b.element_id,
       b.window_start, b.window_end, b.alarm_count,
       CASE b.sev WHEN 4 THEN 'critical' WHEN 3 THEN 'major' WHEN 2 THEN 'minor' ELSE 'warning' END AS severity,
       d.dominant_type,
       CASE d.dominant_type WHEN 'prbUtilHigh' THEN 'RAN-PRB-Congestion' WHEN 'rrcSetupFail' THEN 'RAN-RRC-Failure'
         WHEN 'sctpReset' THEN 'Transport-SCTP-Flap' WHEN 'packetLoss' THEN 'Core-UPF-Packet-Loss'
         WHEN 'tempHigh' THEN 'Environmental-HighTemp' WHEN 'vswrAlarm' THEN 'Hardware-Card-Fault'
         WHEN 'latencyHigh' THEN 'Transport-Microwave-Fade' ELSE 'RAN-PRB-Congestion' END AS subcategory,
       coalesce(s.score, 0e0) AS anomaly_score
FROM base b JOIN dom d USING (element_id, window_start) LEFT JOIN sc s USING (element_id, window_start)"""


_TUMBLING = f"""g AS (SELECT element_id, ts, id, severity, alarm_type, metric, value,
             time_bucket(INTERVAL {WINDOW_HOURS} HOUR, ts) AS window_start,
             time_bucket(INTERVAL {WINDOW_HOURS} HOUR, ts) + INTERVAL {WINDOW_HOURS} HOUR AS window_end
      FROM v_alarms)"""

_SESSION = f"""o AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY element_id ORDER BY ts, id) IS NULL
                          OR ts - lag(ts) OVER (PARTITION BY element_id ORDER BY ts, id) >= INTERVAL {SESSION_GAP_HOURS} HOUR THEN 1 ELSE 0 END AS brk
      FROM v_alarms),
s0 AS (SELECT *, sum(brk) OVER (PARTITION BY element_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS sid FROM o),
g AS (SELECT element_id, ts, id, severity, alarm_type, metric, value,
             min(ts) OVER (PARTITION BY element_id, sid) AS window_start,
             max(ts) OVER (PARTITION BY element_id, sid) + INTERVAL {SESSION_GAP_HOURS} HOUR AS window_end FROM s0)"""


@query("stream_correlate", with_views(["v_alarms"], _stream_sql(_TUMBLING)))
def q_stream_correlate(spark, sf_dir):
    return _run_correlate(spark, sf_dir, "tumbling")


@query("stream_correlate_session", with_views(["v_alarms"], _stream_sql(_SESSION)))
def q_stream_correlate_session(spark, sf_dir):
    return _run_correlate(spark, sf_dir, "session")


@query("stream_incidents_upsert", with_views(["v_alarms"], _stream_sql(_TUMBLING)))
def q_stream_incidents_upsert(spark, sf_dir):
    """Update mode into a stored incident table, stopped and restarted between the
    two halves of the alarms."""
    alarms = view(spark, sf_dir, "v_alarms")
    span = alarms.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    middle = F.lit(span["lo"] + (span["hi"] - span["lo"]) / 2)
    src, base, ckpt = (scratch_path(spark, f"upsert-{k}") for k in ("arrived", "incidents", "ckpt"))
    for half in (F.coalesce(F.col("ts") < middle, F.lit(True)), F.col("ts") >= middle):
        _arrived(spark, alarms.filter(half), src)
        stream = spark.readStream.schema(alarms.schema).parquet(src)
        stream_incidents(stream, base, ckpt, size=f"{WINDOW_HOURS} hours", watermark=f"{WATERMARK_MIN} minutes",
                         min_alarms=STREAM_MIN_ALARMS).awaitTermination()
    return (Store(spark, base).read().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
            .select("incident_ref", "element_id", "window_start", "window_end", "alarm_count", "severity",
                    "dominant_type", "subcategory", "anomaly_score"))


@query("stream_embed", ORACLES["embed_backfill"] + """
UNION ALL SELECT ticket_id, cast(unnest(range(0, len(embedding))) AS INTEGER), round(cast(unnest(embedding) AS DOUBLE), 6)
FROM v_tickets_text WHERE embedding IS NOT NULL""")
def q_stream_embed(spark, sf_dir):
    """The tickets' next table: old vectors as they were, missing ones filled."""
    t = view(spark, sf_dir, "v_tickets_text")
    src, base, ckpt = (scratch_path(spark, f"embed-{k}") for k in ("arrived", "tickets", "ckpt"))
    _arrived(spark, t, src)
    stream_embed(spark.readStream.schema(t.schema).parquet(src), "tickets", base, ckpt).awaitTermination()
    return (Store(spark, base).read().filter(F.col("embedding").isNotNull())
            .select("ticket_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim_index", "value"))
            .select("ticket_id", F.col("dim_index").cast("int").alias("dim_index"), F.round("value", 6).alias("value")))


@query("near_pairs_lsh", with_views(["v_memory"], "WITH " + lsh_pairs_sql(0.15) + """
SELECT id_a, id_b, round(distance, 6) AS distance FROM near"""))
def q_near_pairs_lsh(spark, sf_dir):
    """Approximate, with planes that the oracle restates; recall against the exact pairs is tested."""
    m = active_only(view(spark, sf_dir, "v_memory"))
    p = LC.near_pairs_lsh(m, DEFAULT_TUNING.dedup_distance_threshold, id_col="id", vec_col="memory_vec")
    return p.select("id_a", "id_b", F.round("distance", 6).alias("distance"))


@query("archive", with_views(["v_memory"], """
SELECT id, status, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE status END AS archived_reason
FROM v_memory WHERE status <> 'active' OR superseded_by IS NOT NULL"""))
def q_archive(spark, sf_dir):
    _, dead = LC.archive(view(spark, sf_dir, "v_memory"))
    return dead.select("id", "status", "archived_reason")


@query("expire", with_views(["v_alarms"], """
WITH a AS (SELECT max(ts) AS as_of FROM v_alarms)
SELECT id, ts < as_of - INTERVAL 14 DAY AS expired FROM v_alarms, a"""))
def q_expire(spark, sf_dir):
    e = LC.expire(view(spark, sf_dir, "v_alarms"), "ts", None, LC.RETENTION_DAYS["network_alarms"])
    return e.select("id", "expired")


@query("expire_partitions", with_views(["v_alarms"], """
WITH a AS (SELECT cast(max(ts) - INTERVAL 14 DAY AS DATE) AS first_day FROM v_alarms)
SELECT id, element_id, ts FROM v_alarms, a WHERE cast(ts AS DATE) >= first_day"""))
def q_expire_partitions(spark, sf_dir):
    """The stored alarm table after its retention run: whole dates are dropped."""
    alarms = view(spark, sf_dir, "v_alarms")
    store = Store(spark, scratch_path(spark, "expire-alarms"))
    store.append(alarms, "ingest", 1, by=day("ts"))
    LC.expire_partitions(store, str(alarms.agg(F.max("ts")).first()[0]), LC.RETENTION_DAYS["network_alarms"])
    return store.read().select("id", "element_id", "ts")
