"""Alarm correlation as a Structured Streaming job.

One stateful aggregation per (event-time window, element): counts, first
and last alarm, top severity, one max per configured KPI and one
conditional count (with first sighting) per configured alarm type (unlisted
types count as `other`).  Scoring (D2), dominant type (A4) and the
subcategory (D3) are column expressions over the aggregate, so the state is
a fixed-width row per open window whatever the alarm volume of an element.

Late alarms (of a window that ends at or behind the watermark) are dropped by the
engine.  They are counted before the aggregation: the rows' window ends travel
beside the aggregate to the sink, which writes per batch the exact count and the
watermark to `<checkpoint>/late_rows/batch=<id>` (the source is read twice).  Output
is append mode: a window is emitted once, when the watermark passes its end;
the sink is `foreachBatch` writing `<out>/batch=<id>`, so a replayed batch
overwrites its own directory (idempotent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_DOMAIN, DEFAULT_TUNING, Domain, Tuning
from ..functions.scalar import category_of, incident_ref, parse_kpis, severity_name, severity_rank

OTHER = "other"


def _type_key(c: str) -> str:
    return "t_" + c


def window_aggregate(alarms: DataFrame, *, mode: str = "tumbling", size: str = "15 minutes",
                     watermark: str = "10 minutes", domain: Domain = DEFAULT_DOMAIN) -> DataFrame:
    """Watermarked per-(window, element) aggregate (works on batch or stream)."""
    a = alarms.withColumn("ts", F.col("ts").cast("timestamp_ltz")).withWatermark("ts", watermark)
    kpis = parse_kpis("metrics")
    a = a.select("element_id", "ts", "id", "severity", "alarm_type", kpis.alias("_k"))
    w = F.window("ts", size) if mode == "tumbling" else F.session_window("ts", size)
    types = domain.types
    tkey = F.when(F.col("alarm_type").isin(*types), F.col("alarm_type")).otherwise(F.lit(OTHER))
    aggs = [F.count("*").alias("alarm_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
            F.max(severity_rank("severity")).alias("severity_rank")]
    for metric in domain.metrics:
        aggs.append(F.max(F.element_at("_k", F.lit(metric))).alias(f"kpi_{metric}"))
    for t in types + [OTHER]:
        hit = tkey == t
        aggs.append(F.count_if(hit).alias(f"{_type_key(t)}_n"))
        aggs.append(F.min(F.when(hit, F.struct("ts", "id"))).alias(f"{_type_key(t)}_first"))
    return a.groupBy(w.alias("win"), "element_id").agg(*aggs)


def _score(tuning: Tuning, domain: Domain) -> tuple[Column, list[Column]]:
    subs = []
    for feat, metric, thr, weight, scale in domain.features:
        t = thr * tuning.anomaly_threshold_scale
        v = F.greatest(F.lit(0.0), F.col(f"kpi_{metric}"))
        raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - F.lit(t)) / F.lit(scale))) * F.lit(weight)
        subs.append(F.when((v >= F.lit(t)) & (raw > 0), F.round(raw, 3)).alias(f"b_{feat}"))
    best = subs[0] if len(subs) == 1 else F.greatest(*subs)
    score = F.coalesce(F.round(best, 3), F.lit(0.0))
    return score, subs


def _dominant(domain: Domain) -> Column:
    cands = F.array(*[F.struct((-F.col(f"{_type_key(t)}_n")).alias("neg_n"), F.col(f"{_type_key(t)}_first").alias("first"),
                               F.lit(t).alias("type")) for t in domain.types + [OTHER]])
    return F.array_min(F.filter(cands, lambda s: s["neg_n"] < 0))["type"]


def incidents_from_windows(agg: DataFrame, min_alarms: int = 5, tuning: Tuning = DEFAULT_TUNING,
                           domain: Domain = DEFAULT_DOMAIN) -> DataFrame:
    """Windows with at least `min_alarms` alarms -> scored incident rows."""
    score, subs = _score(tuning, domain)
    dom = _dominant(domain)
    m = F.create_map(*[x for k, v in domain.type_map for x in (F.lit(k), F.lit(v))])
    sub = F.coalesce(F.element_at(m, dom), F.lit(domain.default_subcategory))
    w = agg.filter(F.col("alarm_count") >= min_alarms)
    return w.select(
        incident_ref("element_id", F.col("win.start")).alias("incident_ref"), "element_id",
        F.col("win.start").alias("window_start"), F.col("win.end").alias("window_end"),
        "first_ts", "last_ts", "alarm_count",
        severity_name("severity_rank").alias("severity"), dom.alias("dominant_type"),
        sub.alias("subcategory"), category_of(sub).alias("category"),
        score.alias("anomaly_score"), *subs)


def stream_correlate(stream: DataFrame, out_path: str, checkpoint: str, *, mode: str = "tumbling",
                     size: str = "15 minutes", watermark: str = "10 minutes", min_alarms: int = 5,
                     tuning: Tuning = DEFAULT_TUNING, domain: Domain = DEFAULT_DOMAIN, available_now: bool = True):
    """Start the streaming job; returns the StreamingQuery."""
    agg = window_aggregate(stream, mode=mode, size=size, watermark=watermark, domain=domain)
    inc = incidents_from_windows(agg, min_alarms, tuning, domain)
    spark = stream.sparkSession
    late_path = f"{checkpoint.rstrip('/')}/late_rows"
    delay = spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + INTERVAL {watermark})").first()[0]
    out = inc.select(F.struct(*inc.columns).alias("inc"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("timestamp").alias("end"))
    ts = F.col("ts").cast("timestamp_ltz")
    end = F.window("ts", size)["end"] if mode == "tumbling" else F.col("ts") + F.expr(f"INTERVAL {size}")
    rows = stream.select(ts.alias("ts")).filter("ts IS NOT NULL").select("ts", end.alias("end"))
    both = out.unionByName(rows.select(F.lit(None).cast(out.schema["inc"].dataType).alias("inc"), "ts", "end"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the engine drops by the watermark of the batch before; it advances when a batch ends
        dropped_by, current = 0, 0
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{late_path}/batch={batch_id - 1}").first()
            dropped_by, current = before["watermark_ms"], before["next_ms"]
        seen = Observation()
        observed = batch.observe(seen, F.count_if(F.unix_micros("end") <= dropped_by * 1000).alias("late"),
                                 F.max(F.unix_millis("ts")).alias("max_ms"))
        observed.filter("inc IS NOT NULL").select("inc.*").write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch={batch_id}")
        top = seen.get["max_ms"]
        row = (int(seen.get["late"]), current, max(current, top - delay) if top is not None else current)
        (batch.sparkSession.createDataFrame([row], "late long, watermark_ms long, next_ms long").coalesce(1)
         .write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}"))

    w = both.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    query = w.start()
    query.late_rows_path = late_path
    return query


def late_rows(query) -> int:
    """All alarms of the job's checkpoint that were dropped behind the watermark, exactly.
    query: what `stream_correlate` returned."""
    spark = SparkSession.active()
    return int(spark.read.parquet(query.late_rows_path).agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0])
