"""Ticket volume jobs over v_tickets_volume (as_of = latest created_at)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import volume
from ..sources.fixtures import view, with_views
from .catalog import query

_BASE = """
WITH a AS (SELECT max(created_at) AS as_of FROM v_tickets_volume),
t AS (SELECT subcategory, created_at FROM v_tickets_volume WHERE subcategory IS NOT NULL),
daily AS (SELECT subcategory, CAST(created_at AS DATE) AS d, count(*) AS daily FROM t, a
          WHERE created_at < as_of - INTERVAL 3 DAY AND created_at >= as_of - INTERVAL 63 DAY GROUP BY 1, 2),
base AS (SELECT subcategory, count(*) AS baseline_days, avg(daily) AS m, stddev_samp(daily) AS s FROM daily GROUP BY 1),
recent AS (SELECT subcategory, count(*) AS n FROM t, a WHERE created_at >= as_of - INTERVAL 3 DAY GROUP BY 1)
"""


@query("daily_baseline", with_views(["v_tickets_volume"], _BASE + """
SELECT subcategory, baseline_days, round(m, 6) AS baseline_mean, round(s, 6) AS baseline_stddev FROM base"""))
def q_daily_baseline(spark, sf_dir):
    t = view(spark, sf_dir, "v_tickets_volume")
    b = volume.daily_baseline(t)
    return b.select("subcategory", "baseline_days", F.round("baseline_mean", 6).alias("baseline_mean"),
                    F.round("baseline_stddev", 6).alias("baseline_stddev"))


@query("volume_deviation", with_views(["v_tickets_volume"], _BASE + """,
j AS (SELECT coalesce(r.subcategory, b.subcategory) AS subcategory, coalesce(r.n, 0) / 3.0 AS recent,
             coalesce(b.m, 0) AS mean, coalesce(b.s, 0) AS std
      FROM recent r FULL OUTER JOIN base b ON r.subcategory = b.subcategory),
z AS (SELECT *, CASE WHEN std > 0 THEN round((recent - mean) / std, 2) END AS z_score FROM j)
SELECT subcategory, round(recent, 2) AS recent_avg_per_day, round(mean, 2) AS baseline_mean,
       round(std, 2) AS baseline_stddev, z_score,
       CASE WHEN z_score IS NULL THEN 'insufficient_baseline' WHEN z_score >= 3 THEN 'severe_deviation'
            WHEN z_score >= 2 THEN 'significant_deviation' WHEN z_score <= -2 THEN 'abnormally_low'
            ELSE 'within_normal_range' END AS verdict
FROM z"""))
def q_volume_deviation(spark, sf_dir):
    return volume.volume_deviation(view(spark, sf_dir, "v_tickets_volume"))


@query("subcategory_counts", with_views(["v_tickets_volume"], """
WITH a AS (SELECT max(created_at) AS as_of FROM v_tickets_volume)
SELECT subcategory, count(*) AS ticket_count FROM v_tickets_volume, a
WHERE created_at >= as_of - INTERVAL 90 DAY AND subcategory IS NOT NULL GROUP BY 1"""))
def q_subcategory_counts(spark, sf_dir):
    return volume.subcategory_counts(view(spark, sf_dir, "v_tickets_volume"), days=90)


@query("subcategory_counts_region", with_views(["v_tickets_volume"], """
WITH a AS (SELECT max(created_at) AS as_of FROM v_tickets_volume)
SELECT subcategory, count(*) AS ticket_count FROM v_tickets_volume, a
WHERE created_at >= as_of - INTERVAL 30 DAY AND subcategory IS NOT NULL AND region = 'ASIA' GROUP BY 1"""))
def q_subcategory_counts_region(spark, sf_dir):
    return volume.subcategory_counts(view(spark, sf_dir, "v_tickets_volume"), days=30, region="ASIA")
