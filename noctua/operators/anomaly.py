"""D2 anomaly scoring and D3 type -> subcategory mapping.

Scoring joins the per-(entity, metric) worst values with the 7-row feature
table (broadcast: fixed size) instead of looping over features in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANOMALY_FEATURES, DEFAULT_DOMAIN, DEFAULT_TUNING, Domain, Tuning, features_df

FEATURE_NAMES = [f[0] for f in ANOMALY_FEATURES]


def feature_subscores(worst: DataFrame, key: str = "element_id", tuning: Tuning = DEFAULT_TUNING,
                      domain: Domain = DEFAULT_DOMAIN) -> DataFrame:
    """(key, metric, worst) -> (key, feature, sub) for features over threshold.

    t = threshold * knob; values below t are skipped; sub = min(1, max(0,
    (v - t) / scale)) * weight, kept when > 0 before rounding to 3."""
    feats = F.broadcast(features_df(worst.sparkSession, tuning.anomaly_threshold_scale, domain))
    j = worst.join(feats, "metric").filter(F.col("worst") >= F.col("threshold"))
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("worst") - F.col("threshold")) / F.col("scale"))) * F.col("weight")
    return (j.select(key, "feature", raw.alias("raw"))
            .filter(F.col("raw") > 0)
            .select(key, "feature", F.round("raw", 3).alias("sub")))


def score_anomaly(worst: DataFrame, key: str = "element_id", tuning: Tuning = DEFAULT_TUNING,
                  domain: Domain = DEFAULT_DOMAIN) -> DataFrame:
    """(key, metric, worst) -> (key, anomaly_score, anomaly_breakdown map, one
    column per feature).  Entities with no feature over threshold score 0.0;
    the score is the max of the rounded sub-scores."""
    subs = feature_subscores(worst, key, tuning, domain)
    per_feature = [F.max(F.when(F.col("feature") == f[0], F.col("sub"))).alias(f"b_{f[0]}") for f in domain.features]
    scored = (subs.groupBy(key)
              .agg(F.round(F.max("sub"), 3).alias("anomaly_score"),
                   F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "sub")))).alias("anomaly_breakdown"),
                   *per_feature))
    entities = worst.select(key).distinct()
    return (entities.join(scored, key, "left")
            .withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(0.0)))
            .withColumn("anomaly_breakdown", F.coalesce("anomaly_breakdown", F.create_map().cast("map<string,double>"))))


def type_to_subcategory(alarm_type, domain: Domain = DEFAULT_DOMAIN) -> Column:
    """D3: mapping expression with the default for unlisted types."""
    c = F.col(alarm_type) if isinstance(alarm_type, str) else alarm_type
    m = F.create_map(*[x for k, v in domain.type_map for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, c), F.lit(domain.default_subcategory))
