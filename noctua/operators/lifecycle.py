"""Row lifecycle: archive of dead patterns (X1) and retention (X2), plus the
approximate near-pair search by locality-sensitive hashing (J5, option c)."""

from __future__ import annotations

import datetime as _dt
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_of_col, minus_interval, stored
from .knn import near_pairs

# Retention periods in days (documented TTLs of the source schema).
RETENTION_DAYS = {"network_alarms": 14, "incidents": 90}


def archive(memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(live rows, archived rows) - archived = superseded or not active."""
    dead = (F.col("status") != "active") | F.col("superseded_by").isNotNull()
    return memory.filter(~dead), memory.filter(dead).withColumn("archived_reason", F.when(
        F.col("superseded_by").isNotNull(), F.lit("superseded")).otherwise(F.col("status")))


def expire(df: DataFrame, ts: str, as_of=None, days: int = 14) -> DataFrame:
    """Flag rows whose `ts` is older than as_of - days (`expired`)."""
    now = as_of_col(as_of, df, ts)
    return df.withColumn("expired", F.col(ts) < minus_interval(now, days, "DAY"))


def expire_partitions(store, as_of: str, days: int, writer: str = "retention", batch: int | None = None) -> DataFrame:
    """X2 on a stored table partitioned by date: drop the partitions that lie wholly before
    as_of - days (no row is read or written); rows without a date stay.  Returns the dropped dates."""
    from ..sources.store import UNDATED
    limit = _dt.datetime.fromisoformat(str(as_of)) - _dt.timedelta(days=days)
    old = (F.col("part") != UNDATED) & (F.col("part") < limit.strftime("%Y-%m-%d"))
    gone = store.parts().filter(old)
    store.drop(old, writer, limit.toordinal() if batch is None else batch)
    return gone


def plane(number: int, dim: int, seed: int) -> list[float]:
    """One random direction: md5 of seed, plane and component gives its uniform components, so
    that any engine can restate it."""
    return [int(hashlib.md5(f"{seed}:{number}:{d}".encode()).hexdigest()[:8], 16) / 2**32 - 0.5 for d in range(dim)]


def _signatures(bands: int, bits: int, seed: int):
    """Per row: one (band, bucket) per band from sign random projections."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for pdf in batches:
            for width, part in pdf.groupby(pdf["v"].map(len), sort=False):
                if width not in planes:
                    planes[width] = np.array([plane(n, width, seed) for n in range(bands * bits)]).reshape(bands * bits, width)
                V = np.vstack([np.asarray(v, dtype=np.float64) for v in part["v"].to_numpy()])
                signs = (V @ planes[width].T) > 0
                keys = (signs.reshape(len(part), bands, bits) * weights).sum(axis=2)
                yield pd.DataFrame({
                    "id": np.repeat(part["id"].to_numpy(), bands),
                    "bucket": (np.tile(np.arange(bands, dtype=np.int64), len(part)) << bits) | keys.reshape(-1),
                })
    return run


BUCKET_ROWS = 64      # rows of an average bucket, at any table size
LSH_RECALL = 0.98     # at the threshold


def lsh_design(rows: int, threshold: float) -> tuple[int, int]:
    """(bands, bits): bits grow with log2 of the table so that buckets keep their
    size; bands follow from the recall.  One bit agrees with p = 1 - acos(1 - d) / pi."""
    p = 1 - math.acos(1 - threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS)))
    return max(1, math.ceil(math.log(1 - LSH_RECALL) / math.log(1 - p ** bits))), bits


def near_pairs_lsh(df: DataFrame, threshold: float, *, id_col: str = "id", vec_col: str = "vec",
                   bands: int | None = None, bits: int | None = None, seed: int = 7) -> DataFrame:
    """Approximate J5 by SimHash banding: `bits` sign random projections per
    band must all agree (AND), any of `bands` bands may match (OR); by default
    both follow from the row count (`lsh_design`).  Only ids and buckets are
    shuffled; vectors are joined back for buckets of two rows or more, where
    candidates are checked exactly with the blocked pair kernel, so results are
    exact pairs (recall < 1, precision 1) and a hot bucket is split into blocks."""
    base = (df.filter(F.col(vec_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")))
    if bands is None or bits is None:
        bands, bits = lsh_design(base.count(), threshold)
    id_t = df.schema[id_col].dataType.simpleString()
    sig = stored(base.mapInPandas(_signatures(bands, bits, seed), f"id {id_t}, bucket long"), "lsh")
    met = sig.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # merged: the files of ids and buckets are a small part of their rows, which must not be broadcast for that
    pairs = near_pairs(sig.join(met.hint("merge"), "bucket"), threshold, id_col="id", key="bucket", vectors=base)
    return pairs.groupBy("id_a", "id_b").agg(F.min("distance").alias("distance"))
