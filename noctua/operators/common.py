"""Shared plan helpers: the `as_of` instant, stored intermediates, and
deterministic ranking columns."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def as_of_col(as_of, df: DataFrame | None = None, ts_col: str | None = None, lazy: bool = False) -> Column:
    """The fixed `now` of one run, as a Column.

    A datetime/str becomes a literal.  None means "latest event time in
    `df`": resolved by one single-column aggregate into a literal, so the
    time-window filters built on it are pushed into the Parquet scan (row
    group skipping, partition pruning) instead of scanning all history.
    Only that one scalar passes through the driver.  `lazy=True` keeps it a
    scalar subquery inside the plan instead."""
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        if df is None or ts_col is None:
            raise ValueError("as_of is required")
        if lazy:
            return df.select(F.max(ts_col)).scalar()
        value = df.select(F.max(ts_col).alias("_m")).first()["_m"]
        return F.lit(value).cast(df.select(F.col(ts_col)).schema[0].dataType)
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of)


def minus_interval(ts: Column, n, unit: str) -> Column:
    """ts - n units (unit: DAY, HOUR, MINUTE)."""
    return ts - F.expr(f"INTERVAL {int(n)} {unit.upper()}S")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet below the shared checkpoint folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_n(df: DataFrame, partition_by, order_by: list, n: int, rank_col: str = "rank") -> DataFrame:
    """Per-key top-n with a 1-based long rank (plans as WindowGroupLimit + Window)."""
    w = Window.partitionBy(*([partition_by] if isinstance(partition_by, (str, Column)) else partition_by)).orderBy(*order_by)
    ranked = df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    return ranked.filter(F.col(rank_col) <= n) if n is not None else ranked
