"""Table I/O and row-level changes without a table format.

Changes are never in-place: `upsert` and `update_columns` return the next state
of the rows as a DataFrame, and a `Store` (see `store`) commits it: old files
stay readable, a version counts once its commit row is written, and a batch
that a writer has committed already is left alone when it is repeated.

`upsert_into` is S3 on a stored table: only the date partitions that hold or
receive source rows are read and rewritten.  `append_batch` / `read_batches`
add the writer and its batch number to the rows of an append-only table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Store, day


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Full-row scan with a declared schema (no inference)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Append rows (alarm events, gated patterns, checkpoints)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_alarms(alarms: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append alarm events; a map-typed KPI snapshot is stored as JSON text."""
    df = alarms
    if "metrics" in df.columns and df.schema["metrics"].dataType.typeName() == "map":
        df = df.withColumn("metrics", F.to_json("metrics"))
    append(df, path, partition_by)


def _unique_guard(source: DataFrame, keys: list[str]) -> DataFrame:
    """Fail the job (lazily, on executors) if the source repeats a key."""
    dup = source.groupBy(*keys).agg(F.count("*").alias("_dupn")).filter("_dupn > 1")
    guarded = source.join(dup, keys, "left")
    ok = F.when(F.col("_dupn").isNotNull(),
                F.raise_error(F.concat(F.lit("upsert source repeats key "), F.to_json(F.struct(*keys))))
                ).otherwise(F.lit(True))
    return guarded.filter(ok).drop("_dupn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """S3: insert source rows with new keys; for an existing key change only
    `update_cols` (from the source), every other column keeps the target's."""
    src = _unique_guard(source, keys)
    cols = target.columns
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in cols], F.lit(True).alias("_in_t"))
    s = src.select(*[(F.col(c) if c in src.columns else F.lit(None).cast(target.schema[c].dataType)).alias(f"s_{c}")
                     for c in cols], F.lit(True).alias("_in_s"))
    cond = None
    for k in keys:
        c = t[f"t_{k}"] == s[f"s_{k}"]
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")
    out = []
    for c in cols:
        if c in keys:
            v = F.coalesce(F.col(f"t_{c}"), F.col(f"s_{c}"))
        elif c in update_cols:
            v = F.when(F.col("_in_s").isNotNull(), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}"))
        else:
            v = F.when(F.col("_in_t").isNotNull(), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}"))
        out.append(v.cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


def update_columns(target: DataFrame, changes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Set `cols` from `changes` for matching keys; other rows unchanged."""
    ch = _unique_guard(changes.select(*keys, *cols), keys)
    ch = ch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = target.join(ch, keys, "left")
    sel = [F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
           if c in cols else F.col(c) for c in target.columns]
    return j.select(*sel)


def widened(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df` with the columns it lacks as NULLs."""
    return df.unionByName(like.limit(0), allowMissingColumns=True)


def upsert_into(store: Store, source: DataFrame, keys: list[str], update_cols: list[str], ts: str, writer: str, batch: int) -> bool:
    """S3 on a stored table that is partitioned by the date of `ts`, which a known key keeps."""
    touched = source.select(day(ts).alias("part")).distinct()
    before = store.read(where=F.col("part").isin([r["part"] for r in touched.collect()]))       # one value per touched date
    if before is None:
        return store.append(source, writer, batch, by=day(ts))
    before = widened(before, source)
    changed = upsert(before, source, keys, [c for c in update_cols if c in before.columns])
    return store.replace(changed, writer, batch, day(ts), touched)


def write_snapshot(df: DataFrame, base: str, version: int, writer: str = "snapshot") -> str:
    """Commit `df` as the whole table; a version that this writer has committed stays as it is."""
    Store(df.sparkSession, base).overwrite(df, writer, version)
    return base


def read_latest(spark: SparkSession, base: str, below: int | None = None) -> DataFrame | None:
    """The table's newest version (optionally of a batch below a number); None when there is none."""
    return Store(spark, base).read(below=below)


def append_batch(df: DataFrame, base: str, version: int, writer: str = "append") -> str:
    """Rows of one batch of one writer, added exactly once."""
    rows = df.withColumns({"writer": F.lit(writer), "batch_version": F.lit(int(version)).cast("long")})
    Store(df.sparkSession, base).append(rows, writer, version)
    return base


def read_batches(spark: SparkSession, base: str) -> DataFrame | None:
    """All committed batches of an append-only table, with their writer and
    batch_version; columns that a batch lacks are NULL."""
    return Store(spark, base).read()


LABELLED_SCHEMA = "ticket_id string, text string, true_subcat string"


def load_labelled(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{ticket_id?, text, true_subcat} items, as one JSON list per file (read by one task each)
    or, with `lines`, one object a line (`save_labelled`; files are split among tasks)."""
    return spark.read.schema(LABELLED_SCHEMA).option("multiLine", not lines).json(path)


def save_labelled(items: DataFrame, path: str) -> None:
    """The items as JSON lines, read back by `load_labelled(lines=True)`."""
    items.select("ticket_id", "text", "true_subcat").write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """Sweep / evaluation rows as JSON lines."""
    df.write.mode("overwrite").json(path)
