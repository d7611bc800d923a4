"""Helpers shared by the operators of this package.

* `read` - one table of a scale directory, by Spark's reader only.
* `stored` - cut lineage: write a frame as Parquet below the shared folder
  (`spark.checkpoint.dir`) and read it back; survives lost executors.
* `components` - connected components by alternating star contraction; no
  edge, label or component ever passes through the driver.
* `span_text` / `span_digest` / `regex_spans` - native span helpers (code point offsets).
"""

from __future__ import annotations

import sys

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path


def bounded(spark: SparkSession) -> SparkSession:
    """Session settings of this package: rows of the text tables can be very long,
    so Arrow batches end at a number of bytes (and rows)."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def own_prefix(columns) -> str:
    """A prefix that no given column starts with (in any case), for an operator's helper columns."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def per_worker(key: str, make):
    """One object per Python worker process and Spark stage.  This package's functions
    travel by value, so module globals would start anew with every task; what
    earlier stages left in the worker is let go."""
    store = vars(sys).setdefault("_noctua_llm", {})
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if store.get("stage") != stage:
        store.clear()
        store["stage"] = stage
    if key not in store:
        store[key] = make()
    return store[key]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links between long ids -> (id, component): the smallest id reachable.

    Alternating large-star / small-star contraction (Kiveris et al., 2014):
    every node hooks its larger neighbours, then its smaller ones, onto the
    smallest id it can see, until the edge set is a forest of stars.  The
    number of rounds is logarithmic and unbounded by any parameter.  Minima
    are map-side combined, so a hub with most of the edges is pre-aggregated;
    the joins back to the edges may be split by AQE.  Nodes without links do
    not appear.  Self links and null ends are ignored."""
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), name)
    while True:
        # large star: for every node m = min over itself and its neighbours; larger neighbours hook to m
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: every node with smaller neighbours hooks them and itself onto the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        cur = stored(small, name)
        # a forest of stars: every node hooked once, and none that others hook onto is hooked itself
        ends = (cur.groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("hub"))
                .unionByName(cur.groupBy(F.col("v").alias("x")).agg(F.lit(1).cast("long").alias("n"), F.lit(1).alias("hub"))))
        if ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("hub").alias("hub")).filter("n > 1").isEmpty():
            break
    roots = cur.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def regex_spans(text: Column, pattern: str, idx: int, kind: str, keep=None) -> Column:
    """Leftmost non-overlapping matches of a (never empty) pattern as an array
    of (start, idx, end, kind, match), offsets in code points, end exclusive.

    Spark returns matches without offsets; the pieces between them (`split`)
    give the gaps, and a running sum over the few matches the offsets.  The
    split runs only on rows that have a match.  `keep(match)` filters."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    spans = "array<struct<start:int,idx:int,end:int,kind:string,match:string>>"
    zipped = F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda x: F.length(x)), hits,
                        lambda g, m: F.struct(g.alias("gap"), m.alias("m")))

    def step(acc, x):
        s = acc["pos"] + x["gap"]
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("start"), F.lit(idx).alias("idx"), e.alias("end"), F.lit(kind).alias("kind"),
                               x["m"].alias("match")))
        return F.struct(e.alias("pos"), F.concat(acc["out"], one).alias("out"))

    empty = F.array().cast(spans)
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    out = F.when(F.size(hits) > 0, found).otherwise(empty)
    return F.filter(out, lambda s: keep(s["match"])) if keep else out


def span_text(spans: Column) -> Column:
    """kind:start:end of every span by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(spans: Column) -> Column:
    return F.sha2(span_text(spans), 256)
