"""Tables of immutable files behind manifests.

Layout under `<base>`:

    files/<id>[/_part=<date>]/   rows, written once and never changed
    manifests/<id>/              one row (part, folder) per folder the table consists of
    commits/                     one row (seq, writer, batch, manifest, schema) per commit

A commit writes its files, then a manifest, and last its commit row; the newest
commit names the manifest that is the table.  So a reader sees a whole version
or the one before, also while a job is being repeated or after it died, and an
update or an expiry rewrites only the date partitions it touches: all other
folders are named again, not copied.

A commit is keyed by (writer, batch).  A batch that is committed already is left
alone (`done`), so replays do nothing and writers with equal batch numbers
do not meet.  Writers of one table take turns; two commits at the same time
on the same version are told apart by their manifest, and all but the
first raise `Conflict`, whose files are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

COMMIT = "seq long, writer string, batch long, manifest string, schema string"
MANIFEST = "part string, folder string"
PART = "_part"
UNDATED = "none"


class Conflict(RuntimeError):
    """Another writer committed on the same version first."""


def day(ts: str | Column) -> Column:
    """Partition value of a timestamp: its date; rows without one share a partition."""
    return F.coalesce(F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM-dd"), F.lit(UNDATED))


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _row(self, schema: str, *values) -> DataFrame:
        """One row of literals (NULLs without values): local rows would start a Python worker on every core."""
        fields = StructType.fromDDL(schema).fields
        return self.spark.range(1, numPartitions=1).select(*[F.lit(v).cast(f.dataType).alias(f.name)
                                                             for f, v in zip(fields, values or [None] * len(fields), strict=True)])

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.base}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._row(COMMIT).limit(0)

    def head(self, writer: str | None = None, below: int | None = None):
        """The newest commit (of one writer, with a batch below a number), or None.  Of commits on the
        same version the one of the smallest manifest counts."""
        rows = self._commits()
        if writer is not None:
            rows = rows.filter(F.col("writer") == writer)
        if below is not None:
            rows = rows.filter(F.col("batch") < below)
        return rows.orderBy(F.desc("seq"), "manifest").limit(1).first()

    def _state(self, writer: str, batch: int):
        """(newest commit or None, whether the writer's batch is committed), in one pass."""
        first = self._commits().groupBy("seq").agg(F.min(F.struct("manifest", "writer", "batch", "schema")).alias("c"))
        mine = (F.col("c.writer") == writer) & (F.col("c.batch") == int(batch))
        row = first.agg(F.max(F.struct("seq", "c.manifest", "c.schema")).alias("head"), F.coalesce(F.max(mine), F.lit(False)).alias("done")).first()
        return row["head"], row["done"]

    def done(self, writer: str, batch: int) -> bool:
        return self._state(writer, batch)[1]

    def _manifest(self, commit) -> DataFrame:
        if commit is None:
            return self._row(MANIFEST).limit(0)
        return self.spark.read.schema(MANIFEST).parquet(commit["manifest"])

    def parts(self) -> DataFrame:
        """Distinct partition values of the table."""
        return self._manifest(self.head()).select("part").distinct()

    def read(self, where: Column | None = None, writer: str | None = None, below: int | None = None) -> DataFrame | None:
        """The table (`where`: a condition on the partition value `part`, so other folders are
        not even listed); None before the first commit."""
        commit = self.head(writer, below)
        if commit is None:
            return None
        schema = StructType.fromJson(json.loads(commit["schema"]))
        rows = self._manifest(commit)
        folders = [r["folder"] for r in (rows if where is None else rows.filter(where)).select("folder").collect()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, df: DataFrame, by: Column | None) -> DataFrame:
        """Write rows as new files; their manifest rows."""
        path = f"{self.base}/files/{uuid.uuid4().hex}"
        if by is None:
            df.write.parquet(path)
            return self._row(MANIFEST, None, path)
        # rows of a date meet before they are written; a full date is split into several files
        dated = df.withColumn(PART, by).hint("rebalance", PART)
        dated.write.partitionBy(PART).parquet(path)
        found = self.spark.read.schema(StructType([*df.schema.fields, *StructType.fromDDL(f"{PART} string").fields])).parquet(path)
        return found.select(F.col(PART).alias("part")).distinct().select("part", F.concat(F.lit(f"{path}/{PART}="), "part").alias("folder"))

    def _commit(self, head, rows: DataFrame, schema: StructType, writer: str, batch: int) -> str:
        path = f"{self.base}/manifests/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(path)
        seq = head["seq"] + 1 if head else 1
        self._row(COMMIT, seq, writer, int(batch), path, schema.json()).write.mode("append").parquet(f"{self.base}/commits")
        first = self._commits().filter(F.col("seq") == seq).agg(F.min("manifest")).first()[0]
        if first != path:
            raise Conflict(f"version {seq} of {self.base} was committed by another writer")
        return path

    def _change(self, df: DataFrame | None, writer: str, batch: int, by: Column | None, keep) -> bool:
        head, done = self._state(writer, batch)
        if done:
            return False
        rows = keep(self._manifest(head))
        known = StructType.fromJson(json.loads(head["schema"])) if head else StructType([])
        if df is not None:
            rows = rows.unionByName(self._written(df, by))
            names = set(known.names)
            known = StructType([*known.fields, *[StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in names]])
        self._commit(head, rows, known, writer, batch)
        return True

    def append(self, df: DataFrame, writer: str, batch: int, by: Column | None = None) -> bool:
        """Add rows; False if this batch of the writer is committed already."""
        return self._change(df, writer, batch, by, lambda rows: rows)

    def overwrite(self, df: DataFrame, writer: str, batch: int, by: Column | None = None) -> bool:
        return self._change(df, writer, batch, by, lambda rows: rows.limit(0))

    def replace(self, df: DataFrame, writer: str, batch: int, by: Column, touched: DataFrame) -> bool:
        """`df` takes the place of the partitions listed in `touched` (column part); all others stay."""
        return self._change(df, writer, batch, by, lambda rows: rows.join(touched.select("part").distinct(), "part", "left_anti").select("part", "folder"))

    def drop(self, where: Column, writer: str, batch: int) -> bool:
        """Remove the partitions whose value meets a condition; no file is read or written."""
        return self._change(None, writer, batch, None, lambda rows: rows.filter(~F.coalesce(where, F.lit(False))))
