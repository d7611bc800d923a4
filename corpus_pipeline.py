"""Corpus pipeline: language ID, n-gram Jaccard join, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of `documents`.  Between stages the
rows are written as Parquet below `spark.checkpoint.dir` and read again.

Cases: documents with a null or empty text or without letters leave in the first
stage; rows with a null doc_id are never merged with others; of rows that
share a doc_id one stays (see `drop_near_copies`); extra columns of any name, those of the
operators' own results too, are carried along unchanged by the first three stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm import jaccard, langid, packing, secret_scan
from noctua.llm.common import bounded, read, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; a missing language is filled in."""
    bounded(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    told = langid.unused("_told", docs.columns)
    judged = docs.withColumn(told, langid.judge(spark, model)(F.col("text"))).filter(~F.col(f"{told}.rejected"))
    found = F.when(F.col(f"{told}.lang_pred") != "und", F.col(f"{told}.lang_pred"))
    return judged.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: the smallest doc_id.  Of rows
    that share this doc_id the one with the smallest text stays (then by the row's JSON)."""
    bounded(spark)
    judged = jaccard.jaccard_join(docs).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = docs.join(judged, "doc_id", "left_semi").select(*docs.columns)
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count()
    if not ids.filter("count > 1").isEmpty():
        place = langid.unused("_place", docs.columns)
        order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), F.to_json(F.struct(*docs.columns)))
        kept = kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by a mark; every document stays."""
    # columns travel under numbered names, so that none clashes with the scan's own
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scanned = secret_scan.scan(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), text=names["text"])
    clean = secret_scan.redact(scanned, text=names["text"])
    if "n_chars" in names:
        length = F.length(names["text"]).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn(names["n_chars"], F.when(F.size("secret_spans") > 0, length).otherwise(F.col(names["n_chars"])))
    return clean.select(*[F.col(n).alias(c) for c, n in names.items()])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    bounded(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                     "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

# trained models, token ids and approximate joins cannot be stated in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
