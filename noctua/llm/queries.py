"""Registered queries of this package: each reads its whole table, applies one
operator with production parameters and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, centroids, chat, jaccard, langid, lexical, mtree, packing, pages, pii, secret_scan, segment, urls
from .catalog import query
from .common import read, span_digest, span_text
from .oracles import OP1, OP2, OP4, OP6, OP7, OP11, OP12


def count_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op2_pii", OP2)
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[count_kind("pii_base", k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
                        span_digest(F.col("pii_base")).alias("base_sha256"), span_text(F.col("pii_spans")).alias("spans"))


@query("op6_url_filter", OP6)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_secret_scan", OP7)
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[count_kind("secret_base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        span_digest(F.col("secret_base")).alias("base_sha256"), span_text(F.col("secret_spans")).alias("spans"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return told.select("doc_id", langid.fold_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_embedding_near_dup", OP4)
def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op1_mtree_topk", OP1)
def op1_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return mtree.top_k(vectors, F.col("vec_id") % 50 == 0)


@query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_sampled_segmentation")
def op3_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sampled = segment.encode(docs, keep=("text_hash",)).withColumn("ids_crc32", F.crc32("pieces"))
    return segment.decode(sampled).select("doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "log_inclusion",
                                          (F.xxhash64("text") == F.col("text_hash")).alias("round_trip"))


@query("op11_centroid_clustering", OP11)
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("computed")


@query("op12_best_position_search", OP12)
def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op13_chat_windows")
def op13_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_windows(turns.unionByName(chat.probe(spark))))
