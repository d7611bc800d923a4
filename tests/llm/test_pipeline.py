import corpus_pipeline
from pyspark.sql import functions as F

from noctua.llm import langid, packing, secret_scan
from tests.llm.test_texts_llm import plain_sets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    word = docs.first().text
    more = [(10_000, word, "fr", "s", 1), (10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5),
            (None, "the thing and the other with token = abcdef123456 here", None, "s", 3), (10_004, "Their other thing was of the " * 3000, "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language"](spark, docs, SF)
    assert one.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()}
    assert {10_001, 10_002, 10_003} <= gone and len(gone) <= 4
    two = stage["near_copies"](spark, one, SF)
    rows = one.collect()
    sets = plain_sets([r.text for r in rows])
    kept = {r.doc_id for r in two.collect()}
    for r, s in zip(rows, sets):
        if r.doc_id is None:
            continue
        lower = [q.doc_id for q, t in zip(rows, sets) if q.doc_id is not None and q.doc_id < r.doc_id and s and t and len(s & t) >= 0.8 * len(s | t)]
        assert (r.doc_id in kept) == (not lower)
    assert None in kept and 10_000 not in kept
    three = stage["secrets"](spark, two, SF)
    assert three.columns == docs.columns and three.count() == two.count()
    assert secret_scan.scan(three).filter(F.size("secret_base") > 0).count() == 0
    assert "[SECRET]" in {r.doc_id: r.text for r in three.collect()}[None]
    four = stage["packing"](spark, three, SF)
    assert four.agg(F.sum("length")).first()[0] == packing.pack(three).agg(F.sum("length")).first()[0]
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()}


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and langid.ORDER == 4


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        docs = fn(spark, docs, SF)
    assert docs.count() == 0
