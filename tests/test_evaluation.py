import os

from pyspark.sql import functions as F

from noctua.operators import evaluation as EV
from noctua.operators.encoder import hashing_encode
from noctua.sources import tables as T


def _substrate(spark):
    t = spark.createDataFrame([("t1", "link down core", "L1"), ("t2", "link down edge", "L1"), ("t3", "fan broken", "L2")],
                              "ticket_id string, summary string, subcategory string")
    t = t.join(hashing_encode(t, "ticket_id", "summary", out="embedding"), "ticket_id")
    m = spark.createDataFrame([(1, "link down", 0.9)], "id long, content string, confidence double").withColumns(
        {"scope": F.lit("global"), "category": F.lit("pattern"), "evidence_count": F.lit(1), "status": F.lit("active"),
         "superseded_by": F.lit(None).cast("long")})
    m = m.join(hashing_encode(m, "id", "content", out="memory_vec"), "id")
    rb = spark.createDataFrame([(1, "fan broken")], "id long, title string").withColumns(
        {"trigger_condition": F.lit("x"), "steps": F.lit("[]"), "confidence": F.lit(0.6), "success_count": F.lit(0), "fail_count": F.lit(0),
         "status": F.lit("active"), "superseded_by": F.lit(None).cast("long")})
    return t, m, rb.join(hashing_encode(rb, "id", "title", out="runbook_vec"), "id")


ITEMS = [("t1", "link down core", "L1"), (None, "link down core", "L1"), (None, "link down core", "L1"),
         (None, "fan broken", "L2"), (None, "", "L2"), (None, None, None)]


def test_labelled_items_keep_every_row_and_leave_out_the_own_ticket(spark, tmp_out):
    path = os.path.join(tmp_out, "labelled")
    T.save_labelled(spark.createDataFrame(ITEMS, "ticket_id string, text string, true_subcat string").repartition(1), path)
    items = EV.labelled_items(T.load_labelled(spark, path, lines=True))
    rows = items.collect()
    assert len(rows) == len({r.ticket_id for r in rows}) == 6
    assert sorted(r.query_vec is None for r in rows) == [False] * 4 + [True] * 2
    t, m, rb = _substrate(spark)
    parts = EV.eval_parts(items, t, m, rb, 1)
    by_item = {r.query_id: r for r in EV.item_quality(parts, [1.0], t).collect()}
    for r in rows:                                       # t1 leaves itself out and meets t2; nameless copies meet t1
        got = by_item[r.ticket_id]
        assert (got.precision, got.rr, got.top1) == ((1.0, 1.0, True) if r.query_vec is not None else (0.0, 0.0, False))


def test_evaluate_labelled_counts_unanswered_items_as_escalated(spark):
    t, m, rb = _substrate(spark)
    items = spark.createDataFrame(ITEMS, "ticket_id string, text string, true_subcat string")
    e = EV.evaluate_labelled(items, t, m, rb, k=1, alpha=1.0).first()
    assert e.n_items == 6 and e.classification_top1_accuracy == round(4 / 6, 3)
    assert e.shortcut_rate == 0.5 and e.escalation_rate == round(5 / 6, 3)


def test_labelled_items_of_an_empty_file(spark):
    assert EV.labelled_items(spark.createDataFrame([], T.LABELLED_SCHEMA)).count() == 0
