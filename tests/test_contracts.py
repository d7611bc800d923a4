import os

import pytest
from pyspark.sql import functions as F

from noctua.plans.q_contracts import PLANTED, planted_tables
from noctua.sources import quality as Q

SF = "/root/testdata/sf0.001"


def test_planted_rows_give_every_reason(spark, tmp_out):
    """At sf0.001 some tables are shorter than the period; those are checked for equal counts only."""
    from noctua.sources.fixtures import register
    register(spark, SF, [view for view, *_ in PLANTED.values()])
    got = Q.intake_all(planted_tables(spark, SF), tmp_out)
    for name, i in got.items():
        reasons = {r.reason: r["count"] for r in i.quarantine.groupBy("reason").count().collect()}
        expected = {k: v for k, v in i.counts.items() if k not in ("rows", "accepted") and v}
        assert reasons == expected
        assert i.accepted.count() == i.counts["accepted"] == i.counts["rows"] - sum(reasons.values())
        assert "reason" not in i.accepted.columns
        if i.counts["rows"] > 500:
            assert set(reasons) == set(Q.rule_names(Q.CONTRACTS[name])), name


def test_first_broken_rule_counts_and_nulls_refer_to_nothing(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "zz", "gone"), (4, "a", "x"), (4, "a", "x")], "id long, kind string, ref string")
    contract = Q.Contract(key=("id",), not_null=("kind",), enums={"kind": ["a", "b"]}, references={"ref": ("others", "name")})
    others = spark.createDataFrame([("x",), ("x",), (None,)], "name string")
    out = sorted((r.id, r.reason) for r in Q.validate(rows, contract, {"others": others}).collect())
    assert out == [(1, None), (2, "null:kind"), (3, "enum:kind"), (4, "duplicate:id"), (4, "duplicate:id")]
    without = {r.reason for r in Q.validate(rows.filter("id = 3"), contract).collect()}
    assert without == {"enum:kind"}


def test_hot_reference_value_keeps_all_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ref"))
    out = Q.validate(rows, Q.Contract(key=("id",), references={"ref": ("t", "k")}), {"t": spark.createDataFrame([("5",)], "k string")})
    assert out.filter("reason IS NULL").count() == 1
    assert out.filter("reason = 'reference:ref'").count() == 2999


@pytest.mark.parametrize("name", list(Q.CONTRACTS))
def test_empty_tables(spark, tmp_out, name):
    tables = {n: df.limit(0) for n, df in planted_tables(spark, SF).items()}
    i = Q.intake(tables[name], Q.CONTRACTS[name], os.path.join(tmp_out, "x"), tables)
    assert i.accepted.count() == i.quarantine.count() == i.counts["rows"] == 0


def test_every_rule_of_every_table_is_planted(spark):
    tables = planted_tables(spark, "/root/testdata/sf0.01")
    for name, contract in Q.CONTRACTS.items():
        reasons = {r.reason for r in Q.validate(tables[name], contract, tables).select("reason").distinct().collect()} - {None}
        assert reasons == set(Q.rule_names(contract)), name
