import datetime as dt

from noctua.operators import volume

D = dt.datetime


def _tickets(spark, rows):
    return spark.createDataFrame(rows, "ticket_id string, created_at timestamp_ntz, region string, subcategory string")


def test_planted_spike_is_severe_and_controls_are_not(spark):
    as_of = D(2024, 3, 31)
    rows = []
    n = 0
    for sub, per_day_recent in (("spiky", 30), ("calm", 5), ("calm2", 4)):
        for d in range(1, 61):
            for k in range(4 + (d % 3)):
                n += 1
                rows.append((f"t{n}", as_of - dt.timedelta(days=3 + d, hours=-1), "EU", sub))
        for d in range(3):
            for k in range(per_day_recent):
                n += 1
                rows.append((f"t{n}", as_of - dt.timedelta(days=d, hours=1), "EU", sub))
    out = {r.subcategory: r for r in volume.volume_deviation(_tickets(spark, rows), as_of).collect()}
    assert out["spiky"].verdict == "severe_deviation"
    assert out["calm"].verdict in ("within_normal_range", "significant_deviation", "abnormally_low")
    assert out["calm2"].verdict != "severe_deviation"


def test_single_baseline_day_is_insufficient_and_recent_has_no_upper_bound(spark):
    as_of = D(2024, 3, 31)
    rows = [("a", as_of - dt.timedelta(days=10), "EU", "x"),
            ("b", as_of + dt.timedelta(days=5), "EU", "x"),  # after as_of: still recent
            ("c", as_of - dt.timedelta(days=1), "EU", "x")]
    r = volume.volume_deviation(_tickets(spark, rows), as_of).collect()[0]
    assert r.recent_avg_per_day == round(2 / 3, 2)
    assert r.z_score is None and r.verdict == "insufficient_baseline"


def test_missing_days_are_absent_not_zero(spark):
    as_of = D(2024, 3, 31)
    rows = [("a", as_of - dt.timedelta(days=10), "EU", "x"), ("b", as_of - dt.timedelta(days=10), "EU", "x"),
            ("c", as_of - dt.timedelta(days=20), "EU", "x"), ("d", as_of - dt.timedelta(days=20), "EU", "x"),
            ("e", as_of - dt.timedelta(days=20), "EU", "x"), ("f", as_of - dt.timedelta(days=20), "EU", "x")]
    b = volume.daily_baseline(_tickets(spark, rows), as_of).collect()[0]
    assert b.baseline_days == 2 and b.baseline_mean == 3.0


def test_subcategory_counts_optional_region(spark):
    as_of = D(2024, 3, 31)
    rows = [("a", as_of, "EU", "x"), ("b", as_of, "US", "x"), ("c", as_of, "EU", None), ("d", as_of, "EU", "y")]
    t = _tickets(spark, rows)
    assert {(r.subcategory, r.ticket_count) for r in volume.subcategory_counts(t, as_of, 90).collect()} == {("x", 2), ("y", 1)}
    assert {(r.subcategory, r.ticket_count) for r in volume.subcategory_counts(t, as_of, 90, "EU").collect()} == {("x", 1), ("y", 1)}
