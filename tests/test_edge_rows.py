"""Literal edge rows for what the generated test tables lack (FIXTURES.md section 3)."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaign_analytics.functions import expressions as X
from campaign_analytics.operators import ingest, joins, kpis, profiles, quality, segments, viability
from campaign_analytics.schemas import AB_TEST_REF, CONSUMER, ORDER_RAW, RESTAURANT

ABT = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_created_at", T.TimestampType()),
        T.StructField("order_total_amount", T.DoubleType()),
        T.StructField("order_scheduled", T.BooleanType()),
        T.StructField("ab_group", T.StringType()),
    ]
)


def raw(spark, rows):
    text = lambda v: v if v is None or isinstance(v, str) else str(v)
    return spark.createDataFrame([tuple(text(r.get(f.name)) for f in ORDER_RAW) for r in rows], ORDER_RAW)


def abt(spark, rows):
    return spark.createDataFrame(rows, ABT)


def item(discount):
    return {"name": "x", "discount": {"value": discount, "currency": "BRL"}}


def test_items_json_parsing(spark):
    rows = [
        {"order_id": "1", "items": None},
        {"order_id": "2", "items": "not json at all"},
        {"order_id": "3", "items": "[]"},
        {"order_id": "4", "items": json.dumps(item("1.5"))},
    ]
    typed = ingest.type_orders(raw(spark, rows))
    got = {r.order_id: r.n for r in typed.select("order_id", F.size("items").alias("n")).collect()}
    assert got["3"] == 0 and got["4"] == 1
    nulls = {r.order_id for r in typed.filter(F.col("items").isNull()).collect()}
    assert nulls == {"1", "2"}
    first = typed.filter("order_id = '4'").select(F.col("items")[0]["discount"]["value"].alias("v")).first()
    assert first.v == "1.5"


@pytest.mark.parametrize(
    "discount,lenient,strict",
    [(None, 0.0, None), ("", 0.0, None), ("10", 10.0, 10.0), ("abc", 0.0, None)],
)
def test_discount_fold_null_blank_number(spark, discount, lenient, strict):
    typed = ingest.type_orders(raw(spark, [{"order_id": "1", "items": json.dumps([item(discount), item("2.25")])}]))
    out = typed.select(
        X.order_discount("items").cast("double").alias("lenient"),
        X.order_discount("items", strict_nulls=True).cast("double").alias("strict"),
    ).first()
    assert out.lenient == lenient + 2.25
    assert out.strict == (None if strict is None else strict + 2.25)


def test_discount_fold_empty_and_null_arrays(spark):
    typed = ingest.type_orders(raw(spark, [{"order_id": "1", "items": "[]"}, {"order_id": "2", "items": None}]))
    got = {r.order_id: r.d for r in typed.select("order_id", X.order_discount("items").alias("d")).collect()}
    assert float(got["1"]) == 0.0 and got["2"] is None
    total = kpis.total_discount(typed).first().total_discount
    assert total == 0.0


def test_coordinates_and_timestamps(spark):
    rows = [
        {"order_id": "1", "merchant_latitude": "-23.5571", "order_created_at": "2019-01-05T12:30:00.000Z"},
        {"order_id": "2", "merchant_latitude": "x", "order_created_at": "not a time"},
        {"order_id": "3", "merchant_latitude": None, "order_created_at": None},
    ]
    typed = ingest.type_orders(raw(spark, rows))
    got = {r.order_id: r for r in typed.select("order_id", "merchant_latitude", "order_created_at").collect()}
    assert got["1"].merchant_latitude == -23.56
    assert got["1"].order_created_at == datetime(2019, 1, 5, 12, 30)
    assert got["2"].merchant_latitude is None and got["2"].order_created_at is None
    assert got["3"].merchant_latitude is None and got["3"].order_created_at is None
    assert dict(typed.dtypes)["order_created_at"] == "timestamp"


def test_same_order_two_identities_kept_counted_once_flagged_and_deduplicated(spark):
    rows = [
        {"order_id": "o1", "cpf": "a", "customer_id": "c1", "order_created_at": "2018-03-01T10:00:00Z",
         "order_total_amount": 10.0},
        {"order_id": "o1", "cpf": "b", "customer_id": "c1", "order_created_at": "2019-03-01T10:00:00Z",
         "order_total_amount": 20.0},
    ]
    typed = ingest.type_orders(raw(spark, rows))
    ab = spark.createDataFrame([("c1", "target")], AB_TEST_REF)
    gold = joins.build_abt(typed, spark.createDataFrame([], CONSUMER), ab, spark.createDataFrame([], RESTAURANT))
    assert gold.count() == 2
    k = kpis.ab_report(gold, "group_kpis").first()
    assert (k.order_count, k.customer_count, k.revenue) == (1, 1, 30.0)
    flagged = quality.repeated_orders(typed).first()
    assert (flagged.row_count, flagged.distinct_cpf, flagged.distinct_order_created_at) == (2, 2, 2)
    latest = ingest.keep_latest_order(typed).collect()
    assert len(latest) == 1 and latest[0].cpf == "b" and latest[0].order_created_at.year == 2019


def test_same_order_two_customers(spark):
    t = datetime(2024, 1, 2, 10)
    gold = abt(spark, [("o2", "c1", t, 5.0, False, "target"), ("o2", "c2", t, 7.0, False, "target")])
    assert kpis.ab_report(gold, "group_kpis").first().order_count == 1
    rep = segments.label_report(gold, segments.DAYPART).first()
    assert (rep.customer_count, rep.order_count, rep.revenue) == (2, 2, 12.0)
    assert rep.avg_ticket == 6.0


def test_customer_in_both_groups_takes_minimum_and_is_flagged(spark):
    t = datetime(2024, 1, 2, 10)
    ab = spark.createDataFrame([("c1", "target"), ("c1", "control")], AB_TEST_REF)
    orders = ingest.type_orders(raw(spark, [{"order_id": "o1", "customer_id": "c1", "order_total_amount": 3.0}]))
    gold = joins.build_abt(orders, spark.createDataFrame([], CONSUMER), ab, spark.createDataFrame([], RESTAURANT))
    assert sorted(r.ab_group for r in gold.collect()) == ["control", "target"]
    assert segments.customer_metrics(gold).first().ab_group == "control"
    dup = quality.duplicate_keys({"ab_test_ref": (ab, "customer_id")}).first()
    assert (dup.row_count, dup.key_count, dup.duplicated_keys) == (2, 1, 1)
    g = abt(spark, [("o1", "c1", t, 3.0, False, "control")])
    assert segments.customer_metrics(g).first().ab_group == "control"


def test_duplicate_restaurant_fans_out_and_is_flagged(spark):
    rest = spark.createDataFrame(
        [("m1", None, True, 1, 10.0, 30, 5.0, "a", "b"), ("m1", None, True, 2, 12.0, 30, 5.0, "a", "b")], RESTAURANT
    )
    ab = spark.createDataFrame([("c1", "control")], AB_TEST_REF)
    orders = ingest.type_orders(
        raw(spark, [{"order_id": "o1", "customer_id": "c1", "merchant_id": "m1", "order_total_amount": 10.0}])
    )
    gold = joins.build_abt(orders, spark.createDataFrame([], CONSUMER), ab, rest)
    assert gold.count() == 2
    k = kpis.ab_report(gold, "group_kpis").first()
    assert (k.order_count, k.revenue) == (1, 20.0)
    assert quality.duplicate_keys({"restaurant": (rest, "id")}).first().duplicated_keys == 1


def test_daypart_boundaries(spark):
    hours = [0, 5, 6, 11, 12, 13, 14, 17, 18, 23]
    rows = [(f"o{h}", "c1", datetime(2024, 1, 2, h, 30), 1.0, False, "control") for h in hours]
    got = {r.order_hour: r.daypart for r in segments.label_orders(abt(spark, rows), segments.DAYPART).collect()}
    assert got == {
        0: "late_night", 5: "late_night", 6: "morning", 11: "morning", 12: "lunch",
        13: "lunch", 14: "afternoon", 17: "afternoon", 18: "evening", 23: "evening",
    }


def test_day_types(spark):
    stamps = {
        "fri_1759": datetime(2024, 1, 5, 17, 59),
        "fri_1800": datetime(2024, 1, 5, 18, 0),
        "sat": datetime(2024, 1, 6, 9, 0),
        "sun": datetime(2024, 1, 7, 23, 0),
        "mon_0000": datetime(2024, 1, 8, 0, 0),
    }
    rows = [(k, "c1", t, 1.0, False, "control") for k, t in stamps.items()]
    got = {r.order_id: r.day_type for r in segments.label_orders(abt(spark, rows), segments.DAY_TYPE).collect()}
    assert got == {"fri_1759": "weekday", "fri_1800": "weekend", "sat": "weekend", "sun": "weekend",
                   "mon_0000": "weekday"}


def test_price_tiers(spark):
    df = spark.createDataFrame([(1.5,), (1.51,), (2.5,), (2.51,)], "m double")
    got = [r.t for r in df.select(X.price_tier("m").alias("t")).orderBy("m").collect()]
    assert got == ["budget", "mid", "mid", "premium"]


def test_frequency_null_for_one_order_and_days_between(spark):
    rows = [
        ("a1", "one", datetime(2024, 1, 1), 5.0, False, "control"),
        ("b1", "two", datetime(2024, 1, 1), 5.0, False, "control"),
        ("b2", "two", datetime(2024, 1, 11), 7.0, True, "control"),
    ]
    got = {r.customer_id: r for r in profiles.customer_features(abt(spark, rows)).collect()}
    assert got["one"].avg_days_between_orders is None
    assert got["two"].avg_days_between_orders == 10.0 and got["two"].active_days == 10
    assert got["two"].avg_ticket == 6.0
    inputs = profiles.cluster_input(profiles.customer_features(abt(spark, rows)))
    assert [r.customer_id for r in inputs.collect()] == ["two"]


def test_dominant_label_tie_goes_to_first_label(spark):
    rows = [
        ("o1", "c1", datetime(2024, 1, 2, 9), 1.0, False, "control"),
        ("o2", "c1", datetime(2024, 1, 2, 20), 1.0, False, "control"),
        ("o3", "c2", datetime(2024, 1, 2, 9), 1.0, False, "control"),
    ]
    got = {r.customer_id: r.daypart for r in segments.dominant_label(abt(spark, rows), segments.DAYPART).collect()}
    assert got == {"c1": "evening", "c2": "morning"}


def test_customer_without_segment_rows_gets_null_segment(spark):
    rows = [("o1", "c1", None, 4.0, False, "control"), ("o2", "c2", datetime(2024, 1, 2, 9), 1.0, True, "control")]
    rep = {r.daypart: r for r in segments.label_report(abt(spark, rows), segments.DAYPART).collect()}
    assert set(rep) == {None, "morning"}
    assert rep[None].customer_count == 1 and rep[None].revenue == 4.0
    assert rep["morning"].avg_scheduled_share == 1.0


def test_viability_with_one_group_gives_nulls(spark):
    rows = [("o1", "c1", datetime(2024, 1, 2, 9), 30.0, False, "target")]
    v = viability.campaign_viability(abt(spark, rows)).first()
    assert v.target_revenue == 30.0 and v.campaign_cost == 10.0
    assert v.control_revenue is None and v.incremental_revenue is None and v.net_total is None


def test_viability_identities(spark):
    t = datetime(2024, 1, 2, 9)
    rows = [
        ("o1", "t1", t, 30.0, False, "target"),
        ("o2", "t2", t, 50.0, False, "target"),
        ("o3", "c1", t, 20.0, False, "control"),
    ]
    v = viability.campaign_viability(abt(spark, rows), coupon_value=5.0).first()
    assert v.incremental_revenue == 60.0
    assert v.incremental_revenue_per_customer == 20.0
    assert v.incremental_revenue_estimated == 40.0
    assert v.campaign_cost == 10.0
    assert v.net_total == 50.0 and v.net_per_customer == 30.0


def _daypart_rule(hour):
    if hour < 6:
        return "late_night"
    if hour < 12:
        return "morning"
    if hour < 14:
        return "lunch"
    if hour < 18:
        return "afternoon"
    return "evening"


def _day_type_rule(weekday, hour):
    # weekday: Monday = 0 ... Sunday = 6
    return "weekend" if weekday in (5, 6) or (weekday == 4 and hour >= 18) else "weekday"


def test_labels_for_every_hour_of_a_week(spark):
    from datetime import timedelta

    start = datetime(2024, 1, 1)  # a Monday
    stamps = [start + timedelta(hours=h, minutes=30) for h in range(24 * 7)]
    rows = [(f"o{i}", "c1", t, 1.0, False, "control") for i, t in enumerate(stamps)]
    df = abt(spark, rows)
    parts = {r.order_created_at: r.daypart for r in segments.label_orders(df, segments.DAYPART).collect()}
    types = {r.order_created_at: r.day_type for r in segments.label_orders(df, segments.DAY_TYPE).collect()}
    for t in stamps:
        assert parts[t] == _daypart_rule(t.hour), t
        assert types[t] == _day_type_rule(t.weekday(), t.hour), t


def test_argmax_label_matches_python(spark):
    import itertools

    combos = list(itertools.product(range(3), repeat=3))
    df = spark.createDataFrame(combos, "a int, b int, c int")
    got = df.select("a", "b", "c", X.argmax_label({"b_lbl": F.col("b"), "a_lbl": F.col("a"), "c_lbl": F.col("c")}).alias("w"))
    for r in got.collect():
        counts = {"a_lbl": r.a, "b_lbl": r.b, "c_lbl": r.c}
        best = max(counts.values())
        expected = None if best == 0 else min(k for k, v in counts.items() if v == best)
        assert r.w == expected, r


def test_local_time_zone_segments(spark):
    # Friday 20:30 UTC is Friday 17:30 in Sao Paulo (UTC-3 in January 2024).
    rows = [("o1", "c1", datetime(2024, 1, 5, 20, 30), 1.0, False, "control")]
    df = abt(spark, rows)
    utc = segments.label_orders(df, segments.DAY_TYPE).first()
    local = segments.label_orders(df, segments.DAY_TYPE, time_zone="America/Sao_Paulo").first()
    assert (utc.order_hour, utc.day_type) == (20, "weekend")
    assert (local.order_hour, local.day_type) == (17, "weekday")
    assert segments.label_orders(df, segments.DAYPART, time_zone="America/Sao_Paulo").first().daypart == "afternoon"
    assert segments.dominant_label(df, segments.DAYPART, time_zone="America/Sao_Paulo").first().daypart == "afternoon"
    rep = segments.segment_reports(df, time_zone="America/Sao_Paulo")["daytype_report"].first()
    assert rep.day_type == "weekday"


def test_missing_consumer_counts(spark):
    orders = raw(spark, [{"order_id": "o1", "customer_id": "a"}, {"order_id": "o2", "customer_id": "b"},
                         {"order_id": "o3", "customer_id": None}, {"order_id": "o4", "customer_id": "a"}])
    ab = spark.createDataFrame([("a", "target"), ("c", "control"), ("d", "control")], AB_TEST_REF)
    consumer = spark.createDataFrame([("a", None, True), ("d", None, False), ("e", None, True)], CONSUMER)
    r = quality.missing_consumer(orders, ab, consumer).first()
    assert (r.order_customers, r.order_customers_missing_consumer) == (2, 1)  # a, b; b missing
    assert (r.ab_customers, r.ab_customers_missing_consumer) == (3, 1)  # a, c, d; c missing
    assert r.known_customers_missing_consumer == 2 and r.consumer_customers == 3  # b, c


def test_null_customer_shares(spark):
    orders = raw(spark, [
        {"order_id": "o1", "customer_id": "a", "order_total_amount": 30.0},
        {"order_id": "o2", "customer_id": None, "order_total_amount": 10.0},
        {"order_id": "o2", "customer_id": None, "order_total_amount": 10.0},
        {"order_id": "o3", "customer_id": "b", "order_total_amount": 50.0},
    ])
    r = quality.null_customer(ingest.type_orders(orders)).first()
    assert (r.order_rows, r.null_customer_rows, r.order_count, r.null_customer_orders) == (4, 2, 3, 1)
    assert (r.revenue, r.null_customer_revenue) == (100.0, 20.0)
    assert (r.null_order_pct, r.null_revenue_pct) == (33.33, 20.0)


def test_any_group_label_keeps_its_own_rows(spark):
    t = datetime(2024, 1, 2, 10)
    rows = [(f"o{i}", f"c{i}", t, 3.0, False, g) for i, g in enumerate(["variant_b", "target", "control", "variant_b", None])]
    got = {r.customer_id: r.ab_group for r in segments.customer_metrics(abt(spark, rows)).collect()}
    assert got == {"c0": "variant_b", "c1": "target", "c2": "control", "c3": "variant_b", "c4": None}
    report = {r.ab_group: r.customer_count for r in segments.label_report(abt(spark, rows), segments.DAYPART).collect()}
    assert report == {"variant_b": 2, "target": 1, "control": 1, None: 1}
    assert {r.customer_id: r.ab_group for r in profiles.customer_group(abt(spark, rows)).collect()} == got


def test_many_group_labels_fall_back_to_text(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_CODED_GROUPS", 2)
    t = datetime(2024, 1, 2, 10)
    rows = [("o1", "c1", t, 3.0, False, "z"), ("o2", "c1", t, 3.0, False, "a"), ("o3", "c2", t, 1.0, False, "m")]
    assert {r.customer_id: r.ab_group for r in segments.customer_metrics(abt(spark, rows)).collect()} == {"c1": "a", "c2": "m"}


def test_small_amounts_add_up(spark):
    t = datetime(2024, 1, 2, 10)
    gold = abt(spark, [(f"o{i}", "c1", t, 0.004, False, "control") for i in range(1000)])
    assert segments.customer_metrics(gold).first().revenue == 4.0
    large = abt(spark, [("o1", "c1", t, 1e17, False, "control"), ("o2", "c1", t, 1e30, False, "control")])
    assert segments.customer_metrics(large).first().revenue == 1e17


def test_shares_of_no_revenue_are_null(spark):
    t = datetime(2024, 1, 2, 10)
    gold = abt(spark, [("o1", "c1", t, 0.0, False, "control"), ("o2", "c2", t, 0.0, False, "target")])
    rows = kpis.ab_report(gold, "group_summary_share").collect()
    assert [(r.order_pct, r.revenue_pct) for r in rows] == [(50.0, None)] * 2


def test_reports_in_order(spark):
    t = datetime(2024, 1, 2, 9)
    rows = [(f"o{i}", f"c{i}", t, 1.0, False, g) for i, g in enumerate(["target", "control", "variant_b", "control"])]
    gold = abt(spark, rows)
    assert [r.ab_group for r in kpis.ab_report(gold, "group_kpis").collect()] == ["control", "target", "variant_b"]
    night = [(f"n{i}", f"d{i}", datetime(2024, 1, 2, 1), 1.0, False, g) for i, g in enumerate(["target", "control"])]
    report = segments.label_report(abt(spark, rows + night), segments.DAYPART).collect()
    keys = [(r.daypart, r.ab_group) for r in report]
    assert keys == sorted(keys) and len(keys) == 5
    labelled = spark.createDataFrame([(f"c{i}", 3 - i % 3) for i in range(9)], "customer_id string, cluster int")
    assert [r.cluster for r in profiles.cluster_sizes(labelled).collect()] == [1, 2, 3]


def test_typing_losses_are_counted(spark):
    rows = raw(spark, [
        {"order_id": "1", "order_total_amount": "7.25", "order_scheduled": "true", "merchant_latitude": "1.5"},
        {"order_id": "2", "order_total_amount": "x", "order_scheduled": "perhaps", "merchant_latitude": ""},
    ]).withColumn("_corrupt_record", F.lit(None).cast("string"))
    got = {r.column_name: (r.value_count, r.lost_count) for r in quality.malformed_orders(rows).collect()}
    assert got["order_total_amount"] == (2, 1) and got["order_scheduled"] == (2, 1)
    assert got["merchant_latitude"] == (1, 0) and got["record"] == (2, 0)
    typed = ingest.type_orders(rows).orderBy("order_id").collect()
    assert typed[0].order_total_amount == 7.25 and typed[0].order_scheduled is True


def test_latest_order_with_null_ids(spark):
    rows = [(None, 1), (None, 2), ("a", 1), ("b", 5), ("b", None)]
    orders = spark.createDataFrame(
        [(i, None if d is None else datetime(2024, 1, d), float(d or 0)) for i, d in rows],
        "order_id string, order_created_at timestamp, order_total_amount double",
    )
    got = sorted(((r.order_id or "", r.order_total_amount) for r in ingest.keep_latest_order(orders).collect()))
    assert got == [("", 2.0), ("a", 1.0), ("b", 5.0)]
