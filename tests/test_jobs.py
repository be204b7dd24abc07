"""The spark-submit jobs end to end: raw JSON and CSV -> silver -> gold -> report tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from campaign_analytics import jobs, schemas
from campaign_analytics.operators import kpis
from campaign_analytics.sources import testviews as tv
from conftest import SF_SMALL


def _write_raw(spark, root):
    orders = tv.orders_a_raw(spark, SF_SMALL)
    orders = orders.select(
        *[F.col(c).cast("string").alias(c) if c in ("order_id", "customer_id", "merchant_id", "order_created_at")
          else F.col(c) for c in orders.columns]
    )
    orders.coalesce(1).write.option("compression", "gzip").json(f"{root}/raw/orders")
    for name, df in (("consumer", tv.consumer(spark, SF_SMALL)), ("ab_test_ref", tv.ab_test_ref(spark, SF_SMALL)),
                     ("restaurant", tv.restaurant(spark, SF_SMALL))):
        schema = jobs.DIMENSIONS[name]
        full = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast("string").alias(f.name)
                           for f in schema])
        full.write.option("header", True).csv(f"{root}/raw/dims/{name}.csv")


def test_jobs_end_to_end(spark, scratch_dir):
    _write_raw(spark, scratch_dir)
    silver, gold, out = (os.path.join(scratch_dir, n) for n in ("silver", "gold", "reports"))
    jobs.run_silver(spark, f"{scratch_dir}/raw/orders", f"{scratch_dir}/raw/dims", silver)
    jobs.run_gold(spark, silver, gold)
    names = jobs.run_reports(spark, silver, gold, out)
    assert {"group_kpis", "campaign_viability", "daypart_report", "price_tier_report", "profile_group_summary",
            "quality_duplicate_keys", "group_order_share"} <= set(names)
    for name in names:
        assert os.path.isdir(os.path.join(out, name)), name

    abt = spark.read.parquet(gold)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    written = spark.read.parquet(f"{out}/group_kpis")
    direct = kpis.ab_report(abt, "group_kpis")
    assert sorted(written.collect(), key=key) == sorted(direct.select(*written.columns).collect(), key=key)
    silver_types = dict(spark.read.parquet(f"{silver}/orders").dtypes)
    assert silver_types["items"].startswith("array<struct<") and silver_types["order_created_at"] == "timestamp"
    assert set(silver_types) == {f.name for f in schemas.ORDER_RAW}
    assert spark.read.parquet(f"{out}/quality_null_customer").first().order_rows == tv.orders_a_raw(
        spark, SF_SMALL
    ).count()


def test_jobs_by_month_and_with_counts(spark, scratch_dir):
    _write_raw(spark, scratch_dir)
    silver, gold, by_month, lost = (os.path.join(scratch_dir, n) for n in ("silver", "gold", "by_month", "lost"))
    raw = f"{scratch_dir}/raw"
    jobs.run_silver(spark, f"{raw}/orders", f"{raw}/dims", silver, quality_out=lost)
    jobs.run_gold(spark, silver, gold)
    jobs.run_gold(spark, silver, by_month, by_month=True)
    jobs.run_gold(spark, silver, by_month, months=["1995-01", "1995-02"])
    whole, parts = spark.read.parquet(gold), spark.read.parquet(by_month)
    cols = [c for c in whole.columns if c != "items"]
    assert whole.select(cols).exceptAll(parts.select(cols)).isEmpty() and whole.count() == parts.count()
    counted = {r.column_name: r.value_count for r in spark.read.parquet(lost).collect()}
    assert counted["record"] == tv.orders_a_raw(spark, SF_SMALL).count()
    again, lost_again = f"{scratch_dir}/again", f"{scratch_dir}/lost_again"
    jobs.run_silver(spark, f"{raw}/orders", f"{raw}/dims", again, keep_latest=True, quality_out=lost_again)
    assert {r.column_name: r.value_count for r in spark.read.parquet(lost_again).collect()}.items() <= counted.items()
