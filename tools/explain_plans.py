"""Write the physical plans of the headline queries to PLANS.md.

    python tools/explain_plans.py [/root/testdata/sf0.01]

Plans are taken after AQE has run (each query is executed first), so they show the
join strategies and partition counts Spark actually used at that scale.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from campaign_analytics.operators import distinct_bitmaps, ingest, joins, kpis, profiles, quality, segments  # noqa: E402
from campaign_analytics.plans import layers, registry, sql_layers  # noqa: E402
from campaign_analytics.session import build_session  # noqa: E402
from campaign_analytics.sources import testviews as tv  # noqa: E402


def _final_plan(df) -> str:
    # Run through the Dataset's own execution (rows stay in the JVM), so its adaptive
    # plan is the final one.
    df._jdf.collectAsList()
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled_bytes(log_dir: str) -> dict[str, int]:
    """Bytes that the tasks of each job group wrote to shuffles, from the event log."""
    group_of_stage, out = {}, {}
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                if not line.startswith('{"Event":"SparkListener'):
                    continue
                event = json.loads(line)
                if event["Event"] == "SparkListenerJobStart":
                    group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                    group_of_stage.update(dict.fromkeys(event["Stage IDs"], group))
                elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                    group = group_of_stage.get(event["Stage ID"])
                    wrote = event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
                    out[group] = out.get(group, 0) + wrote
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    scratch = tempfile.mkdtemp(prefix="plans-")
    os.makedirs(f"{scratch}/events")
    log = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{scratch}/events", "spark.eventLog.compress": "false"}
    spark = build_session("local[8]", 8, extra={"spark.checkpoint.dir": f"{scratch}/checkpoints"} | log)

    def written(name, df):
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    silver_a = written("silver_a", registry.silver_orders_a(spark, sf))
    silver_b = written("silver_b", registry.silver_orders_b(spark, sf))
    dims = tuple(
        written(n, f(spark, sf)) for n, f in (("consumer", tv.consumer), ("ab", tv.ab_test_ref), ("rest", tv.restaurant))
    )
    abt_a = written("gold_a", joins.build_abt(silver_a, *dims))
    abt_b = written("gold_b", joins.build_abt(silver_b, *dims))
    tenth = written("ab_tenth", dims[1].filter("customer_id % 10 = 3"))

    def few_groups(filtered: bool):
        most = joins.FILTER_MAX_BYTES if filtered else 0
        return joins.build_abt(silver_a, dims[0], tenth, dims[2], broadcast_max_bytes=0, filter_max_bytes=most)

    cases = {
        "ABT, dimensions proven small (broadcast, fact not shuffled)": joins.build_abt(silver_a, *dims),
        "ABT, dimensions forced over the broadcast bound (shuffled, hot customers salted)": joins.build_abt(
            silver_a, *dims, hot_key_rows=20, broadcast_max_bytes=0
        ),
        "Q4 group_kpis (two-phase distinct counts)": kpis.ab_report(abt_a, "group_kpis"),
        "Q13 daypart_report (one customer aggregation with conditional counts)": segments.label_report(abt_b, segments.DAYPART),
        "Q1-Q3 bundle: exploratory join + one aggregation (group_order_share shown)": kpis.explore_reports(
            joins.explore_join(silver_a, *dims)
        )["group_order_share"],
        "Q13/Q16/Q19 bundle: daytype_report from the checkpointed customer table": segments.segment_reports(abt_a)[
            "daytype_report"
        ],
        "Q19 price_tier_report (two customer aggregations, co-partitioned join)": segments.price_tier_report(abt_a),
        "Q20 customer_features": profiles.customer_features(abt_a),
        "J2 from SQL text over views": sql_layers.build_abt(
            spark, sql_layers.register_views(dict(zip(sql_layers.TABLES, (silver_a, *dims))))
        ),
        "W3 dominant_value of an open list of labels": segments.dominant_value(abt_a, "merchant_city"),
        "A1/A12 distinct counts from stored bitmaps": kpis.report_of(
            distinct_bitmaps.merged_metrics(written("bitmaps", distinct_bitmaps.bitmaps(abt_a, layers.month_of()))), "group_kpis"
        ),
        "D3 keep_latest_order (only repeated ids are compared)": ingest.keep_latest_order(silver_b),
        "C3 repeated_orders (only repeated ids are counted)": quality.repeated_orders(silver_b),
    }
    finals = {}
    for title, df in cases.items():
        spark.sparkContext.setJobGroup(title, title)
        finals[title] = _final_plan(df)
    spark.sparkContext.setJobGroup("others", "others")
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    shuffled = {
        "ABT, no automatic broadcasts (shuffled joins, hot customers salted)": lambda: joins.build_abt(
            silver_a, *dims, hot_key_rows=20, broadcast_max_bytes=0
        ),
        "ABT, no automatic broadcasts, a tenth of the customers has a group: filter of their ids first": lambda: few_groups(True),
        "The same without the filter": lambda: few_groups(False),
    }
    for title, made in shuffled.items():
        df = made()
        spark.sparkContext.setJobGroup(title, title)
        finals[title] = _final_plan(df)
        spark.sparkContext.setJobGroup("others", "others")
    out = [
        "# Physical plans",
        "",
        f"Generated by `tools/explain_plans.py` from `{sf}` on local[8], 8 shuffle partitions, AQE on. "
        "The model tables are written to Parquet first, so each plan starts at a Parquet scan; "
        "each query is run before its plan is taken, so these are AQE's final plans.",
        "",
    ]
    spark.stop()
    moved = _shuffled_bytes(f"{scratch}/events")
    for title, plan in finals.items():
        figure = [f"Written to shuffles when run: {moved[title] / 1e6:.2f} MB.", ""] if title in moved else []
        out += [f"## {title}", "", *figure, "```", plan.rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
