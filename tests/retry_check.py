"""Run by tests/test_retry.py in its own process (a context that retries tasks).

A task of the skewed fact input fails on its first attempt; the salted join must give
exactly the rows it gives without failures, because the salt is a hash of the row and
a rerun rebuilds the same buckets.  Exit code 0 on success.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from campaign_analytics.operators import joins  # noqa: E402
from campaign_analytics.session import build_session  # noqa: E402


def main() -> int:
    scratch = tempfile.mkdtemp(prefix="retry-check-")
    spark = build_session(
        "local[4,3]",
        shuffle_partitions=8,
        extra={
            "spark.checkpoint.dir": os.path.join(scratch, "ck"),
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        },
    )
    idx = F.col("id")
    fact = spark.range(0, 6000, 1, 6).select(
        idx.cast("string").alias("order_id"),
        F.when(idx % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (idx % 40).cast("string"))).alias("customer_id"),
        (idx % 97).cast("double").alias("amount"),
    )
    dim = spark.createDataFrame(
        [("hot", "target")] + [(f"c{i}", "control") for i in range(40)], "customer_id string, ab_group string"
    )

    def fail_once(batches):
        ctx = TaskContext.get()
        if ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
            raise RuntimeError("injected failure on the first attempt")
        for pdf in batches:
            yield pdf

    flaky = fact.mapInPandas(fail_once, fact.schema)
    hot = joins.hot_keys(fact, "customer_id", hot_key_rows=200)
    expected = joins.skew_join(fact, dim, "customer_id", "inner", hot=hot)
    got = joins.skew_join(flaky, dim, "customer_id", "inner", hot=hot)
    key = lambda r: tuple(str(v) for v in r)
    ok = sorted(got.collect(), key=key) == sorted(expected.collect(), key=key) and got.count() == 6000
    print("retry check", "passed" if ok else "FAILED", "hot", hot.count())
    spark.stop()
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
