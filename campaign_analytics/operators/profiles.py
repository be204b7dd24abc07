"""Customer profiles: features, z-scores, k-means clusters, naming and summaries (Q20-Q30).

Everything stays on Spark.  Features are one aggregation by customer; the z-score
statistics are one global aggregate (eight numbers); k-means is ``pyspark.ml``'s
distributed implementation; summaries are aggregations over the labelled customers.
Cluster-level tables have k rows, so the windows that rank clusters run on k rows and
the cluster-to-profile table is a k-row broadcast.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import GroupCodes, exact_avg, exact_sum, money, round2
from ..session import ensure_checkpoint_dir
from .reporting import Bundle, sorted_report

FEATURES = ["order_count", "revenue", "avg_ticket", "avg_days_between_orders"]
GROUP = "ab_group"

# Profile names.  The highest mean revenue is the big spender; the other
# clusters, by mean order count ascending, are occasional, regular (the middle ones) and loyal.
BIG_SPENDER, OCCASIONAL, REGULAR, LOYAL = "big_spender", "occasional", "regular", "loyal"
DEFAULT_K, DEFAULT_SEED = 4, 42
# Stopping rule of the reference's clustering: the summed squared shift of the centres
# between iterations, on standardized features, at most 1e-4; at most 300 iterations.
SHIFT_TOLERANCE, MAX_ITER = 1e-4, 300


def centre_tolerance(k: int = DEFAULT_K) -> float:
    """Per-centre distance bound for Spark's k-means equivalent to the summed rule.

    Spark stops when every centre moves at most ``tol``; with ``tol = sqrt(1e-4 / k)``
    the summed squared shift is then at most 1e-4, so Spark stops no earlier than the
    reference's rule allows.
    """
    return math.sqrt(SHIFT_TOLERANCE / k)


def customer_features(abt: DataFrame) -> DataFrame:
    """Q20: per customer - orders, revenue, ticket, first/last order, active days, frequency.

    The customer's A/B group (lowest label if two) rides along in the same aggregation,
    so the profile summaries by group need no second pass over the ABT.
    """
    codes = GroupCodes(abt, GROUP)
    feats = (
        abt.groupBy("customer_id")
        .agg(
            F.countDistinct("order_id").alias("order_count"),
            exact_sum("order_total_amount").alias("revenue"),
            exact_avg("order_total_amount").alias("avg_ticket"),
            F.max("order_created_at").alias("last_order_at"),
            F.min("order_created_at").alias("first_order_at"),
            codes.lowest().alias(GROUP),
        )
        .withColumn(GROUP, codes.decoded(GROUP))
        .withColumn("active_days", F.datediff("last_order_at", "first_order_at"))
    )
    return feats.withColumn(
        "avg_days_between_orders",
        F.when(F.col("order_count") > 1, F.col("active_days") / (F.col("order_count") - 1)),
    )


def cluster_input(features: DataFrame) -> DataFrame:
    """Q21: id, the four features and the group; customers with a NULL id or feature
    (one-order customers have no frequency) dropped."""
    return features.select("customer_id", *FEATURES, GROUP).dropna(subset=["customer_id", *FEATURES])


def feature_stats(inputs: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature: one global aggregate."""
    aggs = []
    for f in FEATURES:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    row = inputs.agg(*aggs).first()
    return {f: (row[f"{f}__mean"], row[f"{f}__std"]) for f in FEATURES}


def scaled_features(
    inputs: DataFrame, stats: dict[str, tuple[float, float]] | None = None, keep: bool = False
) -> DataFrame:
    """Q22: z-score of each feature with the population deviation (0 where it is 0).

    The statistics are eight numbers from one aggregate; the scaling itself is a
    narrow projection.  ``keep`` keeps the input columns next to the z-scores.
    """
    stats = stats or feature_stats(inputs)
    cols = [F.col(c) for c in inputs.columns] if keep else [F.col("customer_id")]
    for f in FEATURES:
        mean, std = stats[f]
        if mean is None or not std:
            z = F.lit(0.0)
        else:
            z = (F.col(f) - F.lit(mean)) / F.lit(std)
        cols.append(z.alias(f"z_{f}"))
    return inputs.select(*cols)


def fit_kmeans(
    inputs: DataFrame,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    max_iter: int = MAX_ITER,
    partitions: int | None = None,
    seeds: list[int] | None = None,
) -> tuple[KMeansModel, DataFrame]:
    """Fit k-means (k-means|| init, fixed seed) on the z-scores of ``inputs``.

    ``inputs`` is computed once: hash-partitioned on the customer id, sorted within
    and checkpointed to the reliable checkpoint folder.  The fixed layout makes the fit
    repeatable; the checkpoint cuts the lineage, so the statistics, the k-means
    iterations and the labelling all read it instead of re-aggregating the ABT, and a
    lost executor re-reads it rather than replaying the upstream plan.
    With ``seeds``, one fit per seed on the same laid-out data, keeping the lowest
    training cost (several initialisations, as a multi-start k-means does).
    Returns the model and the checkpointed inputs with a ``features`` vector.
    """
    ensure_checkpoint_dir(inputs.sparkSession)
    # Without an explicit count, AQE sizes the hash partitions from the data.
    spread = inputs.repartition(partitions, "customer_id") if partitions else inputs.repartition("customer_id")
    laid_out = spread.sortWithinPartitions("customer_id").checkpoint(eager=True)
    z = scaled_features(laid_out, keep=True)
    zcols = [f"z_{f}" for f in FEATURES]
    assembled = VectorAssembler(inputCols=zcols, outputCol="features").transform(z).drop(*zcols)
    model = None
    for candidate in seeds or [seed]:
        kmeans = KMeans(
            k=k, seed=candidate, maxIter=max_iter, tol=centre_tolerance(k), featuresCol="features", predictionCol="cluster"
        )
        fitted = kmeans.fit(assembled)
        if model is None or fitted.summary.trainingCost < model.summary.trainingCost:
            model = fitted
    return model, assembled


def fit_clusters(
    inputs: DataFrame,
    k: int = DEFAULT_K,
    seed: int = DEFAULT_SEED,
    max_iter: int = MAX_ITER,
    partitions: int | None = None,
    seeds: list[int] | None = None,
) -> DataFrame:
    """Q23: ``inputs`` with the k-means ``cluster`` of each customer."""
    model, assembled = fit_kmeans(inputs, k, seed, max_iter, partitions, seeds)
    labelled = model.transform(assembled).withColumn("cluster", F.col("cluster").cast("int"))
    return labelled.select(*inputs.columns, "cluster")


def kmeans_checks(inputs: DataFrame, model: KMeansModel, labelled: DataFrame) -> DataFrame:
    """What must hold of fitted clusters: check and value, one row each.

    Customers in and out, clusters with a customer, customers of a cluster number that is not
    one of the model's, customers nearer to another centre than to their own, and customers
    per group in and out.  ``labelled`` has the scaled ``features`` the model was fitted on.
    """
    centres = [[float(x) for x in c] for c in model.clusterCenters()]

    def away(centre: list[float]) -> Column:
        parts = [F.pow(F.col("z")[i] - F.lit(x), F.lit(2)) for i, x in enumerate(centre)]
        return reduce(lambda a, b: a + b, parts)

    spaced = labelled.withColumn("z", vector_to_array("features")).select(
        "cluster", GROUP, F.array(*[away(c) for c in centres]).alias("away")
    )
    own = F.col("away")[F.col("cluster")]
    counted = spaced.agg(
        F.count(F.lit(1)).alias("customers_labelled"),
        F.countDistinct("cluster").alias("clusters_with_customers"),
        F.count_if(~F.col("cluster").between(0, len(centres) - 1)).alias("customers_of_no_cluster"),
        F.count_if(own > F.array_min("away") + 1e-9).alias("customers_nearer_to_another_centre"),
        F.count(GROUP).alias("customers_with_group"),
    )
    given = inputs.agg(F.count(F.lit(1)), F.count(GROUP)).first()  # two numbers
    row = counted.withColumns(
        {"customers_given": F.lit(given[0]), "customers_given_with_group": F.lit(given[1])}
    )
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("value")) for c in row.columns]))
    )


def cluster_means(labelled: DataFrame, key: str = "cluster") -> DataFrame:
    """Q24 / Q27: mean of each feature per cluster (or profile), 2 places."""
    return labelled.groupBy(key).agg(
        round2(F.avg("order_count")).alias("mean_order_count"),
        round2(exact_avg("revenue")).alias("mean_revenue"),
        round2(F.avg("avg_ticket")).alias("mean_avg_ticket"),
        round2(F.avg("avg_days_between_orders")).alias("mean_days_between_orders"),
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Q25: customers per cluster, ordered by cluster."""
    return sorted_report(labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("customer_count")), "cluster")


def cluster_profiles(labelled: DataFrame) -> DataFrame:
    """Q26: cluster -> profile name, from the cluster centres (not the cluster numbers).

    Works on the k aggregated rows: the highest mean revenue (ties: lower cluster) is
    ``big_spender``; the rest by mean order count ascending (ties: lower cluster) are
    ``occasional`` first, ``loyal`` last and ``regular`` between.
    """
    centres = labelled.groupBy("cluster").agg(
        F.avg("order_count").alias("_mean_orders"), exact_avg("revenue").alias("_mean_revenue")
    )
    by_revenue = Window.orderBy(F.desc("_mean_revenue"), "cluster")
    ranked = centres.withColumn("_big", F.row_number().over(by_revenue) == 1)
    rest = Window.partitionBy("_big").orderBy("_mean_orders", "cluster")
    ranked = ranked.withColumn("_pos", F.row_number().over(rest)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("_big"))
    )
    profile = (
        F.when(F.col("_big"), BIG_SPENDER)
        .when(F.col("_pos") == 1, OCCASIONAL)
        .when(F.col("_pos") == F.col("_n"), LOYAL)
        .otherwise(REGULAR)
    )
    return ranked.select("cluster", profile.alias("profile"))


def with_profiles(labelled: DataFrame) -> DataFrame:
    # The profile table has exactly one row per cluster (k rows): a bounded broadcast.
    return labelled.join(F.broadcast(cluster_profiles(labelled)), "cluster", "left")


def profile_means(labelled: DataFrame) -> DataFrame:
    """Q27: mean of each feature per profile."""
    return cluster_means(with_profiles(labelled), "profile")


def profile_shares(labelled: DataFrame) -> DataFrame:
    """Q28: customers per profile and their % of all clustered customers."""
    return _shares(with_profiles(labelled))


def _shares(named: DataFrame) -> DataFrame:
    counts = named.groupBy("profile").agg(F.count(F.lit(1)).alias("customer_count"))
    total = F.sum("customer_count").over(Window.partitionBy())
    return counts.withColumn("customer_pct", F.round(F.col("customer_count") / total * 100, 2))


def customer_group(abt: DataFrame) -> DataFrame:
    """One A/B group per customer (the lowest label when a customer has several)."""
    codes = GroupCodes(abt, GROUP)
    per_customer = abt.groupBy("customer_id").agg(codes.lowest().alias(GROUP))
    return per_customer.withColumn(GROUP, codes.decoded(GROUP))


def clustered_group_counts(inputs: DataFrame) -> DataFrame:
    """Q29: clustered customers per A/B group (customers without a group not counted)."""
    return inputs.filter(F.col(GROUP).isNotNull()).groupBy(GROUP).agg(F.count(F.lit(1)).alias("customer_count"))


def profile_group_summary(labelled: DataFrame) -> DataFrame:
    """Q30: per (profile, group) - customers, revenue sum and mean, mean ticket, mean orders."""
    return _group_summary(with_profiles(labelled))


def _group_summary(named: DataFrame) -> DataFrame:
    return (
        named.filter(F.col(GROUP).isNotNull() & F.col("profile").isNotNull())
        .groupBy("profile", GROUP)
        .agg(
            # labelled tables have one row per customer: counting ids counts distinct ids
            F.count("customer_id").alias("customer_count"),
            round2(F.sum(money("revenue")).cast("double")).alias("revenue"),
            round2(exact_avg("revenue")).alias("mean_revenue"),
            round2(F.avg("avg_ticket")).alias("mean_avg_ticket"),
            round2(F.avg("order_count")).alias("mean_order_count"),
        )
    )


def profile_reports(labelled: DataFrame) -> Bundle:
    """Q24-Q30 from one labelled table, naming the clusters once.

    The cluster-to-profile table (k rows) is computed once, kept as one cached
    partition and broadcast to the summaries, instead of being re-derived per report.
    """
    names = cluster_profiles(labelled).coalesce(1).cache()
    named = labelled.join(F.broadcast(names), "cluster", "left")
    reports = {
        "cluster_means": cluster_means(labelled),
        "cluster_sizes": cluster_sizes(labelled),
        "cluster_profiles": names,
        "profile_means": cluster_means(named, "profile"),
        "profile_shares": _shares(named),
        "customer_group": clustered_group_counts(labelled),
        "profile_group_summary": _group_summary(named),
    }
    return Bundle(names, reports)
