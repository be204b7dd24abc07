"""Order-grain star joins: the exploratory join and the analytical base table (ABT).

Both are single-key equi-joins of the order fact with three dimensions.  Dimensions that
together are proven to be at most ``BROADCAST_MAX_BYTES`` are broadcast and the fact is not
shuffled for them; the others (a customer table grows with the customer base) are joined by
a shuffled join with hot keys salted.  The proof starts from the optimiser's file statistics:
a table whose files already exceed the bound is not read to be measured.

Skew.  One customer or merchant may hold a large share of all orders (and, in the
exploratory join, so may the NULL customer).  A shuffled join would send all of that
key's rows to one task.  :func:`skew_join` counts the rows of every key exactly, splits each
key above the threshold over several salt buckets (a deterministic hash of the row, so a
retried task rebuilds the same buckets), and replicates only those keys' dimension rows once
per bucket.  The result is exactly the plain join; only the work is spread.

When the customer tables are too large to broadcast, the two customer-keyed dimensions
are combined first (a dimension-to-dimension join), so the fact is shuffled on
``customer_id`` once.  Dimension keys are not assumed unique:
a duplicated key fans out rows exactly as the plain SQL join does
(``quality.duplicate_keys`` reports such keys).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# A key with more fact rows than this is hot and is split into ceil(rows / this)
# buckets: about one task's worth of order rows (which carry their item arrays, up to
# ~1 KB each) per bucket.
HOT_KEY_ROWS = 500_000
# Dimensions whose sizes together are at most this are broadcast, so the fact is not
# shuffled for those joins at all (a merchant table of a few million rows fits; a
# customer table of hundreds of millions does not and goes through skew_join).
BROADCAST_MAX_BYTES = 200 * 1024 * 1024
# Bytes a broadcast row takes besides its values: hash table entry and row header.
BROADCAST_ROW_OVERHEAD = 48
# A table whose estimate is this many times the bound is not measured.  Files are mostly smaller
# than their rows; only long repeated values that are dropped by the projection say otherwise.
_FAR_ABOVE = 10
# What the optimiser says when it knows nothing.
_UNKNOWN_BYTES = 1 << 60
# There are at most (fact rows / HOT_KEY_ROWS) hot keys; a list up to this long is broadcast.
HOT_LIST_BROADCAST_ROWS = 1_000_000

# The filter of join keys: bits per key, 64-bit words of a block, bits that a key sets, bytes that
# a block takes in a broadcast hash table, and the bytes up to which a filter is broadcast.
FILTER_BITS_PER_KEY, FILTER_WORDS, FILTER_PROBES = 10, 8, 3
FILTER_BLOCK_BYTES = 8 * FILTER_WORDS + 32 + BROADCAST_ROW_OVERHEAD
FILTER_MAX_BYTES = BROADCAST_MAX_BYTES

# The dimension columns carried into the order-grain tables and their
CONSUMER_RENAMES = {"created_at": "customer_created_at", "active": "active"}
AB_RENAMES = {"is_target": "ab_group"}
RESTAURANT_RENAMES = {
    "created_at": "merchant_created_at",
    "enabled": "merchant_enabled",
    "price_range": "merchant_price_range",
    "average_ticket": "merchant_average_ticket",
    "delivery_time": "merchant_delivery_time",
    "minimum_order_value": "merchant_minimum_order_value",
    "merchant_city": "merchant_city",
    "merchant_state": "merchant_state",
}

_HOT_KEY, _BUCKETS, _SALT = "_hot_key", "_hot_buckets", "_salt"


def _dimension(df: DataFrame, key: str, new_key: str, renames: dict[str, str]) -> DataFrame:
    missing = [src for src in renames if src not in df.columns]
    if missing:
        raise ValueError(f"dimension keyed by {key} lacks columns {missing}")
    # a NULL key matches nothing
    kept = df.filter(F.col(key).isNotNull())
    return kept.select(F.col(key).alias(new_key), *[F.col(src).alias(dst) for src, dst in renames.items()])


def consumer_dim(consumer: DataFrame) -> DataFrame:
    return _dimension(consumer, "customer_id", "customer_id", CONSUMER_RENAMES)


def ab_dim(ab_test_ref: DataFrame) -> DataFrame:
    return _dimension(ab_test_ref, "customer_id", "customer_id", AB_RENAMES)


def restaurant_dim(restaurant: DataFrame) -> DataFrame:
    return _dimension(restaurant, "id", "merchant_id", RESTAURANT_RENAMES)


_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.DateType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def _width(dt: T.DataType) -> int:
    return _FIXED_WIDTH.get(type(dt), 64)


def _row_bytes(name: str, df: DataFrame) -> DataFrame:
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    fixed = sum(_width(f.dataType) for f in df.schema if f.name not in strings) + 8 * len(df.columns)
    fixed += BROADCAST_ROW_OVERHEAD
    size = F.lit(fixed).cast("bigint")
    for c in strings:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("bigint")
    return df.select(F.lit(name).alias("name"), size.alias("bytes"))


def measured_sizes(frames: dict[str, DataFrame]) -> dict[str, int]:
    """Size in bytes of each DataFrame, measured in one job: rows x fixed-width columns
    plus the byte length of every string value, summed per frame by one small
    aggregation over the union.  Dimension tables are flat; a nested column would be
    counted at 64 bytes a value."""
    rows = (
        reduce(DataFrame.unionByName, [_row_bytes(n, df) for n, df in frames.items()])
        .groupBy("name")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    sizes = {r["name"]: r["bytes"] for r in rows}
    return {n: sizes.get(n, 0) for n in frames}


def estimated_bytes(df: DataFrame) -> int | None:
    """Size from the optimiser's statistics for one table read from files; no job.

    None for anything joined or unioned: the estimate of a join is a product of sizes.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1:
        return None
    return int(str(plan.stats().sizeInBytes()))


def broadcast_set(frames: dict[str, DataFrame], max_bytes: int = BROADCAST_MAX_BYTES) -> set[str]:
    """The frames that may be broadcast together: their measured sizes sum to ``max_bytes`` at most.

    Smallest first.  A frame whose estimate is far above the bound is not measured; one
    without an estimate is.
    """
    estimates = {n: estimated_bytes(df) for n, df in frames.items()}
    known = {n: size for n, size in estimates.items() if size is not None and size < _UNKNOWN_BYTES}
    measured = {n: df for n, df in frames.items() if known.get(n, 0) <= _FAR_ABOVE * max_bytes}
    sizes = measured_sizes(measured) if measured else {}
    chosen, total = set(), 0
    for name in sorted(sizes, key=sizes.get):
        total += sizes[name]
        if total > max_bytes:
            break
        chosen.add(name)
    return chosen


def hot_keys(fact: DataFrame, key: str, hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Every value of ``key`` (NULL included) with more than ``hot_key_rows`` rows, and its buckets.

    An exact count over the key column alone, combined in every task before the shuffle.  At
    most (rows / ``hot_key_rows``) values come out, however the keys are spread.
    """
    counts = fact.groupBy(F.col(key).alias(_HOT_KEY)).agg(F.count(F.lit(1)).alias("_n"))
    buckets = F.ceil(F.col("_n") / F.lit(hot_key_rows)).cast("int")
    return counts.filter(F.col("_n") > hot_key_rows).select(_HOT_KEY, buckets.alias(_BUCKETS))


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
    salt_cols: list[str] | None = None,
) -> DataFrame:
    """``fact.join(dim, key, how)`` for ``how`` in inner/left, with hot keys salted.

    ``hot`` may be given (from :func:`hot_keys` on an upstream fact) so a chain of joins does
    not recompute its input to count keys; any hot list gives the same rows.  ``salt_cols``
    (default: the fact's flat columns) feed the bucket hash.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"skew_join supports inner and left joins, not {how!r}")
    hot = _settled(hot_keys(fact, key, hot_key_rows) if hot is None else hot)
    if hot is None:
        return fact.join(dim, key, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols or _flat(fact)]), F.col(_BUCKETS)).cast("int")
    salted_fact = (
        fact.join(hot, F.col(key).eqNullSafe(F.col(_HOT_KEY)), "left")
        .withColumn(_SALT, F.when(F.col(_BUCKETS).isNull(), F.lit(0)).otherwise(salt))
        .drop(_HOT_KEY, _BUCKETS)
    )
    salted_dim = (
        dim.join(hot, F.col(key) == F.col(_HOT_KEY), "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_BUCKETS), F.lit(1)) - 1)))
        .drop(_HOT_KEY, _BUCKETS)
    )
    return salted_fact.join(salted_dim, [key, _SALT], how).drop(_SALT)


def _settled(hot: DataFrame) -> DataFrame | None:
    """The hot list computed once and, up to a checked length, broadcast; None if it is empty."""
    ensure_checkpoint_dir(hot.sparkSession)
    hot = hot.checkpoint(eager=True)
    n = hot.count()
    return None if n == 0 else F.broadcast(hot) if n <= HOT_LIST_BROADCAST_ROWS else hot


def _filter_blocks(rows: int) -> int:
    return max(1, -(-rows * FILTER_BITS_PER_KEY // (64 * FILTER_WORDS)))


def _filter_places(key: str, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """The block of a key, and the words and bits in it that it sets."""
    hashed = F.xxhash64(F.col(key).cast("string"), F.lit(7))
    block = F.pmod(hashed, F.lit(blocks).cast("bigint"))
    mixed = F.xxhash64(hashed)
    places = [F.pmod(F.shiftright(mixed, 10 * i), F.lit(64 * FILTER_WORDS)).cast("int") for i in range(FILTER_PROBES)]
    return block, [(F.floor(p / 64).cast("int"), (p % 64).cast("int")) for p in places]


def key_filter(keys: DataFrame, key: str, rows: int) -> DataFrame:
    """A Bloom filter of a key column in blocks of 512 bits: ``_block`` and its ``_words``.

    Every key falls into one block, so a probe is one look-up.  Built by one aggregation with
    bitwise sums, combined in every task; its size follows from ``rows`` alone.
    """
    block, places = _filter_places(key, _filter_blocks(rows))
    words = []
    for i in range(FILTER_WORDS):
        bits = [F.when(w == i, F.expr("1L")).otherwise(F.expr("0L")) for w, _ in places]
        shifted = [F.call_function("shiftleft", b, bit) for b, (_, bit) in zip(bits, places)]
        words.append(F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), shifted)).alias(f"w{i}"))
    rows_of = keys.filter(F.col(key).isNotNull()).groupBy(block.alias("_block")).agg(*words)
    return rows_of.select("_block", F.array(*[f"w{i}" for i in range(FILTER_WORDS)]).alias("_words"))


def keep_possible(fact: DataFrame, key: str, built: DataFrame, rows: int) -> DataFrame:
    """The rows of ``fact`` whose key may be among the keys of :func:`key_filter`; none of them is lost."""
    block, _ = _filter_places(key, _filter_blocks(rows))
    given = fact.columns
    names = [f"_fact_{i}" for i in range(len(given))]  # a fact may have columns of the filter's names
    renamed = fact.withColumn("_filter_probe", block).toDF(*names, "_filter_probe")
    _, places = _filter_places(names[given.index(key)], _filter_blocks(rows))
    probed = renamed.join(F.broadcast(built), F.col("_filter_probe") == F.col("_block"))
    held = [F.call_function("shiftright", F.get("_words", w), b).bitwiseAND(F.expr("1L")) == 1 for w, b in places]
    return probed.filter(reduce(lambda a, b: a & b, held)).select(*names).toDF(*given)


def reduced_fact(fact: DataFrame, keys: DataFrame, key: str, max_bytes: int = FILTER_MAX_BYTES) -> DataFrame:
    """``fact`` before a shuffled INNER join on ``key``: without most rows that find no partner.

    A campaign reaches a part of all customers; the others' orders need not be moved.  The
    filter is broadcast, so it is used only if its size, known from the number of keys, is at
    most ``max_bytes``; beyond that the fact stays as it is.
    """
    rows = keys.count()
    if _filter_blocks(rows) * FILTER_BLOCK_BYTES > max_bytes:
        return fact
    return keep_possible(fact, key, key_filter(keys, key, rows), rows)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str,
    broadcast_dim: bool,
    hot: DataFrame | None = None,
    salt_cols: list[str] | None = None,
) -> DataFrame:
    """Join a fact to a dimension: broadcast when the dimension's size is proven small
    (the fact is then not shuffled, so its hot keys do not matter), else :func:`skew_join`."""
    if broadcast_dim:
        return fact.join(F.broadcast(dim), key, how)
    return skew_join(fact, dim, key, how, hot=hot, salt_cols=salt_cols)


def explore_join(
    orders: DataFrame,
    consumer: DataFrame,
    ab_test_ref: DataFrame,
    restaurant: DataFrame,
    hot_key_rows: int = HOT_KEY_ROWS,
    broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Orders LEFT consumer LEFT A/B group LEFT restaurant; null customers and groups kept.

    No restaurant column is selected, but the join stays: a duplicated restaurant id
    multiplies order rows, and the sums over this table count them.
    """
    cons, ab = consumer_dim(consumer), ab_dim(ab_test_ref)
    has_merchant = "merchant_id" in orders.columns
    rest = restaurant_dim(restaurant).select("merchant_id")
    dims = {"consumer": cons, "ab": ab} | ({"restaurant": rest} if has_merchant else {})
    small = broadcast_set(dims, broadcast_max_bytes)
    customers_small = {"consumer", "ab"} <= small
    if customers_small:
        joined = orders.join(F.broadcast(cons), "customer_id", "left").join(F.broadcast(ab), "customer_id", "left")
    else:
        # Every (consumer row, group row) combination of a customer, or one side alone:
        # joining the fact to this once equals the two left joins in sequence.
        customers = cons.join(ab, "customer_id", "full")
        joined = skew_join(orders, customers, "customer_id", "left", hot_key_rows=hot_key_rows)
    if has_merchant:
        hot_merchants = None if "restaurant" in small else hot_keys(orders, "merchant_id", hot_key_rows)
        joined = lookup_join(
            joined, rest, "merchant_id", "left", "restaurant" in small, hot_merchants, salt_cols=_flat(orders)
        )
    customer_cols = [c for c in cons.columns + ab.columns if c != "customer_id"]
    return joined.select(*orders.columns, *customer_cols)


def build_abt(
    orders: DataFrame,
    consumer: DataFrame,
    ab_test_ref: DataFrame,
    restaurant: DataFrame,
    hot_key_rows: int = HOT_KEY_ROWS,
    broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
    filter_max_bytes: int = FILTER_MAX_BYTES,
) -> DataFrame:
    """The gold order table: customer not null, INNER group, LEFT consumer and restaurant.

    The inner group join goes first so every later step sees fewer rows; the null filter
    reaches the Parquet scan as a pushed filter.  Where the customer tables are too large to
    broadcast, a filter of the customers with a group goes over the fact before its shuffle.
    """
    cons, ab = consumer_dim(consumer), ab_dim(ab_test_ref)
    fact = orders.filter(F.col("customer_id").isNotNull())
    has_merchant = "merchant_id" in orders.columns
    rest = restaurant_dim(restaurant)
    dims = {"consumer": cons, "ab": ab} | ({"restaurant": rest} if has_merchant else {})
    small = broadcast_set(dims, broadcast_max_bytes)
    customers_small = {"consumer", "ab"} <= small
    if customers_small:
        joined = fact.join(F.broadcast(ab), "customer_id", "inner").join(F.broadcast(cons), "customer_id", "left")
    else:
        customers = ab.join(cons, "customer_id", "left")
        fact = reduced_fact(fact, ab.select("customer_id"), "customer_id", filter_max_bytes)
        joined = skew_join(fact, customers, "customer_id", "inner", hot_key_rows=hot_key_rows)
    rest_cols: list[str] = []
    if has_merchant:
        hot_merchants = None if "restaurant" in small else hot_keys(fact, "merchant_id", hot_key_rows)
        joined = lookup_join(
            joined, rest, "merchant_id", "left", "restaurant" in small, hot_merchants, salt_cols=_flat(orders)
        )
        rest_cols = [c for c in rest.columns if c != "merchant_id"]
    cust_cols = [c for c in ab.columns + cons.columns if c != "customer_id"]
    return joined.select(*orders.columns, *cust_cols, *rest_cols)


def _flat(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if not t.startswith(("array", "struct", "map"))]
