"""Operator 8: mixing sources to target weights, with DataFrame functions only.

Sizes are word counts.  Targets follow from one small row per source.  Every document gets a
hash-random key; keys are range-sorted within each source, token counts are prefix-summed in
two levels (key ranges of a source, then rows of a range), and the sum is cut at the exact
budget.  A budget above the source's size repeats whole epochs first.  Key ranges hold about
``rows_per_range`` rows, as keys are uniform, so a source with a third of all rows is spread
over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_names, materialise

# Fixed values of the contract: weights of the sources in code point order, the share of all
# sizes that the mix takes, and the most a source may be repeated.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
ROWS_PER_RANGE = 8192
#: A source's plan is one row of a few hundred bytes; more sources than this are joined by shuffle.
_BROADCAST_SOURCES = 50_000
_AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """One row per source: source, n_rows, source_size, weight, target.

    Sharing out by weight, stopping sources at their cap and sharing the excess again until
    none is above ends where sources with the smallest cap per weight stop, and the others
    share what is left.  Sources are the table's own list of names, one row each after the
    aggregation; the windows below run over those rows alone.
    """
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position + 1).cast("int")).cast("long")
    weighed = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_epochs)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * share_percent / F.lit(100.0)
    # what a weight of one gets if this source and all of a larger ratio share what is left:
    # it rises while sources stop and falls from the first that does not, so that is the largest
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shared = weighed.withColumn("left_per_weight", left / F.sum("weight").over(after))
    level = F.max("left_per_weight").over(everything)
    return shared.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "n_rows", "source_size", "weight", "target"
    )


def _ordered(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Source, hash-random key and text of a row; key, size and text hash order a source's rows."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    return docs[source_col].cast("string"), key, docs[text_col].cast("string")


def _prefix_sums(sizes: DataFrame, targets: DataFrame, rows_per_range: int) -> DataFrame:
    """``sizes`` with its source's target, epochs and rest, and the words before each row in key order."""
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / rows_per_range)).cast("long")
    # the key's first 28 bits, as a share of their range, times the number of ranges
    leading = F.conv(F.substring("mix_key", 1, 7), 16, 10).cast("long")
    named = targets.withColumn("ranges", ranges).withColumnRenamed("source", "of_source")
    placed = sizes.join(named, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    placed = placed.withColumn("key_range", F.floor(leading * F.col("ranges") / F.lit(1 << 28)).cast("long"))
    sums = placed.groupBy("source", "key_range").agg(F.sum("size").alias("range_size"))
    along = Window.partitionBy("source").orderBy("key_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("of_source"),
        F.col("key_range").alias("of_range"),
        F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("range_before"),
    )
    within = (
        Window.partitionBy("source", "key_range")
        .orderBy("mix_key", "size", "content")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.withColumn("row_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = summed.join(
        offsets,
        F.col("source").eqNullSafe(F.col("of_source")) & (F.col("key_range") == F.col("of_range")),
        "left",
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        joined.drop("of_source", "of_range")
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("before", F.col("range_before") + F.col("row_before"))
    )


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source, key, text = _ordered(docs, seed, id_col, text_col, source_col)
    return materialise(
        docs.select(
            docs[id_col].alias("doc_id"),
            source.alias("source"),
            word_count(text).alias("size"),
            key.alias("mix_key"),
            F.xxhash64(text).alias("content"),
        )
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the row: whole epochs, and in the last
    one a prefix of the source's key order whose last document is cut at the budget.  Null
    and empty texts have size 0 and give nothing.  Null sources are one source, after all
    others.  Keys hash the id and the seed, so reruns agree; rows of equal id are ordered by
    size and text hash, and rows equal in these are interchangeable.  Empty table: no rows.
    Other columns are not read.
    """
    sizes = _measured(docs, seed, id_col, text_col, source_col)
    targets = source_targets(sizes, weights, share_percent, most_epochs)
    rows = _prefix_sums(sizes, targets, rows_per_range)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    taken = (F.col("epochs") * F.col("size") + last).cast("long").alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken)


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 0,
    rows_per_range: int = ROWS_PER_RANGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, one per source cut at the budget.

    All columns stay; ``n_chars``, if there, follows the text.  Texts do not move between
    tasks: each source has one row that says how many epochs are whole and at which key the
    last one ends, and that joins the documents.  Rows equal in id and text at the cut share
    the rest evenly.  Rows without words are not part of a mix.
    """
    sizes = _measured(docs, seed, id_col, text_col, source_col)
    targets = source_targets(sizes, weights, share_percent, most_epochs)
    rows = _prefix_sums(sizes, targets, rows_per_range)
    order = F.struct("mix_key", "size", "content")
    beyond = rows.filter(F.col("before") + F.col("size") > F.col("rest"))
    cuts = beyond.groupBy("source").agg(F.min(order).alias("cut"))
    same = F.col("source").eqNullSafe(F.col("of_source"))
    at = rows.join(cuts.withColumnRenamed("source", "of_source"), same, "left")
    is_cut = order == F.col("cut")
    plan = at.groupBy("source").agg(
        F.first("epochs").alias("mix_epochs"),
        F.min("cut").alias("mix_cut"),
        F.max(F.when(is_cut, F.col("rest"))).alias("rest"),
        F.min(F.when(is_cut, F.col("before"))).alias("before"),
        F.count(F.when(is_cut, 1)).alias("sharing"),
    )
    own = ("mix_source", "mix_epochs", "mix_cut", "mix_part", "mix_of_source", "mix_order", "mix_take")
    c_source, c_epochs, c_cut, c_part, c_of, c_order, c_take = free_names(docs, *own)
    plan = materialise(
        plan.select(
            F.col("source").alias(c_source),
            F.col("mix_epochs").alias(c_epochs),
            F.col("mix_cut").alias(c_cut),
            F.floor((F.col("rest") - F.col("before")) / F.col("sharing")).cast("long").alias(c_part),
        )
    )
    if plan.count() <= _BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    source, key, text = _ordered(docs, seed, id_col, text_col, source_col)
    size = word_count(text)
    place = F.struct(key.alias("mix_key"), size.alias("size"), F.xxhash64(text).alias("content"))
    read = docs.withColumns({c_of: source, c_order: place})
    joined = read.join(plan, F.col(c_of).eqNullSafe(F.col(c_source)))
    before_cut = F.col(c_cut).isNull() | (F.col(c_order) < F.col(c_cut))
    whole = F.col(c_epochs) + F.when(before_cut, 1).otherwise(0)
    part = F.when(F.col(c_order) == F.col(c_cut), F.col(c_part)).otherwise(0)
    takes = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")),
    )
    taken = joined.filter(F.col(c_order)["size"] > 0).withColumn(c_take, F.explode(takes))
    # pieces of white space and a word: the first n joined are the text up to its nth word
    pieces = F.split(F.col(text_col).cast("string"), _AFTER_WORD)
    head = F.array_join(F.slice(pieces, 1, F.col(c_take).cast("int")), "")
    taken = taken.withColumn(text_col, F.when(F.col(c_take) < 0, F.col(text_col)).otherwise(head))
    if "n_chars" in docs.columns:
        chars = F.length(F.col(text_col)).cast(docs.schema["n_chars"].dataType)
        taken = taken.withColumn("n_chars", F.when(F.col(c_take) < 0, F.col("n_chars")).otherwise(chars))
    return taken.select(*docs.columns)
