"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it runs inside whole-stage codegen.

Money is summed as ``DECIMAL(28,10)`` and turned into a double only at the end.  A double
sum depends on the order in which partitions are merged; the decimal sum does not, so a
rerun (or a retried task) gives the same bits and the result can be checked exactly.  Ten
places hold every digit that an amount of up to 15 significant digits shows below 1e5, and
18 digits before the point leave room for any amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_DECIMAL = T.DecimalType(28, 10)
ACCUMULATOR_DECIMAL = T.DecimalType(38, 10)
#: A/B labels that are coded as numbers in aggregations; a table with more is grouped as text.
MOST_CODED_GROUPS = 1000

# Segment labels and their boundaries.
# Dayparts by order hour: [0,6) late_night, [6,12) morning, [12,14) lunch,
# [14,18) afternoon, every other hour evening.
DAYPART_BOUNDS = [("late_night", 0, 6), ("morning", 6, 12), ("lunch", 12, 14), ("afternoon", 14, 18)]
DAYPART_DEFAULT = "evening"
DAYPARTS = [label for label, _, _ in DAYPART_BOUNDS] + [DAYPART_DEFAULT]
# Day types: Sunday, Saturday, and Friday from 18:00 are the weekend (day of week 1 = Sunday).
WEEKEND, WEEKDAY = "weekend", "weekday"
DAY_TYPES = [WEEKEND, WEEKDAY]
WEEKEND_DAYS = (1, 7)
FRIDAY, FRIDAY_EVENING_HOUR = 6, 18
# Restaurant price tiers on a customer's mean price range: <= 1.5, <= 2.5, above.
PRICE_TIER_BOUNDS = [("budget", 1.5), ("mid", 2.5)]
PRICE_TIER_DEFAULT = "premium"
# A/B group labels.
CONTROL, TARGET = "control", "target"
# Coupon value per target order assumed by the viability calculation.
DEFAULT_COUPON_VALUE = 10.0


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class GroupCodes:
    """The A/B labels of a table as numbers, so that the lowest label of a key aggregates in a
    hash table: a ``min`` over text would sort all input rows instead.

    The distinct labels (a handful, one column of the table, combined in every task) are read
    once.  Any label counts as itself.  With more than ``MOST_CODED_GROUPS`` labels the text
    itself is aggregated: the same result by a slower plan.
    """

    def __init__(self, table: DataFrame, column: str = "ab_group"):
        self.column = column
        rows = table.select(column).filter(F.col(column).isNotNull()).distinct().take(MOST_CODED_GROUPS + 1)
        self.labels = sorted(r[0] for r in rows) if len(rows) <= MOST_CODED_GROUPS else None

    def lowest(self) -> Column:
        """Aggregate: the lowest label of a key, to be decoded by :meth:`decoded`."""
        if self.labels is None:
            return F.min(self.column)
        if not self.labels:
            return F.min(F.lit(None).cast("int"))
        return F.min(F.nullif(F.array_position(F.array(*[F.lit(x) for x in self.labels]), F.col(self.column)), F.lit(0)))

    def decoded(self, c: str | Column) -> Column:
        if self.labels is None:
            return col_(c)
        if not self.labels:
            return F.lit(None).cast("string")
        # element_at of a constant array does not return NULL for a NULL position
        return F.when(col_(c).isNotNull(), F.element_at(F.array(*[F.lit(x) for x in self.labels]), col_(c).cast("int")))


def money(c: str | Column) -> Column:
    """A money amount as an exact decimal; NULL if it is beyond 18 digits or no number."""
    return col_(c).try_cast(MONEY_DECIMAL)


def exact_sum(c: str | Column) -> Column:
    """Sum of money amounts, order independent, as double."""
    return F.sum(money(c)).cast("double")


def exact_avg(c: str | Column) -> Column:
    """Row average of money amounts: the exact sum divided by the number of amounts in it.

    Amounts that :func:`money` cannot hold count neither above nor below.
    """
    return F.try_divide(exact_sum(c), F.count(money(c)).cast("double"))


def round2(c: str | Column) -> Column:
    return F.round(col_(c), 2)


def share_pct(part: str | Column, total: str | Column) -> Column:
    """``100 * part / total`` rounded to two places (NULL when the total is zero)."""
    return F.round(F.try_divide(F.lit(100.0) * col_(part), col_(total)), 2)


def to_coordinate(c: str | Column) -> Column:
    """Text coordinate to double with two places; malformed text becomes NULL."""
    return F.round(col_(c).try_cast("double"), 2)


def to_whole_number(c: str | Column) -> Column:
    """Text to int, also if written with a point and zeros (``3.0``); anything else becomes NULL."""
    value = col_(c).try_cast("double")
    return F.when(value == F.floor(value), value.try_cast("int"))


def to_timestamp_lenient(c: str | Column) -> Column:
    """Text to timestamp; malformed text becomes NULL instead of failing the job."""
    return F.try_to_timestamp(col_(c))


def order_discount(items: str | Column = "items", strict_nulls: bool = False) -> Column:
    """Fold the discount values of an order's items into one exact sum.

    An empty array gives 0 and a NULL array gives NULL.  By default a NULL or
    unparseable discount counts as 0; with ``strict_nulls`` it makes the whole order's
    discount NULL, as a plain ``acc + value`` fold does.
    """
    zero = F.lit(0).cast(ACCUMULATOR_DECIMAL)

    def step(acc: Column, item: Column) -> Column:
        value = item["discount"]["value"].try_cast(MONEY_DECIMAL)
        if not strict_nulls:
            value = F.coalesce(value, F.lit(0).cast(MONEY_DECIMAL))
        return (acc + value).cast(ACCUMULATOR_DECIMAL)

    return F.aggregate(col_(items), zero, step)


def daypart(hour: str | Column) -> Column:
    h = col_(hour)
    expr = None
    for label, low, high in DAYPART_BOUNDS:
        cond = (h >= low) & (h < high)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(DAYPART_DEFAULT)


def day_type(day_of_week: str | Column, hour: str | Column) -> Column:
    dow, h = col_(day_of_week), col_(hour)
    weekend = dow.isin(*WEEKEND_DAYS) | ((dow == FRIDAY) & (h >= FRIDAY_EVENING_HOUR))
    return F.when(weekend, WEEKEND).otherwise(WEEKDAY)


def price_tier(mean_price_range: str | Column) -> Column:
    m = col_(mean_price_range)
    expr = None
    for label, upper in PRICE_TIER_BOUNDS:
        expr = F.when(m <= upper, label) if expr is None else expr.when(m <= upper, label)
    return expr.otherwise(PRICE_TIER_DEFAULT)


def argmax_label(counts: dict[str, Column]) -> Column:
    """Label with the largest count; ties go to the label first in ascending order.

    NULL when every count is zero (the key had no qualifying rows).
    """
    labels = sorted(counts)
    best = F.greatest(*[counts[label] for label in labels])
    expr = None
    for label in labels:
        cond = counts[label] == best
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.when(best > 0, expr)
