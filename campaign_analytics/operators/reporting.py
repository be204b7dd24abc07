"""Helpers shared by the small final reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_report(df: DataFrame, *cols: str) -> DataFrame:
    """Sort a report of a handful of rows (one per group or segment).

    The rows are gathered into one partition first: a single partition already
    satisfies a global ordering, so Spark plans no range exchange and no sampling job
    for the sort.  Only for results whose size is bounded by the number of groups.
    """
    return df.coalesce(1).orderBy(*cols)


class Bundle(dict):
    """Reports by name over one kept table; ``release`` lets the table go."""

    def __init__(self, kept: DataFrame, reports: dict[str, DataFrame]):
        super().__init__(reports)
        self._kept = kept

    def release(self) -> None:
        self._kept.unpersist()


def with_positions(report: DataFrame) -> DataFrame:
    """A sorted report with each row's ``position`` in it, from 1: its order as a value.

    The ids follow the rows as they come out, partition by partition; the window runs over
    the rows of a small report.
    """
    placed = report.withColumn("_as_it_comes", F.monotonically_increasing_id())
    position = F.row_number().over(Window.orderBy("_as_it_comes")).alias("position")
    return placed.select(position, *report.columns)
