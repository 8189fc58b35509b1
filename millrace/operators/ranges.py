"""Joins on ranges: bins make an equi join of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, at: Column, intervals: DataFrame, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of points and intervals where ``at`` lies between low and high.

    The line is cut in bins of the width; an interval stands in each bin that it meets, a
    point in its own, and both meet in an equi join. A width about an interval's length
    keeps the copies few. Nulls join nothing.
    """
    to_bin = lambda c: F.floor(c / F.lit(float(width)))
    p = points.withColumns({"__at": at, "__bin": to_bin(at)})
    i = intervals.withColumns({"__low": low, "__high": high}).filter("__low <= __high")
    i = i.withColumn("__bin", F.explode(F.sequence(to_bin(F.col("__low")), to_bin(F.col("__high")))))
    return p.join(i, "__bin").filter("__at between __low and __high").drop("__at", "__bin", "__low", "__high")
