"""Exact quantiles and ranks over all values of earlier months.

Values are dealt into ranges by approximate percentiles; counts by range and month, a small table, tell
in which range a rank falls, so that a quantile reads one or two ranges and no month is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, month, x, n and _range for each distinct value x of a month, without nulls."""
    counts = rows.where("x is not null").groupBy(*by, "month", "x").agg(F.count("*").alias("n"))
    edges = counts.groupBy(*by).agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_edges"))
    met = counts.join(F.broadcast(edges), by) if by else counts.crossJoin(F.broadcast(edges))  # a row for each group
    return met.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("x")))).drop("_edges")


def range_counts(values: DataFrame, months: DataFrame, by: list[str], until: Column) -> DataFrame:
    """by, t, _range, c and before: values of the range, and of lower ones, in the months that until (of month and t) lets count."""
    each = values.groupBy(*by, "_range", "month").agg(F.sum("n").alias("c"))
    sums = each.join(F.broadcast(months), until).groupBy(*by, "t", "_range").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*by, "t").orderBy("_range")
    return sums.withColumn("before", F.sum("c").over(w) - F.col("c"))


def quantiles(rows: DataFrame, q: float, by: list[str], inclusive: bool) -> DataFrame:
    """by, month, quantile: that of all x of the group in earlier months (and in the month itself, if inclusive).

    rows: by, month, x. Linear between the two nearest values, as exact percentiles are.
    """
    months = rows.select(F.col("month").alias("t")).distinct()
    values = dealt(rows.select(*by, "month", "x"), by)
    until = F.col("month") <= F.col("t") if inclusive else F.col("month") < F.col("t")
    sums = range_counts(values, months, by, until)
    place = q * (F.sum("c").over(Window.partitionBy(*by, "t")) - 1)
    sums = sums.withColumns({"at": place, "low": F.floor(place), "high": F.ceil(place)})
    holds = lambda p: (F.col("before") <= F.col(p)) & (F.col(p) < F.col("before") + F.col("c"))
    wanted = sums.where(holds("low") | holds("high")).drop("c")
    met = values.join(wanted, [*by, "_range"]).where(until)
    found = met.groupBy(*by, "t", "at", "low", "high", "before", "_range", "x").agg(F.sum("n").alias("c"))
    w = Window.partitionBy(*by, "t", "_range").orderBy("x")
    found = found.withColumn("before", F.col("before") + F.sum("c").over(w) - F.col("c"))
    value = lambda p: F.max(F.when(holds(p), F.col("x")))
    out = found.groupBy(*by, "t", "at", "low").agg(value("low").alias("_a"), value("high").alias("_b"))
    return out.select(*by, F.col("t").alias("month"), (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("at") - F.col("low"))).alias("quantile"))


def ranks(rows: DataFrame) -> DataFrame:
    """month, x, rank: the share of all values up to the month that are x or less. rows: month, x.

    Within a range one task counts by value and month; it holds one block of values and a number for each month.
    """
    values = dealt(rows.select("month", "x"), [])
    months = rows.select(F.col("month").alias("t")).distinct()
    sums = range_counts(values, months, [], F.col("month") <= F.col("t"))
    total = F.sum("c").over(Window.partitionBy("t"))
    # a month without values in a range has no row there; the counts below the range are needed for those with one only
    below = sums.select(F.col("t").alias("month"), "_range", "before", total.alias("total"))

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "month"], ignore_index=True)
        _, at = np.unique(part["month"].to_numpy(), return_inverse=True)
        x, n, carry, out = part["x"].to_numpy(), part["n"].to_numpy(), np.zeros(at.max() + 1, np.int64), np.zeros(len(part), np.int64)
        ends = np.r_[np.flatnonzero(np.diff(x) != 0) + 1, len(x)]
        begin = 0
        while begin < len(x):  # blocks end where a value does
            end = int(ends[min(np.searchsorted(ends, begin + 8192), len(ends) - 1)])
            own = slice(begin, end)
            _, value = np.unique(x[own], return_inverse=True)
            table = np.zeros((value.max() + 1, len(carry)), np.int64)
            np.add.at(table, (value, at[own]), n[own])
            table = carry + table.cumsum(axis=0)
            out[own] = table.cumsum(axis=1)[value, at[own]]
            carry, begin = table[-1], end
        return part.assign(inside=out)[["month", "x", "_range", "inside"]]

    counted = values.groupBy("_range").applyInPandas(inside, "month date, x double, _range int, inside long")
    return counted.join(below, ["month", "_range"]).select("month", "x", ((F.col("before") + F.col("inside")) / F.col("total")).alias("rank"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
