"""Panel building: completeness, dense calendar, merged territories, lags and look-back features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("territory_id", "category")


def densify(panel: DataFrame, first: str, last: str, keys: tuple = ("territory_id", "region_code", "category"), values: tuple = ("y",)) -> DataFrame:
    """Every series with every month, null where it has no row. Shifts by rows are then shifts by months."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month")
    grid = panel.select(*keys).distinct().select(*keys, months)
    return grid.join(panel.select(*keys, "month", *values), [*keys, "month"], "left")


def over_time(keys: tuple = SERIES) -> Window:
    return Window.partitionBy(*keys).orderBy("month")


def with_completeness(dense: DataFrame, months: int) -> DataFrame:
    n = F.count("y").over(Window.partitionBy(*SERIES))
    return dense.withColumn("n_obs", n).withColumn("complete", F.col("n_obs") >= months)


def glue(panel: DataFrame, merged: dict[int, int], weights: DataFrame) -> DataFrame:
    """Territories merged into successors as weighted means, with the covered share of weight; predecessors go.

    merged: old id -> new id; weights: territory_id, w.
    """
    mapping = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])
    total = weights.where(F.col("territory_id").isin(list(merged))).groupBy(mapping[F.col("territory_id")].alias("territory_id")).agg(F.sum("w").alias("w_all"))
    old = panel.where(F.col("territory_id").isin(list(merged)) & F.col("y").isNotNull()).join(weights, "territory_id")
    new = old.groupBy(mapping[F.col("territory_id")].alias("territory_id"), "category", "month").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y"), F.sum("w").alias("_w"))
    new = new.join(total, "territory_id").select("territory_id", "category", "month", "y", (F.col("_w") / F.col("w_all")).alias("share"))
    kept = panel.where(~F.col("territory_id").isin([*merged, *merged.values()]))
    return kept.select("territory_id", "category", "month", "y", F.lit(1.0).alias("share")).unionByName(new)


def surge(x: str, keys: tuple, order: str = "month", rows: int = 12, least: int = 3) -> Column:
    """ln(1+x) less ln(1+mean of the rows before), where these are least or more."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(-rows, -1)
    return F.when(F.count(x).over(before) >= least, F.log1p(F.col(x)) - F.log1p(F.avg(x).over(before)))


def rolling_product(x: str, keys: tuple, rows: int = 3) -> Column:
    """Product of the rows before, of percentages, as a percentage; null unless the window is full."""
    before = Window.partitionBy(*keys).orderBy("month").rowsBetween(-rows, -1)
    return F.when(F.count(x).over(before) == rows, F.exp(F.sum(F.log(F.col(x) / 100)).over(before)) * 100)


def cumulative_index(x: str, keys: tuple) -> Column:
    return 100 * F.exp(F.sum(F.log(F.col(x) / 100)).over(Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))


def interpolated(x: str, keys: tuple, order: str = "month") -> Column:
    """Linear between known neighbours, the nearest known value at the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.row_number().over(w)
    known = F.when(F.col(x).isNotNull(), F.struct(at.alias("at"), F.col(x).alias("v")))
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    inside = a["v"] + (b["v"] - a["v"]) * (at - a["at"]) / (b["at"] - a["at"])
    return F.when(F.col(x).isNotNull(), F.col(x)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(inside)


def last_valid(x: str, keys: tuple = SERIES) -> Column:
    return F.last(x, True).over(Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))


def latest_version(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_k = 1").drop("_k")


def average_rank(x: Column, by: list) -> Column:
    """Descending rank where ties share their mean."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return F.rank().over(w.orderBy(x.desc())) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def leave_one_out_mean(x: str, by: list) -> Column:
    w = Window.partitionBy(*by)
    return (F.sum(x).over(w) - F.col(x)) / F.greatest(F.count(x).over(w) - 1, F.lit(1))
