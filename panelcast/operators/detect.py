"""Shock detectors on log residuals (territory_id, region_code, category, month, e); nothing after a month counts in its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.expanding import quantiles, ranks, union
from panelcast.operators.folds import change_probability, expanding_scale, over_series, segment_score
from panelcast.operators.panel import SERIES
from panelcast.operators.selection import grouped_quantile, with_grouped_quantile
from panelcast.sources.sinks import kept


def residuals(records: DataFrame) -> DataFrame:
    """ln of the truth less ln of the one-step forecast, at the target month."""
    e = F.when((F.col("y_true") > 0) & (F.col("y_pred") > 0), F.log("y_true") - F.log("y_pred"))
    return records.where("h = 1").select("territory_id", "region_code", "category", F.col("target").alias("month"), e.alias("e"))


def with_scale(rows: DataFrame, x: str, keys: tuple = SERIES, least: int = 4, floor: float = 0.01) -> DataFrame:
    """rows with scale: 1.4826 times the median absolute deviation of the months before, floor at least; null before least values."""
    return over_series(rows, x, keys, lambda v: expanding_scale(v, least, floor), "scale")


def remove_common(rows: DataFrame) -> DataFrame:
    """e less the median of its category in the month."""
    rows = with_grouped_quantile(rows, ["category", "month"], "e", 0.5, "_common")
    return rows.withColumn("e", F.col("e") - F.col("_common")).drop("_common")


def standardised(rows: DataFrame, x: str = "e", keys: tuple = SERIES) -> DataFrame:
    return with_scale(rows, x, keys).withColumn("z", F.col(x) / F.col("scale")).drop("scale")


def conformal(rows: DataFrame, t_cal: int = 6, q: float = 0.9) -> DataFrame:
    """|e| over the quantile q of all |e| of the category in earlier months, from the month t_cal on."""
    limits = quantiles(rows.select("category", "month", F.abs("e").alias("x")), q, ["category"], inclusive=False)
    months = rows.select("month").distinct().withColumn("_t", F.row_number().over(Window.orderBy("month")) - 1)  # a row for each month
    limits = limits.join(F.broadcast(months.where(F.col("_t") >= t_cal)), "month").select("category", "month", F.col("quantile").alias("_q"))
    return rows.join(F.broadcast(limits), ["category", "month"], "left").withColumn("score", F.abs("e") / F.when(F.col("_q") > 0, F.col("_q"))).drop("_q")


def panel_score(rows: DataFrame, least: int = 4) -> DataFrame:
    """Residual less the median of the category in the region (of all, where the region has fewer than least series), in own scales."""
    region, category = ["category", "region_code", "month"], ["category", "month"]
    n = rows.groupBy(*region).agg(F.count("*").alias("_n"))  # the calendar is dense: every series has a row
    rows = with_grouped_quantile(with_grouped_quantile(rows, region, "e", 0.5, "_r"), category, "e", 0.5, "_c").join(n, region)
    rows = rows.withColumn("_d", F.col("e") - F.when(F.col("_n") >= least, F.col("_r")).otherwise(F.col("_c"))).drop("_r", "_c", "_n")
    return standardised(rows, "_d").withColumn("score", F.abs("z")).drop("_d", "z")


def cusum(rows: DataFrame, k: float = 0.5) -> DataFrame:
    """Two-sided CUSUM; the recursion S = max(0, S + z - k) is a prefix sum less its running minimum."""
    w = Window.partitionBy(*SERIES).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    z = F.coalesce("z", F.lit(0.0))
    out = standardised(rows).withColumns({"_up": F.sum(z - k).over(w), "_down": F.sum(-z - k).over(w)})
    side = lambda p: F.col(p) - F.least(F.lit(0.0), F.min(p).over(w))
    return out.withColumn("score", F.when(F.col("z").isNotNull(), F.greatest(side("_up"), side("_down")))).drop("_up", "_down", "z")


def cusum_reset(rows: DataFrame, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """CUSUM that restarts after exceeding h; a missing month freezes it. A fold over each series' months."""
    zs = standardised(rows).groupBy(*SERIES, "region_code").agg(F.array_sort(F.collect_list(F.struct("month", "e", "z"))).alias("v"))
    empty = F.array().cast("array<struct<month:date,e:double,score:double>>")
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        ok, z = x["z"].isNotNull(), F.coalesce(x["z"], F.lit(0.0))
        p = F.when(ok, F.greatest(F.lit(0.0), acc["p"] + z - k)).otherwise(acc["p"])
        n = F.when(ok, F.greatest(F.lit(0.0), acc["n"] - z - k)).otherwise(acc["n"])
        top = F.greatest(p, n)
        new = F.struct(x["month"].alias("month"), x["e"].alias("e"), F.when(ok, top).alias("score"))
        return F.struct(F.when(top > h, 0.0).otherwise(p).alias("p"), F.when(top > h, 0.0).otherwise(n).alias("n"), F.concat(acc["out"], F.array(new)).alias("out"))

    return zs.select(*SERIES, "region_code", F.explode(F.aggregate("v", start, step, lambda a: a["out"])).alias("o")).select(*SERIES, "region_code", "o.month", "o.e", "o.score")


def page_hinkley(rows: DataFrame, delta: float = 0.1) -> DataFrame:
    """Sum of deviations from the running mean, against its lowest and highest so far."""
    w = Window.partitionBy(*SERIES).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = standardised(rows).withColumn("_step", F.when(F.col("z").isNotNull(), F.col("z") - F.avg("z").over(w) - delta).otherwise(0.0)).withColumn("_sum", F.sum("_step").over(w))
    low, high = F.least(F.lit(0.0), F.min("_sum").over(w)), F.greatest(F.lit(0.0), F.max("_sum").over(w))
    return out.withColumn("score", F.when(F.col("z").isNotNull(), F.greatest(F.col("_sum") - low, high - F.col("_sum")))).drop("_step", "_sum", "z")


def multivariate(rows: DataFrame) -> DataFrame:
    return standardised(rows).withColumn("score", F.sqrt(F.avg(F.col("z") * F.col("z")).over(Window.partitionBy("territory_id", "month")))).drop("z")


def regional(rows: DataFrame, least: int = 4) -> DataFrame:
    """Median of the region's residuals less the category's, in the regional series' own scales, for each of its territories."""
    e = remove_common(rows)
    keys = ("category", "region_code")
    many = e.groupBy(*keys, "month").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    region = grouped_quantile(e, [*keys, "month"], "e", 0.5, "_m").join(many, [*keys, "month"])
    region = with_scale(region, "_m", keys).select(*keys, "month", (F.abs("_m") / F.col("scale")).alias("score"))
    return rows.join(region, [*keys, "month"], "left")


def expanding_median(scores: DataFrame) -> DataFrame:
    """score over the median of all series' scores up to its month."""
    medians = quantiles(scores.select("month", F.col("score").alias("x")), 0.5, [], inclusive=True).withColumnRenamed("quantile", "_d")
    return scores.join(F.broadcast(medians), "month", "left").withColumn("score", F.col("score") / F.when(F.col("_d") > 0, F.col("_d"))).drop("_d")


def expanding_rank(scores: DataFrame) -> DataFrame:
    """Share of all scores up to the month that are as large or smaller."""
    found = ranks(scores.select("month", F.col("score").alias("x"))).withColumnRenamed("x", "score")
    return scores.join(found, ["month", "score"], "left").withColumn("score", F.col("rank")).drop("rank")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greater of two scores, the other where one is null."""
    keys = [*SERIES, "month"]
    return a.join(b.select(*keys, F.col("score").alias("_b")), keys).withColumn("score", F.greatest("score", "_b")).drop("_b")


def mean_of(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [*SERIES, "month"]
    return a.join(b.select(*keys, F.col("score").alias("_b")), keys).withColumn("score", 0.5 * (F.col("score") + F.col("_b"))).drop("_b")


def change_points(rows: DataFrame, hazard: float = 1 / 24) -> DataFrame:
    """Probability of a run of at most one value."""
    return over_series(standardised(rows), "z", SERIES, lambda v: change_probability(v, hazard), "score").drop("z")


def segmentation(rows: DataFrame, method: str = "pelt") -> DataFrame:
    """The penalty at which the last cut stays, by an optimal segmentation (pelt) or by splitting (binseg); a missing value counts as 0."""
    return over_series(rows.withColumn("x", F.coalesce("e", F.lit(0.0))), "x", SERIES, lambda v: segment_score(v, method), "score").drop("x")


def robust(rows: DataFrame, x: str, keys: tuple = SERIES) -> DataFrame:
    """rows with z: x less the median of its series, over 1.4826 times the median absolute deviation; null where that is 0."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_m", F.median(x).over(w)).withColumn("_d", 1.4826 * F.median(F.abs(F.col(x) - F.col("_m"))).over(w))
    return rows.withColumn("z", (F.col(x) - F.col("_m")) / F.when(F.col("_d") > 1e-9, F.col("_d"))).drop("_m", "_d")


def with_news(score: Column, severity: Column, gamma: float, least: int = 2) -> Column:
    """score, raised by gamma where the month has an incident of severity least or more."""
    return score * (1 + gamma * F.coalesce(severity >= least, F.lit(False)).cast("int"))


def with_surge(score: Column, surge: Column, gamma: float = 0.3) -> Column:
    """score, raised by gamma for each unit of a positive surge of news."""
    return score * (1 + gamma * F.greatest(F.coalesce(surge, F.lit(0.0)), F.lit(0.0)))


def all_scores(rows: DataFrame, only: tuple = ()) -> DataFrame:
    """detector, territory_id, category, month, score of all detectors, or of those in only.

    The residuals and the scores that several detectors build on are computed once and stored.
    """
    rows = kept(rows)
    clean = kept(remove_common(rows))
    panel, multi, change, region = kept(panel_score(rows)), kept(multivariate(clean)), kept(change_points(clean)), kept(regional(rows))
    each = {
        "conformal_raw": lambda: conformal(rows), "conformal": lambda: conformal(clean), "panel": lambda: panel, "cusum": lambda: cusum(clean),
        "cusum_reset": lambda: cusum_reset(clean), "page_hinkley": lambda: page_hinkley(clean), "multivariate": lambda: multi,
        "panel_multivariate": lambda: mean_of(expanding_median(panel), expanding_median(multi)),
        "bocpd": lambda: change, "pelt": lambda: segmentation(clean), "binseg": lambda: segmentation(clean, "binseg"), "regional": lambda: region,
        "panel_bocpd": lambda: either(expanding_rank(panel), expanding_rank(change)), "panel_regional": lambda: either(expanding_rank(panel), expanding_rank(region)),
    }
    return union([make().select(F.lit(name).alias("detector"), *SERIES, "month", "score") for name, make in each.items() if not only or name in only])
