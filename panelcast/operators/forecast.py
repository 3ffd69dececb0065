"""Forecasts at all origins in one plan: the origin is a column, and history is month <= origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import SERIES, interpolated, last_valid

HORIZONS = (1, 3, 6, 12)


def targets(dense: DataFrame, first: str, last: str, horizons: tuple = HORIZONS) -> DataFrame:
    """Series x origin x h: origins from first to last less h months."""
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("origin")
    rows = dense.select("territory_id", "region_code", "category").distinct().select("*", months)
    rows = rows.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("target", F.add_months("origin", F.col("h")))
    return rows.where(F.col("target") <= F.lit(last).cast("date"))


def at(dense: DataFrame, month: str, value: str, name: str) -> DataFrame:
    return dense.select(*SERIES, F.col("month").alias(month), F.col(value).alias(name))


def naive(dense: DataFrame, asked: DataFrame) -> DataFrame:
    known = dense.withColumn("_last", last_valid("y"))
    return asked.join(at(known, "origin", "_last", "y_pred"), [*SERIES, "origin"], "left")


def seasonal_naive(dense: DataFrame, asked: DataFrame) -> DataFrame:
    rows = asked.withColumn("_year_ago", F.add_months("target", -12))
    return rows.join(at(dense, "_year_ago", "y", "y_pred"), [*SERIES, "_year_ago"], "left").drop("_year_ago")


def yearly_growth(dense: DataFrame, k: int = 3) -> DataFrame:
    """Each month's mean of y over y a year before in the last k months, as g; null without any."""
    w = Window.partitionBy(*SERIES).orderBy("month")
    rows = dense.withColumn("_r", F.when(F.lag("y", 12).over(w) > 0, F.col("y") / F.lag("y", 12).over(w)))
    return rows.withColumn("g", F.avg("_r").over(w.rowsBetween(1 - k, 0))).drop("_r")


def national(dense: DataFrame) -> DataFrame:
    """category, month, y: the sum of all series."""
    return dense.groupBy("category", "month").agg(F.round(F.sum("y"), 2).alias("y"))


def weekly_growth(weekly: DataFrame, months: DataFrame, weeks: int = 4, least: int = 2) -> DataFrame:
    """category, month, g_week: 1 plus the mean percentage of the last weeks that end by the month's end; null for fewer than least.

    weekly: category, week (its last day), pct. A week joins the months whose end is within nine weeks of it.
    """
    near = weekly.withColumn("month", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.add_months(F.trunc("week", "MM"), i))))
    near = near.where((F.col("week") <= F.last_day("month")) & (F.col("week") > F.date_sub(F.last_day("month"), 63))).join(months, "month", "left_semi")
    last = near.withColumn("_k", F.row_number().over(Window.partitionBy("category", "month").orderBy(F.desc("week")))).where(F.col("_k") <= weeks)
    return last.groupBy("category", "month").agg(F.when(F.count("pct") >= least, 1 + F.avg("pct") / 100).alias("g_week"))


def category_growth(dense: DataFrame, k: int = 3, more_than: int = 50, weekly: DataFrame | None = None) -> DataFrame:
    """category, month, g_cat: the median over series if more than more_than have one, else the growth of their sum.

    Where weekly has the category, its last weeks stand for the growth of the sum.
    """
    own = yearly_growth(dense, k)
    w = Window.partitionBy("category").orderBy("month")
    total = national(dense).withColumn("_r", F.col("y") / F.lag("y", 12).over(w)).select("category", "month", F.avg("_r").over(w.rowsBetween(1 - k, 0)).alias("_national"))
    if weekly is not None:
        total = total.join(weekly_growth(weekly, dense.select("month").distinct()), ["category", "month"], "left").withColumn("_national", F.coalesce("g_week", "_national")).drop("g_week")
    panel = own.groupBy("category", "month").agg(F.median("g").alias("_median"), F.count("g").alias("_n"))
    return panel.join(total, ["category", "month"]).select("category", "month", F.when(F.col("_n") > more_than, F.col("_median")).otherwise(F.col("_national")).alias("g_cat"))


def regional_growth(dense: DataFrame, k: int = 3, more_than: int = 50, lam: float = 0.0, least: int = 3, more_in_all: int = 1000, weekly: DataFrame | None = None) -> DataFrame:
    """category, region_code, month, g: category growth drawn by lam to the median of the region's series.

    Regions with fewer than least series with a growth, and months with no more than more_in_all in all, keep the category's.
    """
    by_category = category_growth(dense, k, more_than, weekly)
    own = yearly_growth(dense, k)
    region = own.groupBy("category", "region_code", "month").agg(F.when(F.count("g") >= least, F.median(F.when(F.col("g") > 0, F.log("g")))).alias("_m"))
    many = own.groupBy("month").agg((F.count("g") > more_in_all).alias("_many"))
    rows = region.join(by_category, ["category", "month"]).join(F.broadcast(many), "month")
    log_g = F.log("g_cat")
    return rows.select("category", "region_code", "month", F.when(F.col("_many") & F.col("_m").isNotNull(), F.exp(log_g + lam * (F.col("_m") - log_g))).otherwise(F.col("g_cat")).alias("g"))


def growth_factors(dense: DataFrame, alpha: float = 0.5, k: int = 3, more_than: int = 50) -> DataFrame:
    """territory_id, category, month, g_own: category growth drawn to the series' own, relative growth held in 0.5 to 2."""
    rows = yearly_growth(dense, k).join(category_growth(dense, k, more_than), ["category", "month"])
    relative = F.least(F.greatest(F.coalesce(F.col("g") / F.col("g_cat"), F.lit(1.0)), F.lit(0.5)), F.lit(2.0))
    return rows.select(*SERIES, "month", (F.col("g_cat") * F.pow(relative, F.lit(alpha))).alias("g_own"))


def seasonal_growth(dense: DataFrame, asked: DataFrame, alpha: float = 0.5, k: int = 3, more_than: int = 50) -> DataFrame:
    rows = seasonal_naive(dense, asked).join(growth_factors(dense, alpha, k, more_than).withColumnRenamed("month", "origin"), [*SERIES, "origin"], "left")
    return rows.withColumn("y_pred", F.col("y_pred") * F.col("g_own")).drop("g_own")


def history(dense: DataFrame, origins: list[str]) -> DataFrame:
    """Rows of dense for each origin that they are known at."""
    known = F.filter(F.array(*[F.lit(o).cast("date") for o in origins]), lambda o: o >= F.col("month"))
    return dense.withColumn("origin", F.explode(known))


def at_origins(dense: DataFrame, origins: list[str], months: int) -> DataFrame:
    """Rows of the last months at each origin."""
    near = F.filter(F.array(*[F.lit(o).cast("date") for o in origins]), lambda o: (o >= F.col("month")) & (F.add_months(o, -months) < F.col("month")))
    return dense.withColumn("origin", F.explode(near))


def national_profile(dense: DataFrame, origins: list[str], years: int = 5) -> DataFrame:
    """category, origin, moy, s_nat: centred month means of the detrended log of the national series in the last years."""
    past = at_origins(national(dense).where("y > 0"), origins, 12 * years)
    w = Window.partitionBy("category", "origin").orderBy("month")
    rows = past.withColumns({"_l": F.log("y"), "_i": F.row_number().over(w) - 1}).withColumn("_d", F.col("_l") - F.lag("_l", 12).over(w))
    rows = rows.withColumn("_g", F.coalesce(F.avg("_d").over(Window.partitionBy("category", "origin")) / 12, F.lit(0.0)))
    means = rows.groupBy("category", "origin", F.month("month").alias("moy")).agg(F.avg(F.col("_l") - F.col("_g") * F.col("_i")).alias("_s"))
    return means.select("category", "origin", "moy", (F.col("_s") - F.avg("_s").over(Window.partitionBy("category", "origin"))).alias("s_nat"))


def seasonal_profiles(dense: DataFrame, origins: list[str], k_growth: int = 3, lam_region: float = 0.5, lam_own: float = 0.3, more_than: int = 50, region_least: int = 3, w_national: dict[str, float] | None = None, growth: DataFrame | None = None) -> DataFrame:
    """territory_id, region_code, category, origin, moy, s, g_month: log deviations by month of the year.

    Category medians (the national profile, where too few series are whole), drawn by lam_region to those of the
    region, drawn by lam_own to the series' own. w_national: category -> share of the national profile in the
    category's. growth: as from regional_growth; without it the category's.
    """
    growth = growth if growth is not None else regional_growth(dense, k_growth, more_than)
    growth = growth.select("category", "region_code", F.col("month").alias("origin"), (F.log("g") / 12).alias("g_month"))
    first = dense.agg(F.min("month").alias("_first"))
    # the mean of logs less growth times position is that of each: running sums by month of the year give it at every origin, and
    # the last twelve months of an origin hold one row for each month of the year
    known = F.when(F.col("y") > 0, F.log("y"))
    w = Window.partitionBy(*SERIES, "moy").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    running = dense.crossJoin(F.broadcast(first)).withColumns({"moy": F.month("month"), "_position": F.months_between("month", "_first")})
    running = running.select(*SERIES, "region_code", "month", "moy", F.count(known).over(w).alias("_n"), F.sum(known).over(w).alias("_sum"), F.sum(F.when(known.isNotNull(), F.col("_position"))).over(w).alias("_at"))
    rows = at_origins(running, origins, 12).join(growth, ["category", "region_code", "origin"])
    own = rows.select(*SERIES, "region_code", "origin", "g_month", "moy", ((F.col("_sum") - F.col("g_month") * F.col("_at")) / F.col("_n")).alias("d"))
    series = Window.partitionBy(*SERIES, "origin")
    own = own.withColumns({"_n": F.count("d").over(series), "d": F.col("d") - F.avg("d").over(series)})
    whole = F.when(F.col("_n") == 12, F.col("d"))
    by_category, by_region = Window.partitionBy("category", "origin", "moy"), Window.partitionBy("category", "region_code", "origin", "moy")
    rows = own.withColumns({
        "_c": F.when(F.count(whole).over(by_category) > more_than, F.median(whole).over(by_category)),
        "_r": F.when(F.count(whole).over(by_region) >= region_least, F.median(whole).over(by_region)),
    }).join(national_profile(dense, origins), ["category", "origin", "moy"], "left")
    share = F.coalesce(F.create_map(*[F.lit(x) for pair in w_national.items() for x in pair])[F.col("category")], F.lit(0.0)) if w_national else F.lit(0.0)
    category = F.when(F.col("_c").isNotNull() & F.col("s_nat").isNotNull(), (1 - share) * F.col("_c") + share * F.col("s_nat")).otherwise(F.coalesce("_c", "s_nat"))
    region = F.when(F.col("_r").isNotNull(), category + lam_region * (F.col("_r") - category)).otherwise(category)
    return rows.select(*SERIES, "region_code", "origin", "moy", "g_month", (region + lam_own * (F.coalesce("d", region) - region)).alias("s"))


def damped(g: Column, anchor: Column, phi: Column, h: Column) -> Column:
    """Sum over j to h of anchor + (g - anchor) phi^j; h times g for a phi of 1."""
    return F.when(phi == 1, h * g).otherwise(h * anchor + (g - anchor) * phi * (1 - F.pow(phi, h)) / F.when(phi != 1, 1 - phi))


def own_trends(recent: DataFrame, beta: float, least: int = 9, reach: float = 0.03) -> DataFrame:
    """territory_id, category, origin, g_month drawn by beta to the slope of the deseasonalised logs of the last twelve months.

    The slope is held within reach of the growth, and needs least values.
    """
    z = F.when(F.col("y") > 0, F.log("y")) - F.col("s")
    fit = recent.where("_j < 12").groupBy(*SERIES, "origin", "g_month").agg(F.regr_slope(z, -F.col("_j")).alias("_b"), F.count(z).alias("_n"))
    g = F.col("g_month")
    held = F.least(F.greatest(F.col("_b"), g - reach), g + reach)
    return fit.select(*SERIES, "origin", F.when((F.col("_n") >= least) & F.col("_b").isNotNull(), g + beta * (held - g)).otherwise(g).alias("_own"))


def seasonal_transfer(dense: DataFrame, asked: DataFrame, origins: list[str], k_level: int = 2, phis: tuple = (1.0,), anchor_years: int = 3, beta_trend: float = 0.0, robust: bool = False, undamped: tuple = (), **profile: object) -> DataFrame:
    """Level of the last k_level deseasonalised logs, growth (damped to the long-run rate by phi), seasonal profile.

    A row for each of asked and each phi; 1 doesn't damp. beta_trend draws growth to the series' own trend; robust takes the
    median as level; categories in undamped keep their growth.
    """
    s = seasonal_profiles(dense, origins, **profile)
    past = at_origins(dense, origins, max(k_level, 12 if beta_trend else 0)).withColumn("moy", F.month("month")).withColumn("_j", F.months_between("origin", "month"))
    recent = past.join(s, [*SERIES, "region_code", "origin", "moy"])
    if beta_trend:
        trends = own_trends(recent, beta_trend)
        recent = recent.join(trends, [*SERIES, "origin"]).withColumn("g_month", F.col("_own")).drop("_own")
        s = s.join(trends, [*SERIES, "origin"]).withColumn("g_month", F.col("_own")).drop("_own")
    value = F.when(F.col("y") > 0, F.log("y")) - F.col("s") + F.col("g_month") * F.col("_j")
    level = recent.where(F.col("_j") < k_level).groupBy(*SERIES, "origin").agg((F.median(value) if robust else F.avg(value)).alias("_level"))
    fallback = at(dense.withColumn("_v", last_valid("y")), "origin", "_v", "_last")
    w = Window.partitionBy("category").orderBy("month")
    yearly = national(dense).withColumn("_r", F.log(F.col("y") / F.lag("y", 12).over(w)))
    anchor = yearly.select("category", F.col("month").alias("origin"), (F.avg("_r").over(w.rowsBetween(1 - 12 * anchor_years, 0)) / 12).alias("_a"))
    rows = asked.withColumn("moy", F.month("target")).join(s, [*SERIES, "region_code", "origin", "moy"], "left")
    rows = rows.join(level, [*SERIES, "origin"], "left").join(fallback, [*SERIES, "origin"], "left").join(anchor, ["category", "origin"], "left")
    rows = rows.withColumn("phi", F.explode(F.array(*map(F.lit, phis))))
    a = F.when(F.col("category").isin(list(undamped)), F.col("g_month")).otherwise(F.coalesce("_a", "g_month")) if undamped else F.coalesce("_a", "g_month")
    start = F.coalesce("_level", F.when(F.col("_last") > 0, F.log("_last")))
    return rows.withColumn("y_pred", F.exp(start + damped(F.col("g_month"), a, F.col("phi"), F.col("h")) + F.col("s"))).select(*asked.columns, "phi", "y_pred")


def per_day(dense: DataFrame) -> DataFrame:
    """dense with y a day, for a model that takes the lengths of months into account; see times_days."""
    return dense.withColumn("y", F.col("y") / F.dayofmonth(F.last_day("month")))


def times_days(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("y_pred", F.col("y_pred") * F.dayofmonth(F.last_day("target")))


# Forecasts of the deseasonalised logs by a plug-in


def deseasonalised(dense: DataFrame, profile: DataFrame, origins: list[str]) -> DataFrame:
    """territory_id, category, origin, month, z: logs less the profile, gaps filled between the first value and the origin."""
    past = history(dense, origins).withColumn("moy", F.month("month")).join(profile.drop("region_code", "g_month"), [*SERIES, "origin", "moy"])
    rows = past.withColumn("z", F.when(F.col("y") > 0, F.log("y")) - F.col("s"))
    keys = (*SERIES, "origin")
    known = F.count("z").over(Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_known", known).where("_known > 0")
    return rows.withColumn("z", interpolated("z", keys)).select(*keys, "month", "z")


def backcast(contexts: DataFrame, country: DataFrame, origins: list[str], first: str, start: str, anchor_months: int = 6) -> DataFrame:
    """contexts with months before first: the series' level in its first months and the national series' moves.

    country: category, month, y. Its log is freed of month means around a line, from what is known at the origin.
    """
    past = history(country.where("y > 0"), origins)
    w = Window.partitionBy("category", "origin")
    rows = past.withColumns({"_l": F.log("y"), "_i": (F.row_number().over(w.orderBy("month")) - 1).cast("double")})
    line = rows.groupBy("category", "origin").agg(F.regr_slope("_l", "_i").alias("_b"), F.regr_intercept("_l", "_i").alias("_a"))
    rows = rows.join(line, ["category", "origin"]).withColumn("_rest", F.col("_l") - F.col("_a") - F.col("_b") * F.col("_i"))
    rows = rows.withColumn("_d", F.col("_l") - F.avg("_rest").over(Window.partitionBy("category", "origin", F.month("month"))))
    begin = F.lit(first).cast("date")
    anchor = F.avg(F.when((F.col("month") >= begin) & (F.col("month") < F.add_months(begin, anchor_months)), F.col("_d"))).over(w)
    moves = rows.select("category", "origin", "month", (F.col("_d") - anchor).alias("_move")).where((F.col("month") >= start) & (F.col("month") < begin))
    order = Window.partitionBy(*SERIES, "origin").orderBy("month")
    base = contexts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= anchor_months).groupBy(*SERIES, "origin").agg(F.avg("z").alias("_level"))
    before = base.join(moves, ["category", "origin"]).select(*SERIES, "origin", "month", (F.col("_level") + F.col("_move")).alias("z"))
    return contexts.unionByName(before)


def level_and_drift(contexts: DataFrame, k: int = 3) -> DataFrame:
    """territory_id, category, origin, level, drift: the mean of the last k values and the slope of all; a plug-in for residual_forecast."""
    w = Window.partitionBy(*SERIES, "origin").orderBy(F.desc("month"))
    rows = contexts.withColumn("_j", (F.row_number().over(w) - 1).cast("double"))
    return rows.groupBy(*SERIES, "origin").agg(F.avg(F.when(F.col("_j") < k, F.col("z"))).alias("level"), F.coalesce(F.regr_slope("z", -F.col("_j")), F.lit(0.0)).alias("drift"))


def residual_forecast(dense: DataFrame, asked: DataFrame, contexts: DataFrame, profile: DataFrame, model=level_and_drift) -> DataFrame:
    """asked with y_pred: a model of the contexts' values plus the profile of the target month; the last value without one.

    model: contexts -> territory_id, category, origin, level, drift and maybe phi, the drift's damping. Larger models run there in mapInPandas.
    """
    s, made = profile.select(*SERIES, "origin", "moy", "s"), model(contexts)
    fallback = at(dense.withColumn("_v", last_valid("y")), "origin", "_v", "_last")
    rows = asked.withColumn("moy", F.month("target")).join(s, [*SERIES, "origin", "moy"], "left").join(made, [*SERIES, "origin"], "left").join(fallback, [*SERIES, "origin"], "left")
    moved = damped(F.col("drift"), F.lit(0.0), F.col("phi"), F.col("h")) if "phi" in made.columns else F.col("drift") * F.col("h")
    return rows.withColumn("y_pred", F.coalesce(F.exp(F.col("level") + moved + F.col("s")), "_last")).select(*asked.columns, "y_pred")


# Intervals and the national check


def interval_quantiles(records: DataFrame, months: int = 12, shares: tuple = (0.05, 0.1, 0.9, 0.95)) -> DataFrame:
    """category, h, lo90, lo80, hi80, hi90: quantiles of log errors, linear in h between the horizons of records."""
    rows = records.where("complete and y_true > 0 and y_pred > 0").withColumn("_r", F.log(F.col("y_true") / F.col("y_pred")))
    found = rows.groupBy("category", "h").agg(F.percentile("_r", F.array(*map(F.lit, shares))).alias("_q"))
    names = ["lo90", "lo80", "hi80", "hi90"]
    found = found.select("category", "h", *[F.get("_q", i).alias(c) for i, c in enumerate(names)])
    every = found.select("category").distinct().select("category", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("h"))
    every = every.join(found, ["category", "h"], "left")
    return every.withColumns({c: interpolated(c, ("category",), "h") for c in names})


def with_intervals(forecast: DataFrame, quantiles: DataFrame) -> DataFrame:
    names = ["lo90", "lo80", "hi80", "hi90"]
    return forecast.join(F.broadcast(quantiles), ["category", "h"], "left").withColumns({c: F.col("y_pred") * F.exp(c) for c in names})


def national_check(dense: DataFrame, forecast: DataFrame, weights: DataFrame, origin: str) -> DataFrame:
    """category, target and yearly growths in the year after origin: of the panel before, of the country before, as forecast, as it was.

    The panel's sums are weighted (weights: territory_id, w) over whole series. forecast: h from 1 to 12 at origin.
    """
    whole = dense.where("complete").join(weights, "territory_id")
    seen = whole.groupBy("category", "month").agg(F.sum(F.col("y") * F.col("w")).alias("v"))
    made = forecast.where(F.col("origin") == origin).join(dense.where("complete").select(*SERIES).distinct(), list(SERIES)).join(weights, "territory_id")
    made = made.groupBy("category", "target").agg(F.sum(F.col("y_pred") * F.col("w")).alias("p"))
    past = lambda n, name: seen.select("category", F.add_months("month", 12 * n).alias("target"), F.col("v").alias(name))
    w = Window.partitionBy("category").orderBy("month")
    grown = national(dense).select("category", "month", (F.col("y") / F.lag("y", 12).over(w) - 1).alias("g"))
    country = lambda n, name: grown.select("category", F.add_months("month", 12 * n).alias("target"), F.col("g").alias(name))
    rows = made
    for side in (past(1, "v1"), past(2, "v2"), country(1, "country_before"), country(0, "country")):
        rows = rows.join(side, ["category", "target"], "left")
    return rows.select("category", "target", (F.col("v1") / F.col("v2") - 1).alias("panel_before"), "country_before", (F.col("p") / F.col("v1") - 1).alias("panel_forecast"), "country")


def check_summary(check: DataFrame) -> DataFrame:
    """category and nine means, in percent, of national_check: growths, the gap before, the error, and that of no change."""
    error, still = F.col("panel_forecast") - F.col("country"), F.col("panel_before") - F.col("country")
    mean = lambda x, name: (100 * F.avg(x)).alias(name)
    return check.groupBy("category").agg(
        *[mean(c, c) for c in ("panel_before", "country_before", "panel_forecast", "country")],
        mean(F.col("panel_before") - F.col("country_before"), "gap_before"), mean(error, "error"), mean(F.abs(error), "mae"), mean(still, "still_error"), mean(F.abs(still), "still_mae"),
    )


def series_breaks(country: DataFrame, year: int, base: tuple, tolerance: float = 0.1) -> DataFrame:
    """category, ratio, usual, broken: January over December before in year, against the median of the base years."""
    w = Window.partitionBy("category").orderBy("month")
    rows = country.withColumn("_r", F.col("y") / F.lag("y").over(w)).where(F.month("month") == 1)
    of = lambda cond: F.when(cond, F.col("_r"))
    out = rows.groupBy("category").agg(F.max(of(F.year("month") == year)).alias("ratio"), F.median(of(F.year("month").between(*base))).alias("usual"))
    return out.withColumn("broken", F.coalesce(F.abs(F.col("ratio") / F.col("usual") - 1) > tolerance, F.lit(False)))


def with_truth(dense: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecasts with the truth, the year before and the scale of MASE."""
    w = Window.partitionBy(*SERIES).orderBy("month")
    step = F.abs(F.col("y") - F.lag("y").over(w))
    scaled = dense.withColumn("_step", step).withColumn("mase_scale", F.avg("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    truth = dense.select(*SERIES, F.col("month").alias("target"), F.col("y").alias("y_true"), F.lag("y", 12).over(w).alias("y_lag12"), "complete")
    return forecast.join(truth, [*SERIES, "target"], "left").join(at(scaled, "origin", "mase_scale", "mase_scale"), [*SERIES, "origin"], "left")


def records(dense: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """Forecast records of models by name; the truth is joined once for all."""
    return with_truth(dense, reduce(DataFrame.unionByName, [p.withColumn("model", F.lit(m)) for m, p in models.items()]))


def log_mean(records: DataFrame, name: str) -> DataFrame:
    """Geometric mean of all models' forecasts; null where one is null."""
    keys = ["territory_id", "region_code", "category", "origin", "h", "target", "y_true", "y_lag12", "complete", "mase_scale"]
    mean = F.exp(F.avg(F.log("y_pred")))
    return records.groupBy(*keys).agg(F.when(F.count("y_pred") == F.count("*"), mean).alias("y_pred")).withColumn("model", F.lit(name))


def stacked(records: DataFrame, top_k: int = 3, more_than: int = 100) -> DataFrame:
    """Weights 1/MAE^2 of the best top_k models on targets known at the origin, by h (else the nearest smaller) and category.

    Without more than more_than such rows all models weigh the same.
    """
    known = records.where("complete and y_true is not null and y_pred is not null").select("model", "category", F.col("h").alias("h_used"), "target", F.abs(F.col("y_true") - F.col("y_pred")).alias("ae"))
    asked = records.select("category", "origin", "h", "model").distinct()
    past = asked.join(known, ["category", "model"]).where((F.col("target") <= F.col("origin")) & (F.col("h_used") <= F.col("h")))
    mae = past.groupBy("category", "origin", "h", "model", "h_used").agg(F.avg("ae").alias("mae"), F.count("*").alias("n")).where(F.col("n") > more_than)
    nearest = Window.partitionBy("category", "origin", "h")
    mae = mae.withColumn("_h", F.max("h_used").over(nearest)).where("h_used = _h")
    mae = mae.withColumn("_k", F.row_number().over(nearest.orderBy("mae", "model"))).withColumn("_w", F.when(F.col("_k") <= top_k, 1 / F.pow("mae", F.lit(2))).otherwise(0.0))
    weights = mae.select("category", "origin", "h", "model", (F.col("_w") / F.sum("_w").over(nearest)).alias("w"))
    rows = records.join(weights, ["category", "origin", "h", "model"], "left").withColumn("_any", F.max("w").over(Window.partitionBy("category", "origin", "h")))
    w = F.when(F.col("_any").isNull(), F.lit(1.0)).otherwise(F.coalesce("w", F.lit(0.0)))
    pred = F.exp(F.sum(w * F.log("y_pred")) / F.sum(w))
    return rows.groupBy("territory_id", "category", "origin", "h", "target", "y_true").agg(F.when(F.count("y_pred") == F.count("*"), pred).alias("y_pred"))
