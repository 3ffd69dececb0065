"""Exponential smoothing and Theta models as folds over an ordered array; parameters are fitted over a grid within the fold.

A model takes contexts (territory_id, category, origin, month, z) and gives territory_id, category, origin, level, drift, phi: the
forecast at h is level plus drift times the sum of phi^j for j to h. A series needs LEAST values; one with fewer has nulls, for which
the caller falls back to the last value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.forecast import at, damped, history
from panelcast.operators.panel import SERIES, interpolated, last_valid

LEAST = 3
ALPHAS = tuple(i / 20 for i in range(1, 21))
#: alpha, the share of it by which the trend follows, and the trend's damping.
TRENDS = tuple((a, b, phi) for a in (0.1, 0.3, 0.5, 0.7, 0.9) for b in (0.1, 0.3) for phi in (0.8, 0.9, 0.98, 1.0))
KEYS = [*SERIES, "origin"]


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _after_first(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


def smoothed(x: Column, alphas: tuple = ALPHAS) -> Column:
    """sse, alpha, level: simple smoothing from the first value, of the alpha with the least squared one-step errors."""
    grid = F.array(*map(F.lit, alphas))
    start = F.transform(grid, lambda a: F.struct(F.get(x, F.lit(0)).alias("l"), F.lit(0.0).alias("e")))

    def step(states: Column, v: Column) -> Column:
        return F.zip_with(states, grid, lambda s, a: F.struct((s["l"] + a * (v - s["l"])).alias("l"), (s["e"] + (v - s["l"]) * (v - s["l"])).alias("e")))

    return F.array_min(F.zip_with(F.aggregate(_after_first(x), start, step), grid, lambda s, a: F.struct(s["e"].alias("sse"), a.alias("alpha"), s["l"].alias("level"))))


def trended(x: Column, trends: tuple = TRENDS) -> Column:
    """sse, i, level, drift, phi: damped-trend smoothing; the first trend is the mean step of the first year."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(a * b).alias("b"), F.lit(p).alias("phi")) for i, (a, b, p) in enumerate(trends)])
    last = F.least(F.size(x), F.lit(12)) - 1
    first = (F.get(x, last) - F.get(x, F.lit(0))) / last
    start = F.transform(grid, lambda g: F.struct(F.get(x, F.lit(0)).alias("l"), first.alias("t"), F.lit(0.0).alias("e")))

    def step(states: Column, v: Column) -> Column:
        def one(s: Column, g: Column) -> Column:
            made = s["l"] + g["phi"] * s["t"]
            return F.struct((made + g["a"] * (v - made)).alias("l"), (g["phi"] * s["t"] + g["b"] * (v - made)).alias("t"), (s["e"] + (v - made) * (v - made)).alias("e"))

        return F.zip_with(states, grid, one)

    found = F.zip_with(F.aggregate(_after_first(x), start, step), grid, lambda s, g: F.struct(s["e"].alias("sse"), g["i"].alias("i"), s["l"].alias("level"), s["t"].alias("drift"), g["phi"].alias("phi")))
    return F.array_min(found)


def line(x: Column) -> Column:
    """a, b: the least-squares line a + b t of values at t = 0, 1, ..."""
    n = F.size(x).cast("double")
    sums = F.aggregate(x, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("tx")), lambda s, v: F.struct((s["t"] + 1).alias("t"), (s["x"] + v).alias("x"), (s["tx"] + s["t"] * v).alias("tx")))

    def fit(s: Column) -> Column:
        b = (s["tx"] - (n - 1) / 2 * s["x"]) / (n * (n * n - 1) / 12)
        return F.struct((s["x"] / n - b * (n - 1) / 2).alias("a"), b.alias("b"))

    return _bind(sums, fit)


def _of_series(contexts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    values = F.transform(F.array_sort(F.collect_list(F.struct("month", "z"))), lambda v: v["z"])
    rows = contexts.where("z is not null").groupBy(*KEYS).agg(values.alias("_x")).where(F.size("_x") >= LEAST)
    return rows.select(*KEYS, model(F.col("_x")).alias("_m")).select(*KEYS, "_m.level", "_m.drift", "_m.phi")


def ses(contexts: DataFrame) -> DataFrame:
    """Simple exponential smoothing: a flat forecast."""
    return _of_series(contexts, lambda x: _bind(smoothed(x), lambda m: F.struct(m["level"].alias("level"), F.lit(0.0).alias("drift"), F.lit(1.0).alias("phi"))))


def theta(contexts: DataFrame) -> DataFrame:
    """Mean of the Theta line 0, the series' straight line, and of line 2, twice the series less it, smoothed."""

    def model(x: Column) -> Column:
        def lines(f: Column) -> Column:
            second = smoothed(F.transform(x, lambda v, i: 2 * v - (f["a"] + f["b"] * i)))
            end = f["a"] + f["b"] * (F.size(x) - 1)
            return F.struct((0.5 * end + 0.5 * second["level"]).alias("level"), (0.5 * f["b"]).alias("drift"), F.lit(1.0).alias("phi"))

        return _bind(line(x), lines)

    return _of_series(contexts, model)


def information(sse: Column, n: Column, k: int) -> Column:
    """Corrected Akaike criterion of k parameters; none where n leaves no room for them."""
    return F.when(n - k - 1 > 0, n * F.log(F.greatest(sse, F.lit(1e-12)) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf")))


def ets(contexts: DataFrame) -> DataFrame:
    """Simple or damped-trend smoothing, whichever has the smaller information criterion (the simple one in a tie)."""

    def model(x: Column) -> Column:
        n = (F.size(x) - 1).cast("double")

        def choose(m: Column) -> Column:
            simple = information(m["s"]["sse"], n, 2) <= information(m["t"]["sse"], n, 5)
            pick = lambda a, b: F.when(simple, a).otherwise(b)
            return F.struct(pick(m["s"]["level"], m["t"]["level"]).alias("level"), pick(F.lit(0.0), m["t"]["drift"]).alias("drift"), pick(F.lit(1.0), m["t"]["phi"]).alias("phi"))

        return _bind(F.struct(smoothed(x).alias("s"), trended(x).alias("t")), choose)

    return _of_series(contexts, model)


# Raw mode: the levels themselves, with their own seasonal indices


def raw_contexts(dense: DataFrame, origins: list[str]) -> DataFrame:
    """territory_id, category, origin, month, z: y itself, gaps filled between the first value and the origin."""
    rows = history(dense, origins)
    known = F.count("y").over(Window.partitionBy(*KEYS).orderBy("month").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_known", known).where("_known > 0").withColumn("z", interpolated("y", tuple(KEYS))).select(*KEYS, "month", "z")


def with_indices(contexts: DataFrame) -> DataFrame:
    """contexts with moy and index: the month's mean ratio to a centred moving year, of mean 1; 1 for a series without two years of positive values."""
    w = Window.partitionBy(*KEYS).orderBy("month")
    ahead, behind = w.rowsBetween(-5, 6), w.rowsBetween(-6, 5)
    centre = F.when((F.count("z").over(ahead) == 12) & (F.count("z").over(behind) == 12), (F.avg("z").over(ahead) + F.avg("z").over(behind)) / 2)
    rows = contexts.withColumns({"moy": F.month("month"), "_ratio": F.when(centre > 0, F.col("z") / centre)})
    series, month = Window.partitionBy(*KEYS), Window.partitionBy(*KEYS, "moy")
    rows = rows.withColumns({"_mean": F.avg("_ratio").over(month), "_n": F.count("z").over(series), "_least": F.min("z").over(series)})
    rows = rows.withColumn("_sum", F.sum(F.col("_mean") / F.count("*").over(month)).over(series)).withColumn("_months", F.count("_mean").over(series))
    usable = (F.col("_n") >= 24) & (F.col("_least") > 0) & (F.col("_months") == F.col("_n"))
    return rows.select(*KEYS, "month", "z", "moy", F.when(usable, F.col("_mean") * 12 / F.col("_sum")).otherwise(F.lit(1.0)).alias("index"))


def raw_forecast(dense: DataFrame, asked: DataFrame, origins: list[str], model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """asked with y_pred: a model of the levels freed of their seasonal indices, times the index of the target month; the last value without one."""
    rows = with_indices(raw_contexts(dense, origins))
    made = model(rows.withColumn("z", F.col("z") / F.col("index")))
    index = rows.groupBy(*KEYS, "moy").agg(F.first("index").alias("index"))
    fallback = at(dense.withColumn("_v", last_valid("y")), "origin", "_v", "_last")
    out = asked.withColumn("moy", F.month("target")).join(index, [*KEYS, "moy"], "left").join(made, KEYS, "left").join(fallback, KEYS, "left")
    value = (F.col("level") + damped(F.col("drift"), F.lit(0.0), F.col("phi"), F.col("h"))) * F.coalesce("index", F.lit(1.0))
    return out.withColumn("y_pred", F.coalesce(value, "_last")).select(*asked.columns, "y_pred")
