"""Queries of the seasonal-transfer forecasts, their ensemble, residual models, intervals and the national check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast import config
from panelcast.operators import evaluate, forecast
from panelcast.plans.queries import MEASURES, SHOWN
from panelcast.plans.registry import BACKTEST, LARGE, SERIES, dense, records, register, rounded
from panelcast.plans.sql import RECORDS, query
from panelcast.sources.tables import LAST, table

ORIGINS = [f"{2000 + (6 + i) // 12}-{(6 + i) % 12 + 1:02d}-01" for i in range(12)]
#: Series with a growth in a month from which regions draw theirs; the star schema has 125 series.
MANY = 100
STF, ENSEMBLE = config.load("stf"), config.load("ensemble")

NATIONAL_PROFILE = """
origins AS (SELECT month FROM calendar WHERE month >= DATE '2000-07-01' AND month < DATE '2001-07-01'),
np_past AS (SELECT t.category, o.month AS origin, t.month, ln(t.y) AS l, row_number() OVER (PARTITION BY t.category, o.month ORDER BY t.month) - 1 AS i FROM total t JOIN origins o ON t.month <= o.month AND t.month > o.month - to_months(60) WHERE y > 0),
np_d AS (SELECT *, l - lag(l, 12) OVER (PARTITION BY category, origin ORDER BY month) AS d FROM np_past),
np_g AS (SELECT *, coalesce(avg(d) OVER (PARTITION BY category, origin) / 12, 0) AS g FROM np_d),
np_m AS (SELECT category, origin, month(month) AS moy, avg(l - g * i) AS s FROM np_g GROUP BY ALL),
nat_profile AS (SELECT category, origin, moy, s - avg(s) OVER (PARTITION BY category, origin) AS s_nat FROM np_m)
"""


def growth_sql(k: int, lam: float = 0.0, large: int = LARGE, s: str = "") -> str:
    """CTEs gs (own), gc (category), gx (region) of the growth over k months, named with the suffix s."""
    return f"""
gs{s} AS (SELECT territory_id, region_code, category, month, avg(CASE WHEN y12 > 0 THEN y / y12 END) OVER (PARTITION BY territory_id, category ORDER BY month ROWS {k - 1} PRECEDING) AS g FROM scaled),
gn{s} AS (SELECT category, month, avg(y / y12) OVER (PARTITION BY category ORDER BY month ROWS {k - 1} PRECEDING) AS g FROM total_lag),
gc{s} AS (SELECT d.category, d.month, CASE WHEN count(d.g) > {large} THEN median(d.g) ELSE any_value(n.g) END AS g_cat FROM gs{s} d JOIN gn{s} n ON n.category = d.category AND n.month = d.month GROUP BY ALL),
gm{s} AS (SELECT month, count(g) > {MANY} AS many FROM gs{s} GROUP BY ALL),
gr{s} AS (SELECT category, region_code, month, CASE WHEN count(g) >= 3 THEN median(CASE WHEN g > 0 THEN ln(g) END) END AS m FROM gs{s} GROUP BY ALL),
gx{s} AS (SELECT r.category, r.region_code, r.month, CASE WHEN many AND m IS NOT NULL THEN exp(ln(g_cat) + {lam} * (m - ln(g_cat))) ELSE g_cat END AS g
  FROM gr{s} r JOIN gc{s} c ON c.category = r.category AND c.month = r.month JOIN gm{s} n ON n.month = r.month)
"""


def profile_sql(k: int, lam: float = 0.0, large: int = LARGE, s: str = "") -> str:
    """growth_sql and CTEs past and profile."""
    return growth_sql(k, lam, large, s) + f""",
past{s} AS (
  SELECT d.*, o.month AS origin, ln(c.g) / 12 AS g_month, date_diff('month', DATE '1995-01-01', d.month) AS pos
  FROM dense d JOIN origins o ON d.month <= o.month JOIN gx{s} c ON c.category = d.category AND c.region_code = d.region_code AND c.month = o.month),
means{s} AS (SELECT territory_id, category, region_code, origin, g_month, month(month) AS moy, avg(CASE WHEN y > 0 THEN ln(y) END - g_month * pos) AS d FROM past{s} GROUP BY ALL),
centred{s} AS (SELECT * REPLACE (d - avg(d) OVER w AS d), count(d) OVER w AS n FROM means{s} WINDOW w AS (PARTITION BY territory_id, category, origin)),
medians{s} AS (
  SELECT *, count(CASE WHEN n = 12 THEN d END) OVER c AS nc, median(CASE WHEN n = 12 THEN d END) OVER c AS mc,
    count(CASE WHEN n = 12 THEN d END) OVER r AS nr, median(CASE WHEN n = 12 THEN d END) OVER r AS mr
  FROM centred{s} WINDOW c AS (PARTITION BY category, origin, moy), r AS (PARTITION BY category, region_code, origin, moy)),
drawn{s} AS (SELECT m.*, CASE WHEN nc > {large} THEN mc ELSE s_nat END AS sc FROM medians{s} m LEFT JOIN nat_profile p ON p.category = m.category AND p.origin = m.origin AND p.moy = m.moy),
regions{s} AS (SELECT *, CASE WHEN nr >= 3 THEN sc + 0.5 * (mr - sc) ELSE sc END AS sr FROM drawn{s}),
profile{s} AS (SELECT *, sr + 0.3 * (coalesce(d, sr) - sr) AS s FROM regions{s})
"""


def transfer_sql(phi: float | None, k_level: int, s: str = "", robust: bool = False, beta: float = 0.0) -> str:
    """SELECT of territory_id, category, origin, h, y_pred over profile_sql's CTEs."""
    g = "p.g_month" if not beta else "t.g_own"
    grown = f"{g} * h" if phi is None else f"(h * coalesce(a, {g}) + ({g} - coalesce(a, {g})) * {phi} * (1 - pow({phi}, h)) / (1 - {phi}))"
    mean = "median" if robust else "avg"
    trend = f"""LEFT JOIN (SELECT territory_id, category, origin, CASE WHEN n >= 9 AND b IS NOT NULL THEN g_month + {beta} * (least(greatest(b, g_month - 0.03), g_month + 0.03) - g_month) ELSE g_month END AS g_own FROM (
  SELECT t.territory_id, t.category, t.origin, t.g_month, regr_slope(CASE WHEN y > 0 THEN ln(y) END - s, -date_diff('month', month, t.origin)) AS b, count(CASE WHEN y > 0 THEN ln(y) END - s) AS n
  FROM past{s} t JOIN profile{s} p ON p.territory_id = t.territory_id AND p.category = t.category AND p.origin = t.origin AND p.moy = month(t.month) WHERE date_diff('month', month, t.origin) < 12 GROUP BY ALL)) t
ON t.territory_id = q.territory_id AND t.category = q.category AND t.origin = q.origin"""
    level = f"""(SELECT t.territory_id, t.category, t.origin, {mean}(CASE WHEN y > 0 THEN ln(y) END - s + @g * date_diff('month', month, t.origin)) AS level
  FROM past{s} t JOIN profile{s} p ON p.territory_id = t.territory_id AND p.category = t.category AND p.origin = t.origin AND p.moy = month(t.month) @j WHERE date_diff('month', month, t.origin) < {k_level} GROUP BY ALL)"""
    if beta:
        level = level.replace("@g", "t2.g_own").replace("@j", trend.replace(") t\nON t.", ") t2\nON t2.").replace(" AND t.category = q.category AND t.origin = q.origin", " AND t2.category = t.category AND t2.origin = t.origin").replace("t2.territory_id = q.territory_id", "t2.territory_id = t.territory_id"))
    else:
        level = level.replace("@g", "t.g_month").replace("@j", "")
    return f"""SELECT q.territory_id, q.category, q.origin, h, exp(coalesce(level, ln(o.last_y)) + {grown} + s) AS y_pred
FROM asked q LEFT JOIN profile{s} p ON p.territory_id = q.territory_id AND p.category = q.category AND p.origin = q.origin AND p.moy = month(q.target)
LEFT JOIN {level} l ON l.territory_id = q.territory_id AND l.category = q.category AND l.origin = q.origin
LEFT JOIN lagged o ON o.territory_id = q.territory_id AND o.category = q.category AND o.month = q.origin
LEFT JOIN national n ON n.category = q.category AND n.month = q.origin {trend if beta else ''}"""


def stf_sql(phi: float | None, k_level: int = 2, k: int = 3, lam: float = 0.0, large: int = LARGE, **more: object) -> str:
    return query("SELECT * REPLACE (round(y_pred, 2) AS y_pred) FROM (" + transfer_sql(phi, k_level, **more) + ")", NATIONAL_PROFILE, profile_sql(k, lam, large))


def transfer(spark, sf, **settings: object) -> DataFrame:
    d = dense(spark, sf)
    return forecast.seasonal_transfer(d, forecast.targets(d, BACKTEST, LAST), ORIGINS, **({"more_than": LARGE} | settings))


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.select(*SERIES, "origin", "h", "y_pred"), 2, "y_pred")


@register(query("SELECT territory_id, category, origin, moy, round(s, 6) + 0.0 AS s FROM profile", NATIONAL_PROFILE, profile_sql(3)))
def stf_profile(spark, sf):
    return rounded(forecast.seasonal_profiles(dense(spark, sf), ORIGINS, more_than=LARGE).select(*SERIES, "origin", F.col("moy").cast("long").alias("moy"), "s"), 6, "s")


@register(query("SELECT category, origin, moy, round(s_nat, 6) + 0.0 AS s_nat FROM nat_profile", NATIONAL_PROFILE))
def national_profile(spark, sf):
    """Seasonal profile of the national series over five years."""
    out = forecast.national_profile(dense(spark, sf), ORIGINS)
    return rounded(out.withColumn("moy", F.col("moy").cast("long")), 6, "s_nat")


@register(query("SELECT category, region_code, month, round(g, 6) AS g FROM gx", growth_sql(3, 0.5)))
def regional_growth(spark, sf):
    return rounded(forecast.regional_growth(dense(spark, sf), 3, LARGE, ENSEMBLE["lam_growth_region"], more_in_all=MANY), 6, "g")


WEEKLY = """
wk AS (SELECT 'BUILDING' AS category, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week, round(avg(l_discount) * 100, 6) AS pct FROM lineitem GROUP BY ALL),
wm AS (SELECT c.month, week, pct, row_number() OVER (PARTITION BY c.month ORDER BY week DESC) AS k FROM calendar c JOIN wk ON week <= last_day(c.month) AND week > last_day(c.month) - 63),
wg AS (SELECT 'BUILDING' AS category, month, CASE WHEN count(pct) >= 2 THEN 1 + avg(pct) / 100 END AS g_week FROM wm WHERE k <= 4 GROUP BY ALL)"""


@register(query("""SELECT d.category, d.month, round(coalesce(any_value(g_week), any_value(n.g)), 6) AS g_cat FROM grown d JOIN national n ON n.category = d.category AND n.month = d.month
LEFT JOIN wg ON wg.category = d.category AND wg.month = d.month GROUP BY ALL""", WEEKLY))
def weekly_override(spark, sf):
    """Growth where too few series have one: the national series', and the last weeks' for the category that has weekly figures."""
    week = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 6)
    weekly = table(spark, sf, "lineitem").groupBy(week.alias("week")).agg(F.round(F.avg("l_discount") * 100, 6).alias("pct")).withColumn("category", F.lit("BUILDING"))
    return rounded(forecast.category_growth(dense(spark, sf), more_than=10_000, weekly=weekly), 6, "g_cat")


@register(stf_sql(None))
def stf_forecast(spark, sf):
    return shown(transfer(spark, sf))


@register(stf_sql(0.9))
def stf_damped_forecast(spark, sf):
    return shown(transfer(spark, sf, phis=(0.9,)))


@register(stf_sql(None, large=10_000))
def stf_national_forecast(spark, sf):
    """Too few whole series everywhere: national profile and growth."""
    return shown(transfer(spark, sf, more_than=10_000))


@register(stf_sql(None, 3, robust=True))
def stf_robust_level(spark, sf):
    return shown(transfer(spark, sf, k_level=3, robust=True))


@register(stf_sql(None, beta=0.5))
def stf_own_trend(spark, sf):
    return shown(transfer(spark, sf, beta_trend=0.5))


@register(query("""SELECT a.territory_id, a.category, a.origin, h, round(y / day(last_day(CAST(a.target - to_months(12) AS DATE))) * day(last_day(a.target)), 2) AS y_pred
FROM asked a LEFT JOIN dense d ON d.territory_id = a.territory_id AND d.category = a.category AND d.month = a.target - to_months(12)"""))
def per_day_forecast(spark, sf):
    """Seasonal naive forecast of spending a day."""
    d = forecast.per_day(dense(spark, sf))
    return shown(forecast.times_days(forecast.seasonal_naive(d, forecast.targets(d, BACKTEST, LAST))))


def grid(spark, sf) -> DataFrame:
    """Forecasts of all members of the ensemble: damping times growth window, with regional growth."""
    d = dense(spark, sf)
    asked = forecast.targets(d, BACKTEST, LAST)
    made = {}
    for k in ENSEMBLE["k_growth"]:
        growth = forecast.regional_growth(d, k, LARGE, ENSEMBLE["lam_growth_region"], more_in_all=MANY)
        made[k] = forecast.seasonal_transfer(d, asked, ORIGINS, STF["k_level"], tuple(ENSEMBLE["damp"]), ENSEMBLE["anchor_years"], more_than=LARGE, growth=growth)
    out = [p.withColumn("model", F.concat(F.lit("stf_d"), F.col("phi").cast("string"), F.lit(f"_kg{k}"))).drop("phi") for k, p in made.items()]
    return forecast.with_truth(d, out[0].unionByName(out[1]).unionByName(out[2]))


GRID = (NATIONAL_PROFILE, *[profile_sql(k, 0.5, s=f"_{k}") for k in (1, 3, 6)], "members AS (" + " UNION ALL ".join(f"SELECT *, 'stf_d{phi}_kg{k}' AS model FROM ({transfer_sql(phi, 2, f'_{k}')})" for k in (1, 3, 6) for phi in (0.8, 0.9, 0.95)) + ")")


@register(query("SELECT model, h, count(*) AS n, round(avg(y_pred), 0) AS mean_pred FROM members GROUP BY ALL", *GRID))
def stf_grid(spark, sf):
    return grid(spark, sf).groupBy("model", "h").agg(F.count("*").alias("n"), F.round(F.avg("y_pred"), 0).alias("mean_pred"))


@register(query(f"""
, mixed AS (SELECT m.territory_id, m.category, m.origin, m.h, CASE WHEN count(y_pred) = count(*) THEN exp(avg(ln(y_pred))) END AS y_pred FROM members m GROUP BY ALL),
checked AS (SELECT t.*, m.y_pred FROM truth t JOIN mixed m ON m.territory_id = t.territory_id AND m.category = t.category AND m.origin = t.origin AND m.h = t.h WHERE complete AND y_true IS NOT NULL AND y_pred IS NOT NULL)
SELECT h, {SHOWN} FROM (SELECT h, {MEASURES} FROM checked GROUP BY ALL)""", *GRID, RECORDS))
def stf_ensemble_accuracy(spark, sf):
    return rounded(evaluate.summary(forecast.log_mean(grid(spark, sf), "ens_stf9"), ["h"]), 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


# Plug-in models of the deseasonalised logs

PANEL_START = "1997-01-01"


def residual_models(spark, sf, extended: bool) -> DataFrame:
    whole = dense(spark, sf)
    d = whole.where(F.col("month") >= PANEL_START)
    profile = forecast.seasonal_profiles(d, ORIGINS[:4], more_than=LARGE)
    contexts = forecast.deseasonalised(d, profile, ORIGINS[:4])
    if extended:
        contexts = forecast.backcast(contexts, forecast.national(whole), ORIGINS[:4], PANEL_START, "1995-01-01")
    asked = forecast.targets(d, ORIGINS[0], LAST).where(F.col("origin") <= ORIGINS[3])
    return shown(forecast.residual_forecast(d, asked, contexts, profile))


LATE = (
    NATIONAL_PROFILE.replace("AND t.month > o.month - to_months(60)", "AND t.month > o.month - to_months(60) AND t.month >= DATE '1997-01-01'").replace("month < DATE '2001-07-01'", "month <= DATE '2000-10-01'"),
    profile_sql(3).replace("FROM scaled)", "FROM (SELECT * REPLACE (CASE WHEN month >= DATE '1998-01-01' THEN y12 END AS y12) FROM scaled WHERE month >= DATE '1997-01-01'))").replace("FROM total_lag)", "FROM (SELECT * REPLACE (CASE WHEN month >= DATE '1998-01-01' THEN y12 END AS y12) FROM total_lag WHERE month >= DATE '1997-01-01'))").replace("DATE '1995-01-01', d.month) AS pos\n  FROM dense d", "DATE '1997-01-01', d.month) AS pos\n  FROM (SELECT * FROM dense WHERE month >= DATE '1997-01-01') d"),
    """
zz AS (SELECT t.territory_id, t.category, t.origin, month, CASE WHEN y > 0 THEN ln(y) END - s AS z, row_number() OVER (PARTITION BY t.territory_id, t.category, t.origin ORDER BY month) AS pos
  FROM past t JOIN profile p ON p.territory_id = t.territory_id AND p.category = t.category AND p.origin = t.origin AND p.moy = month(t.month)),
zb AS (SELECT *, max(CASE WHEN z IS NOT NULL THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN z IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM zz WINDOW w AS (PARTITION BY territory_id, category, origin ORDER BY month)),
context AS (SELECT n.territory_id, n.category, n.origin, n.month, CASE WHEN n.z IS NOT NULL THEN n.z WHEN n.b IS NULL THEN p.z ELSE p.z + (q.z - p.z) * (n.pos - n.a) / (n.b - n.a) END AS z
  FROM zb n JOIN zz p ON p.territory_id = n.territory_id AND p.category = n.category AND p.origin = n.origin AND p.pos = n.a LEFT JOIN zz q ON q.territory_id = n.territory_id AND q.category = n.category AND q.origin = n.origin AND q.pos = n.b)
""",
)
BACKCAST = """
cl AS (SELECT t.category, o.month AS origin, t.month, ln(t.y) AS l, CAST(row_number() OVER (PARTITION BY t.category, o.month ORDER BY t.month) - 1 AS DOUBLE) AS i FROM total t JOIN origins o ON t.month <= o.month WHERE y > 0),
cf AS (SELECT category, origin, regr_slope(l, i) AS b, regr_intercept(l, i) AS a FROM cl GROUP BY ALL),
cd AS (SELECT cl.*, l - avg(l - a - b * i) OVER (PARTITION BY cl.category, cl.origin, month(month)) AS d FROM cl JOIN cf ON cf.category = cl.category AND cf.origin = cl.origin),
cm AS (SELECT category, origin, month, d - avg(CASE WHEN month >= DATE '1997-01-01' AND month < DATE '1997-07-01' THEN d END) OVER (PARTITION BY category, origin) AS move FROM cd),
cb AS (SELECT territory_id, category, origin, avg(z) AS level FROM (SELECT *, row_number() OVER (PARTITION BY territory_id, category, origin ORDER BY month) AS k FROM context) WHERE k <= 6 GROUP BY ALL),
longer AS (SELECT * FROM context UNION ALL SELECT b.territory_id, b.category, b.origin, m.month, level + move FROM cb b JOIN cm m ON m.category = b.category AND m.origin = b.origin WHERE m.month < DATE '1997-01-01')
"""


def residual_sql(name: str) -> str:
    return f"""
, j AS (SELECT *, CAST(row_number() OVER (PARTITION BY territory_id, category, origin ORDER BY month DESC) - 1 AS DOUBLE) AS j FROM {name}),
fit AS (SELECT territory_id, category, origin, avg(CASE WHEN j < 3 THEN z END) AS level, coalesce(regr_slope(z, -j), 0) AS drift FROM j GROUP BY ALL)
SELECT q.territory_id, q.category, q.origin, h, round(coalesce(exp(level + drift * h + s), o.last_y), 2) AS y_pred FROM (SELECT * FROM asked WHERE origin <= DATE '2000-10-01') q
LEFT JOIN profile p ON p.territory_id = q.territory_id AND p.category = q.category AND p.origin = q.origin AND p.moy = month(q.target)
LEFT JOIN fit f ON f.territory_id = q.territory_id AND f.category = q.category AND f.origin = q.origin
LEFT JOIN lagged o ON o.territory_id = q.territory_id AND o.category = q.category AND o.month = q.origin"""


@register(query(residual_sql("context"), *LATE))
def residual_model_forecast(spark, sf):
    return residual_models(spark, sf, False)


@register(query(residual_sql("longer"), *LATE, BACKCAST))
def extended_context_forecast(spark, sf):
    return residual_models(spark, sf, True)


# Intervals and the national check

YEAR = "2000-07-01"
QUANTILES = """
qs AS (SELECT category, h, quantile_cont(ln(y_true / y_pred), [0.05, 0.1, 0.9, 0.95]) AS q FROM core WHERE model = 'snaive_growth' AND y_true > 0 AND y_pred > 0 GROUP BY ALL),
qh AS (SELECT c.category, hh.h, (SELECT max(q.h) FROM qs q WHERE q.category = c.category AND q.h <= hh.h) AS a, (SELECT min(q.h) FROM qs q WHERE q.category = c.category AND q.h >= hh.h) AS b
  FROM (SELECT DISTINCT category FROM qs) c CROSS JOIN (SELECT CAST(unnest(range(1, 13)) AS INT) AS h) hh),
qi AS (SELECT n.category, n.h, [CASE WHEN a IS NULL THEN y.q[i] WHEN b IS NULL OR a = b THEN x.q[i] ELSE x.q[i] + (y.q[i] - x.q[i]) * (n.h - a) / (b - a) END for i in [1, 2, 3, 4]] AS q
  FROM qh n LEFT JOIN qs x ON x.category = n.category AND x.h = n.a LEFT JOIN qs y ON y.category = n.category AND y.h = n.b)
"""


@register(query("SELECT category, h, round(q[1], 6) AS lo90, round(q[2], 6) AS lo80, round(q[3], 6) AS hi80, round(q[4], 6) AS hi90 FROM qi", RECORDS, QUANTILES))
def interval_quantiles(spark, sf):
    """Quantiles of log errors for every horizon of a year, linear between the tried ones."""
    return rounded(forecast.interval_quantiles(records(spark, sf, ("snaive_growth",))), 6, "lo90", "lo80", "hi80", "hi90")


def year_ahead(spark, sf) -> DataFrame:
    d = dense(spark, sf)
    asked = forecast.targets(d, YEAR, LAST, tuple(range(1, 13))).where(F.col("origin") == YEAR)
    return forecast.seasonal_growth(d, asked, more_than=LARGE)


AHEAD = """
ahead AS (SELECT d.territory_id, d.category, CAST(hh.h AS INT) AS h, CAST(DATE '2000-07-01' + to_months(CAST(hh.h AS INT)) AS DATE) AS target, d.y * f.g_own AS y_pred
  FROM (SELECT unnest(range(1, 13)) AS h) hh JOIN dense d ON d.month = DATE '1999-07-01' + to_months(CAST(hh.h AS INT))
  JOIN factors f ON f.territory_id = d.territory_id AND f.category = d.category AND f.month = DATE '2000-07-01')
"""


@register(query("SELECT a.territory_id, a.category, a.h, " + ", ".join(f"round(y_pred * exp(q[{i}]), 2) AS {n}" for i, n in enumerate(("lo90", "lo80", "hi80", "hi90"), 1)) + ", round(y_pred, 2) AS y_pred FROM ahead a LEFT JOIN qi ON qi.category = a.category AND qi.h = a.h", RECORDS, QUANTILES, AHEAD))
def forecast_intervals(spark, sf):
    q = forecast.interval_quantiles(records(spark, sf, ("snaive_growth",)))
    out = forecast.with_intervals(year_ahead(spark, sf), q)
    return rounded(out.select(*SERIES, "h", "lo90", "lo80", "hi80", "hi90", "y_pred"), 2, "lo90", "lo80", "hi80", "hi90", "y_pred")


CHECK = AHEAD + """,
heads AS (SELECT c_nationkey AS territory_id, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY ALL),
seen AS (SELECT category, month, sum(y * w) AS v FROM dense JOIN heads USING (territory_id) WHERE complete GROUP BY ALL),
made AS (SELECT a.category, a.target, sum(y_pred * w) AS p FROM ahead a JOIN (SELECT DISTINCT territory_id, category FROM dense WHERE complete) s ON s.territory_id = a.territory_id AND s.category = a.category JOIN heads ON heads.territory_id = a.territory_id GROUP BY ALL),
country AS (SELECT category, month, y / y12 - 1 AS g FROM total_lag),
chk AS (SELECT m.category, m.target, s1.v / s2.v - 1 AS panel_before, c1.g AS country_before, p / s1.v - 1 AS panel_forecast, c0.g AS country FROM made m
  LEFT JOIN seen s1 ON s1.category = m.category AND s1.month = m.target - to_months(12) LEFT JOIN seen s2 ON s2.category = m.category AND s2.month = m.target - to_months(24)
  LEFT JOIN country c1 ON c1.category = m.category AND c1.month = m.target - to_months(12) LEFT JOIN country c0 ON c0.category = m.category AND c0.month = m.target)
"""


def checked(spark, sf) -> DataFrame:
    heads = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("territory_id")).agg(F.count("*").cast("double").alias("w"))
    return forecast.national_check(dense(spark, sf), year_ahead(spark, sf), heads, YEAR)


@register(query("SELECT category, target, round(panel_before, 6) AS panel_before, round(country_before, 6) AS country_before, round(panel_forecast, 6) AS panel_forecast, round(country, 6) AS country FROM chk", CHECK))
def national_check(spark, sf):
    return rounded(checked(spark, sf), 6, "panel_before", "country_before", "panel_forecast", "country")


@register(query("""SELECT category, round(100 * avg(panel_before), 4) AS panel_before, round(100 * avg(country_before), 4) AS country_before, round(100 * avg(panel_forecast), 4) AS panel_forecast, round(100 * avg(country), 4) AS country,
round(100 * avg(panel_before - country_before), 4) AS gap_before, round(100 * avg(panel_forecast - country), 4) AS error, round(100 * avg(abs(panel_forecast - country)), 4) AS mae,
round(100 * avg(panel_before - country), 4) AS still_error, round(100 * avg(abs(panel_before - country)), 4) AS still_mae FROM chk GROUP BY ALL""", CHECK))
def national_summary(spark, sf):
    out = forecast.check_summary(checked(spark, sf))
    return rounded(out, 4, *out.columns[1:])


@register(query("""
, j AS (SELECT category, year(month) AS yr, y / y1 AS r FROM (SELECT *, lag(y) OVER (PARTITION BY category ORDER BY month) AS y1 FROM total) WHERE month(month) = 1),
b AS (SELECT category, max(r) FILTER (yr = 2001) AS ratio, median(r) FILTER (yr BETWEEN 1996 AND 2000) AS usual FROM j GROUP BY ALL)
SELECT category, round(ratio, 6) AS ratio, round(usual, 6) AS usual, coalesce(abs(ratio / usual - 1) > 0.1, false) AS broken FROM b"""))
def series_breaks(spark, sf):
    return rounded(forecast.series_breaks(forecast.national(dense(spark, sf)), 2001, (1996, 2000)), 6, "ratio", "usual")


# Tables of results


@register(query(f"SELECT model, h, {SHOWN} FROM (SELECT model, h, {MEASURES} FROM core WHERE target BETWEEN DATE '2001-01-01' AND DATE '2001-06-01' GROUP BY ALL)", RECORDS))
def metrics_second_half(spark, sf):
    """Accuracy on the targets of half a year."""
    rows = records(spark, sf).where(F.col("target").between("2001-01-01", "2001-06-01"))
    return rounded(evaluate.summary(rows, ["model", "h"]), 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


@register(query("""
, e AS (SELECT model, h, avg(abs(y_true - y_pred)) AS mae FROM core GROUP BY ALL)
SELECT model, """ + ", ".join(f"round(max(mae) FILTER (h = {h}), 2) AS mae_{h}" for h in (1, 3, 6, 12)) + ", row_number() OVER (ORDER BY round(max(mae) FILTER (h = 1), 2), model) AS place FROM e GROUP BY model", RECORDS))
def leaderboard(spark, sf):
    """MAE by model, a column for each horizon, best first."""
    rows = evaluate.core(records(spark, sf)).withColumn("ae", F.abs(F.col("y_true") - F.col("y_pred")))
    wide = rows.groupBy("model").pivot("h", [1, 3, 6, 12]).agg(F.avg("ae"))
    wide = wide.select("model", *[F.round(F.col(str(h)), 2).alias(f"mae_{h}") for h in (1, 3, 6, 12)])
    return wide.withColumn("place", F.row_number().over(Window.orderBy("mae_1", "model"))).orderBy("place")  # a row for each model


@register(query("""
, e AS (SELECT CASE WHEN target >= DATE '2001-01-01' THEN 'late' ELSE 'early' END AS mode, model, h, avg(abs(y_true - y_pred)) AS mae FROM core GROUP BY ALL),
g AS (SELECT *, 100 * (mae / min(mae) OVER (PARTITION BY mode, h) - 1) AS gap FROM e)
SELECT model, round(max(gap), 4) AS max_gap FROM g GROUP BY ALL""", RECORDS))
def largest_gap(spark, sf):
    """How far each model is at most behind the best of its horizon and half, in percent."""
    mode = F.when(F.col("target") >= "2001-01-01", "late").otherwise("early")
    each = evaluate.core(records(spark, sf)).groupBy(mode.alias("mode"), "model", "h").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return evaluate.largest_gap(each, ["mode", "h"])


@register(query("""
, pairs AS (SELECT a.h, abs(a.y_pred / b.y_pred - 1) AS rel FROM records a JOIN records b ON a.territory_id = b.territory_id AND a.category = b.category AND a.origin = b.origin AND a.h = b.h WHERE a.model = 'snaive_growth' AND b.model = 'snaive' AND b.y_pred <> 0)
SELECT h, count(rel) AS n, round(max(rel), 6) AS worst, round(median(rel), 6) AS middle FROM pairs GROUP BY ALL""", RECORDS))
def reproducibility(spark, sf):
    """Relative differences between two runs' forecasts of the same points."""
    r = records(spark, sf, ("snaive", "snaive_growth"))
    return rounded(evaluate.reproducibility(r.where("model = 'snaive_growth'"), r.where("model = 'snaive'")), 6, "worst", "middle")


SHOCKED = """
marks AS (SELECT territory_id, category, month, coalesce(abs(ln(y / last12)) > 0.5, false) AS shock FROM (SELECT *, avg(y) OVER (PARTITION BY territory_id, category ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS last12 FROM dense) WHERE y > 0 AND last12 > 0)
"""


@register(query("""
SELECT model, h, shock, round(avg(abs(y_true - y_pred)), 4) AS mae, round(100 * avg(abs(y_true - y_pred) / nullif(y_true, 0)), 4) AS mape, count(*) AS n
FROM core c JOIN marks m ON m.territory_id = c.territory_id AND m.category = c.category AND m.month = c.target GROUP BY ALL""", RECORDS, SHOCKED))
def shock_month_accuracy(spark, sf):
    """Accuracy in months with and without a shock. Marks come from the data, so a model is judged where it may have failed."""
    w = Window.partitionBy(*SERIES).orderBy("month").rowsBetween(-12, -1)
    last = F.avg("y").over(w)
    d = dense(spark, sf).withColumn("_l", last).where("y > 0 and _l > 0")
    marks = d.select(*SERIES, F.col("month").alias("target"), F.coalesce(F.abs(F.log(F.col("y") / F.col("_l"))) > 0.5, F.lit(False)).alias("shock"))
    return rounded(evaluate.by_shock(records(spark, sf), marks), 4, "mae", "mape")


@register("""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), r(retrain) AS (VALUES (DATE '1996-01-01'), (DATE '1997-03-01'), (DATE '1999-11-01'), (DATE '2001-01-01'))
SELECT month, (SELECT max(retrain) FROM r WHERE retrain <= month) AS retrain FROM m""")
def last_retrain(spark, sf):
    """The last training date at or before each month."""
    months = table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).distinct()
    return evaluate.last_before(months, ["1996-01-01", "1997-03-01", "1999-11-01", "2001-01-01"], "month", "retrain")
