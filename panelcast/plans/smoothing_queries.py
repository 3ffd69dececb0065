"""Queries of the smoothing and Theta forecasts, of deseasonalised logs and of the levels themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.operators import forecast, smoothing
from panelcast.plans.forecast_queries import LATE, ORIGINS, PANEL_START, shown
from panelcast.plans.registry import LARGE, dense, register
from panelcast.plans.sql import query
from panelcast.sources.tables import LAST
from pyspark.sql import functions as F

SOME = ORIGINS[:4]
KEY = "territory_id, category, origin"
KEYED = "{a}.territory_id = {b}.territory_id AND {a}.category = {b}.category AND {a}.origin = {b}.origin"


def same(a: str, b: str) -> str:
    return KEYED.format(a=a, b=b)


RAW = """
rw AS (SELECT d.territory_id, d.category, o.month AS origin, d.month, d.y AS z, row_number() OVER (PARTITION BY d.territory_id, d.category, o.month ORDER BY d.month) AS pos
  FROM dense d JOIN (SELECT month FROM calendar WHERE month >= DATE '2000-07-01' AND month <= DATE '2000-10-01') o ON d.month <= o.month),
rb AS (SELECT *, max(CASE WHEN z IS NOT NULL THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS a, min(CASE WHEN z IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM rw WINDOW w AS (PARTITION BY territory_id, category, origin ORDER BY month)),
rc AS (SELECT n.territory_id, n.category, n.origin, n.month, CASE WHEN n.z IS NOT NULL THEN n.z WHEN n.b IS NULL THEN p.z ELSE p.z + (q.z - p.z) * (n.pos - n.a) / (n.b - n.a) END AS z
  FROM rb n JOIN rw p ON p.territory_id = n.territory_id AND p.category = n.category AND p.origin = n.origin AND p.pos = n.a LEFT JOIN rw q ON q.territory_id = n.territory_id AND q.category = n.category AND q.origin = n.origin AND q.pos = n.b),
rr AS (SELECT *, month(month) AS moy, CASE WHEN count(z) OVER f = 12 AND count(z) OVER g = 12 THEN z / ((avg(z) OVER f + avg(z) OVER g) / 2) END AS ratio, count(z) OVER (PARTITION BY territory_id, category, origin) AS n, min(z) OVER (PARTITION BY territory_id, category, origin) AS least
  FROM rc WINDOW f AS (PARTITION BY territory_id, category, origin ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING), g AS (PARTITION BY territory_id, category, origin ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
rm AS (SELECT territory_id, category, origin, moy, avg(ratio) AS m, any_value(n) AS n, any_value(least) AS least FROM rr GROUP BY ALL),
ri AS (SELECT territory_id, category, origin, moy, CASE WHEN n >= 24 AND least > 0 AND count(m) OVER w = count(*) OVER w THEN m * 12 / sum(m) OVER w ELSE 1 END AS index FROM rm WINDOW w AS (PARTITION BY territory_id, category, origin)),
levels AS (SELECT rc.territory_id, rc.category, rc.origin, rc.month, z / index AS z FROM rc JOIN ri ON ri.territory_id = rc.territory_id AND ri.category = rc.category AND ri.origin = rc.origin AND ri.moy = month(rc.month))
"""


def simple_sql(source: str, name: str) -> str:
    """CTE name: level and sse of the best alpha over source (key, k from 0, x, n)."""
    return f"""
{name}_run AS (
  SELECT {KEY}, a.i / 20.0 AS alpha, k, n, x AS l, 0::DOUBLE AS e FROM {source} CROSS JOIN (SELECT unnest(range(1, 21))::DOUBLE AS i) a WHERE k = 0
  UNION ALL
  SELECT r.territory_id, r.category, r.origin, alpha, v.k, r.n, l + alpha * (x - l), e + (x - l) * (x - l) FROM {name}_run r JOIN {source} v ON {same('v', 'r')} AND v.k = r.k + 1),
{name} AS (SELECT {KEY}, n, l AS level, e AS sse FROM {name}_run WHERE k = n - 1 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY e, alpha) = 1)"""


TREND_RUN = f"""
tg AS (SELECT row_number() OVER (ORDER BY a, b, phi) - 1 AS i, a, a * b AS ab, phi FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS a) CROSS JOIN (SELECT unnest([0.1, 0.3])::DOUBLE AS b) CROSS JOIN (SELECT unnest([0.8, 0.9, 0.98, 1.0])::DOUBLE AS phi)),
ts AS (SELECT {KEY}, n, max(CASE WHEN k = 0 THEN x END) AS x0, (max(CASE WHEN k = least(n, 12) - 1 THEN x END) - max(CASE WHEN k = 0 THEN x END)) / (least(n, 12) - 1) AS t FROM numbered GROUP BY territory_id, category, origin, n),
tr_run AS (
  SELECT {KEY}, i, a, ab, phi, 0 AS k, n, x0 AS l, t, 0::DOUBLE AS e FROM ts CROSS JOIN tg
  UNION ALL
  SELECT r.territory_id, r.category, r.origin, i, a, ab, phi, v.k, r.n, l + phi * t + a * (x - (l + phi * t)), phi * t + ab * (x - (l + phi * t)), e + (x - (l + phi * t)) * (x - (l + phi * t)) FROM tr_run r JOIN numbered v ON {same('v', 'r')} AND v.k = r.k + 1),
tr AS (SELECT {KEY}, l AS level, t AS drift, phi, e AS sse FROM tr_run WHERE k = n - 1 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY e, i) = 1)"""

NUMBERED = """
counted AS (SELECT territory_id, category, origin, z AS x, (row_number() OVER w - 1)::INT AS k, (count(*) OVER (PARTITION BY territory_id, category, origin))::INT AS n FROM {source} WHERE z IS NOT NULL WINDOW w AS (PARTITION BY territory_id, category, origin ORDER BY month)),
numbered AS (SELECT * FROM counted WHERE n >= 3)"""

MODELS = {
    "ses": simple_sql("numbered", "sm") + ", fitted AS (SELECT territory_id, category, origin, level, 0::DOUBLE AS drift, 1::DOUBLE AS phi FROM sm)",
    "theta": f"""
tl AS (SELECT {KEY}, n, regr_slope(x, k) AS b, regr_intercept(x, k) AS a FROM numbered GROUP BY ALL),
second AS (SELECT v.territory_id, v.category, v.origin, v.k, v.n, 2 * x - (a + b * k) AS x FROM numbered v JOIN tl ON {same('v', 'tl')}),
{simple_sql('second', 'sm')}, fitted AS (SELECT sm.territory_id, sm.category, sm.origin, 0.5 * (a + b * (tl.n - 1)) + 0.5 * level AS level, 0.5 * b AS drift, 1::DOUBLE AS phi FROM sm JOIN tl ON {same('sm', 'tl')})""",
    "ets": simple_sql("numbered", "sm") + "," + TREND_RUN + f""",
aic AS (SELECT sm.territory_id, sm.category, sm.origin, sm.level AS sl, tr.level AS tl, drift, phi, (n - 1)::DOUBLE AS m, sm.sse AS s1, tr.sse AS s2 FROM sm JOIN tr ON {same('sm', 'tr')}),
aicc AS (SELECT *, CASE WHEN m > 3 THEN m * ln(greatest(s1, 1e-12) / m) + 4 + 12 / (m - 3) ELSE 'inf'::DOUBLE END <= CASE WHEN m > 6 THEN m * ln(greatest(s2, 1e-12) / m) + 10 + 60 / (m - 6) ELSE 'inf'::DOUBLE END AS simple FROM aic),
fitted AS (SELECT {KEY}, CASE WHEN simple THEN sl ELSE tl END AS level, CASE WHEN simple THEN 0 ELSE drift END AS drift, CASE WHEN simple THEN 1 ELSE phi END AS phi FROM aicc)""",
}

MOVED = "level + CASE WHEN phi = 1 THEN h * drift ELSE drift * phi * (1 - pow(phi, h)) / (1 - phi) END"


def smoothing_sql(model: str, raw: bool) -> str:
    select = f"""
SELECT q.territory_id, q.category, q.origin, h, round(coalesce({f"({MOVED}) * coalesce(s.index, 1)" if raw else f"exp({MOVED} + s.s)"}, o.last_y), 2) AS y_pred FROM (SELECT * FROM asked WHERE origin <= DATE '2000-10-01') q
LEFT JOIN {'ri' if raw else 'profile'} s ON s.territory_id = q.territory_id AND s.category = q.category AND s.origin = q.origin AND s.moy = month(q.target)
LEFT JOIN fitted f ON f.territory_id = q.territory_id AND f.category = q.category AND f.origin = q.origin
LEFT JOIN lagged o ON o.territory_id = q.territory_id AND o.category = q.category AND o.month = q.origin"""
    parts = ([RAW] if raw else [*LATE]) + [NUMBERED.format(source="levels" if raw else "context"), MODELS[model]]
    return query(select, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def of_residuals(spark, sf, model) -> DataFrame:
    d = dense(spark, sf).where(F.col("month") >= PANEL_START)
    profile = forecast.seasonal_profiles(d, SOME, more_than=LARGE)
    asked = forecast.targets(d, ORIGINS[0], LAST).where(F.col("origin") <= SOME[-1])
    return shown(forecast.residual_forecast(d, asked, forecast.deseasonalised(d, profile, SOME), profile, model))


def of_levels(spark, sf, model) -> DataFrame:
    d = dense(spark, sf)
    asked = forecast.targets(d, ORIGINS[0], LAST).where(F.col("origin") <= SOME[-1])
    return shown(smoothing.raw_forecast(d, asked, SOME, model))


@register(smoothing_sql("ses", False))
def ses_forecast(spark, sf):
    """Simple smoothing of the deseasonalised logs."""
    return of_residuals(spark, sf, smoothing.ses)


@register(smoothing_sql("theta", False))
def theta_forecast(spark, sf):
    """Theta model of the deseasonalised logs."""
    return of_residuals(spark, sf, smoothing.theta)


@register(smoothing_sql("ets", False))
def ets_forecast(spark, sf):
    """Simple or damped-trend smoothing of the deseasonalised logs, by information criterion."""
    return of_residuals(spark, sf, smoothing.ets)


@register(smoothing_sql("theta", True))
def theta_raw_forecast(spark, sf):
    """Theta model of the levels, with their own seasonal indices."""
    return of_levels(spark, sf, smoothing.theta)


@register(smoothing_sql("ets", True))
def ets_raw_forecast(spark, sf):
    """Smoothing of the levels, with their own seasonal indices."""
    return of_levels(spark, sf, smoothing.ets)
