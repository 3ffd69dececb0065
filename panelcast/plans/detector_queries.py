"""Queries of residual models, injected shocks, alarms against events, and early warning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast import config
from panelcast.operators import detect, evaluate, forecast, learn, panel, shocks
from panelcast.operators.territory import weather_features
from panelcast.plans import fixtures as fx
from panelcast.plans.feature_queries import regions
from panelcast.plans.queries import MULTI, PANEL_SCORE
from panelcast.plans.registry import LAG_START, LARGE, SERIES, dense, register, residual, rounded, scored
from panelcast.plans.sql import RESIDUALS, query
from panelcast.sources.sinks import kept
from panelcast.sources.tables import FIRST, LAST, spending, table

SETTINGS = config.load("changepoint")
SEED = SETTINGS["seed"]

# Residuals


@register(query("""
, one AS (SELECT d.territory_id, d.region_code, d.category, d.month, CASE WHEN d.y > 0 AND d.y12 * f.g_own > 0 THEN ln(d.y) - ln(d.y12 * f.g_own) END AS e FROM lagged d JOIN factors f ON f.territory_id = d.territory_id AND f.category = d.category AND f.month = d.month - to_months(1) WHERE d.month >= DATE '1996-02-01')
SELECT territory_id, category, month, round(e, 6) + 0.0 AS e FROM one"""))
def one_step_residuals(spark, sf):
    """Log errors of the one-step seasonal forecast with growth, at every month that has a year before."""
    d = dense(spark, sf)
    made = forecast.with_truth(d, forecast.seasonal_growth(d, forecast.targets(d, LAG_START, LAST, (1,)), more_than=LARGE))
    return rounded(detect.residuals(made).select(*SERIES, "month", "e"), 6, "e")


@register(query("""
, m AS (SELECT *, median(e) OVER (PARTITION BY territory_id, category) AS m FROM e0), d AS (SELECT *, 1.4826 * median(abs(e - m)) OVER (PARTITION BY territory_id, category) AS d FROM m)
SELECT territory_id, category, month, round((e - m) / CASE WHEN d > 1e-9 THEN d END, 6) + 0.0 AS score FROM d""", RESIDUALS))
def robust_scores(spark, sf):
    return scored(detect.robust(residual(spark, sf), "e").withColumn("score", F.col("z")))


# Shocks put into the panel

MONTHS = (39, 76)


def u_sql(what: str, *keys: str) -> str:
    joined = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', '{what}', {joined})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def drawn_sql(*keys: str) -> str:
    least, most = SETTINGS["shock_size"]
    return f"""CAST({MONTHS[0]} + floor({u_sql('t', *keys)} * {MONTHS[1] - MONTHS[0] + 1}) AS INT) AS t, ['step', 'dip', 'ramp', 'spike'][CAST(floor({u_sql('type', *keys)} * 4) AS INT) + 1] AS type,
  ({least} + {most - least!r} * {u_sql('size', *keys)}) * CASE WHEN {u_sql('sign', *keys)} < 0.3 THEN 1 ELSE -1 END AS size, CAST(1 + floor({u_sql('length', *keys)} * 2) AS INT) AS length"""


def injected_sql(name: str, keys: str = "territory_id, category") -> str:
    on = " AND ".join(f"s.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_path AS (SELECT d.*, s.type, s.size, s.length, date_diff('month', DATE '{FIRST}', d.month) - s.t AS since FROM dense d LEFT JOIN {name} s ON {on}),
{name}_dense AS (SELECT * EXCLUDE (type, size, length, since) REPLACE (y * CASE WHEN since >= 0 AND type = 'step' THEN 1 + size WHEN since >= 0 AND type = 'ramp' THEN 1 + size * least(since + 1, 3) / 3 WHEN since >= 0 AND type = 'dip' AND since < length THEN 1 + size WHEN since = 0 AND type = 'spike' THEN 1 + size ELSE 1 END AS y) FROM {name}_path)
"""


DRAWN = f"local_shocks AS (SELECT *, {drawn_sql('territory_id', 'category')} FROM (SELECT DISTINCT territory_id, category FROM dense) WHERE {u_sql('chosen', 'territory_id', 'category')} < 0.5)"
CATEGORIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONAL = f"""region_shocks AS (SELECT *, {drawn_sql('region_code')} FROM (SELECT region_code, {fx.listed(CATEGORIES)}[CAST(floor({u_sql('category', 'region_code')} * 5) AS INT) + 1] AS category FROM (SELECT DISTINCT region_code FROM dense) WHERE {u_sql('chosen', 'region_code')} < {2 * SETTINGS['regional_share']})),
wide_shocks AS (SELECT d.territory_id, d.category, t, type, size, length FROM (SELECT DISTINCT territory_id, region_code, category FROM dense) d JOIN region_shocks r ON r.region_code = d.region_code AND r.category = d.category)"""


def local_shocks(spark, sf) -> DataFrame:
    return shocks.draw_shocks(dense(spark, sf), tuple(SERIES), *MONTHS, 0.5, SEED, *SETTINGS["shock_size"])


@register(query("SELECT territory_id, category, t, type, round(size, 6) AS size, length FROM local_shocks", DRAWN))
def drawn_shocks(spark, sf):
    return rounded(local_shocks(spark, sf), 6, "size")


@register(query("SELECT territory_id, category, month, round(y, 2) AS y FROM local_shocks_dense", DRAWN, injected_sql("local_shocks")))
def injected_shocks(spark, sf):
    out = shocks.inject(dense(spark, sf), local_shocks(spark, sf), tuple(SERIES), FIRST)
    return rounded(out.select(*SERIES, "month", "y"), 2, "y")


@register(query("SELECT territory_id, category, month, round(y, 2) AS y FROM wide_shocks_dense", REGIONAL, injected_sql("wide_shocks")))
def regional_shocks(spark, sf):
    """One shock for all territories of a region in one category."""
    d = dense(spark, sf)
    made = shocks.draw_regional(d, list(CATEGORIES), *MONTHS, 2 * SETTINGS["regional_share"], SEED, *SETTINGS["shock_size"])
    return rounded(shocks.inject(d, made, tuple(SERIES), FIRST).select(*SERIES, "month", "y"), 2, "y")


EVALUATED = DRAWN + "," + injected_sql("local_shocks") + """,
lagged2 AS (SELECT *, lag(y, 12) OVER (PARTITION BY territory_id, category ORDER BY month) AS y12 FROM local_shocks_dense),
""" + RESIDUALS.replace("FROM lagged", "FROM lagged2") + "," + PANEL_SCORE + f""",
marked AS (SELECT p.territory_id, p.category, date_diff('month', DATE '{FIRST}', p.month) AS m, score, s.t FROM p1 p LEFT JOIN local_shocks s ON s.territory_id = p.territory_id AND s.category = p.category),
limits AS (SELECT quantile_cont(score, {1 - SETTINGS['far']}) AS threshold FROM marked WHERE t IS NULL AND score IS NOT NULL),
fired AS (SELECT m.*, coalesce(score > threshold, false) AS alarm, coalesce(score > threshold AND m.m BETWEEN t - 1 AND t + 2, false) AS inside FROM marked m CROSS JOIN limits),
found AS (SELECT territory_id, category, t, min(m) FILTER (inside) AS first FROM fired WHERE t IS NOT NULL GROUP BY ALL),
measures AS (SELECT (SELECT avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END) FROM found) AS recall, (SELECT avg(greatest(0, first - t)) FROM found WHERE first IS NOT NULL) AS delay, (SELECT count(*) FROM found) AS n_shocks,
  sum(inside::INT) / greatest(sum(alarm::INT), 1) AS precision, 100 * avg(CASE WHEN t IS NULL THEN alarm::INT END) AS false_alarms FROM fired)
"""


def evaluated(spark, sf, drawn: DataFrame, parts) -> DataFrame:
    """Detectors on the panel with the drawn shocks; thresholds from the series without one."""
    lag = F.lag("y", 12).over(panel.over_time())
    rows = shocks.inject(dense(spark, sf), drawn, tuple(SERIES), FIRST).withColumn("e", F.when((F.col("y") > 0) & (lag > 0), F.log("y") - F.log(lag))).where(F.col("month") >= LAG_START)
    rows = kept(rows.select("territory_id", "region_code", "category", "month", "e"))
    scores = detect.union([x.select(F.lit(n).alias("detector"), *SERIES, "month", "score") for n, x in parts(rows).items()])
    marked = scores.join(drawn.select(*SERIES, F.lit(False).alias("clean")), SERIES, "left").withColumn("clean", F.coalesce("clean", F.lit(True)))
    marked = kept(marked.withColumn("m", F.months_between("month", F.lit(FIRST).cast("date")).cast("int")))
    return shocks.evaluate(marked, drawn.select(*SERIES, "t"), shocks.false_alarm_threshold(marked, SETTINGS["far"]))


@register(query(", final AS (SELECT * FROM measures) SELECT 'panel' AS detector, round(recall, 6) AS recall, round(delay, 6) AS delay, n_shocks, round(precision, 6) AS precision, round(false_alarms, 6) AS false_alarms, round(2 * precision * recall / greatest(precision + recall, 1e-9), 6) AS f1 FROM final", EVALUATED))
def shock_evaluation(spark, sf):
    """Recall, delay, precision and false alarms of the panel detector on local shocks."""
    out = evaluated(spark, sf, local_shocks(spark, sf), lambda rows: {"panel": detect.panel_score(rows)})
    return rounded(out, 6, "recall", "delay", "precision", "false_alarms", "f1")


# Alarms against events

SINCE = "1998-01-01"
BIG_ORDERS = "sev AS (SELECT c_nationkey AS territory_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(CASE WHEN max(o_totalprice) >= 450000 THEN 3 WHEN max(o_totalprice) >= 400000 THEN 2 ELSE 1 END AS INT) AS severity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def severity(spark, sf) -> DataFrame:
    """territory_id, month, severity: large orders stand for incidents."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    top = F.max("o_totalprice")
    return o.groupBy(F.col("c_nationkey").alias("territory_id"), F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(F.when(top >= 450000, 3).when(top >= 400000, 2).otherwise(1).alias("severity"))


HYBRID = BIG_ORDERS + """,
raw AS (SELECT 'panel' AS detector, territory_id, category, month, score FROM p1 UNION ALL SELECT 'multivariate', territory_id, category, month, score FROM m1),
boosted AS (SELECT 'panel_news_' || g AS detector, p.territory_id, p.category, p.month, score * (1 + g * CASE WHEN severity >= 2 THEN 1 ELSE 0 END) AS score FROM p1 p CROSS JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(g) LEFT JOIN sev s ON s.territory_id = p.territory_id AND s.month = p.month),
scores AS (SELECT * FROM raw UNION ALL SELECT * FROM boosted)
"""


def hybrid(spark, sf, only_panel: bool = False) -> DataFrame:
    """detector, territory_id, category, month, score: two detectors, and the first raised by incidents."""
    rows = residual(spark, sf)
    p = kept(detect.panel_score(rows).select(*SERIES, "month", "score"))
    named = lambda df, n: df.select(F.lit(n).alias("detector"), *SERIES, "month", "score")
    joined = p.join(severity(spark, sf), ["territory_id", "month"], "left")
    out = [named(p, "panel"), *[named(joined.withColumn("score", detect.with_news(F.col("score"), F.col("severity"), g)), f"panel_news_{g}") for g in (0.25, 0.5, 1.0)]]
    return detect.union(out if only_panel else [*out, named(detect.multivariate(detect.remove_common(rows)), "multivariate")])


@register(query("SELECT detector, territory_id, category, month, round(score, 6) AS score FROM scores WHERE detector <> 'multivariate'", RESIDUALS, PANEL_SCORE, MULTI, HYBRID))
def hybrid_scores(spark, sf):
    return rounded(hybrid(spark, sf, True), 6, "score")


@register(query("""
SELECT p.territory_id, p.category, p.month, round(score * (1 + 0.3 * greatest(coalesce(surge, 0), 0)), 6) AS score FROM p1 p LEFT JOIN (
  SELECT territory_id, month, CASE WHEN count(*) OVER w >= 3 THEN ln(1 + n) - ln(1 + avg(n) OVER w) END AS surge FROM (SELECT territory_id, month, sum(n_orders) AS n FROM panel GROUP BY ALL) WINDOW w AS (PARTITION BY territory_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) s
ON s.territory_id = p.territory_id AND s.month = p.month""", RESIDUALS, PANEL_SCORE))
def surge_adjusted_scores(spark, sf):
    n = spending(spark, sf).groupBy("territory_id", "month").agg(F.sum("n_orders").alias("n"))
    n = n.select("territory_id", "month", panel.surge("n", ("territory_id",)).alias("surge"))
    p = detect.panel_score(residual(spark, sf)).join(n, ["territory_id", "month"], "left")
    return scored(p.withColumn("score", detect.with_surge(F.col("score"), F.col("surge"))))


BUDGETS = f"""
late AS (SELECT * FROM scores WHERE month >= DATE '{SINCE}'),
ls AS (SELECT detector, quantile_cont(score, {1 - SETTINGS['far']}) AS lim FROM late GROUP BY ALL),
a1 AS (SELECT l.detector, territory_id, month, bool_or(coalesce(score > lim, false)) AS alarm FROM late l JOIN ls ON ls.detector = l.detector GROUP BY ALL),
share AS (SELECT avg(alarm::INT) AS s FROM a1 WHERE detector = 'panel'),
best AS (SELECT detector, territory_id, month, max(score) AS score FROM late GROUP BY ALL),
lm AS (SELECT detector, l[CAST(floor(p) AS INT) + 1] + (l[CAST(ceil(p) AS INT) + 1] - l[CAST(floor(p) AS INT) + 1]) * (p - floor(p)) AS lim FROM (SELECT detector, list_sort(list(score) FILTER (score IS NOT NULL)) AS l, (1 - max(s)) * (count(score) - 1) AS p FROM best CROSS JOIN share GROUP BY ALL)),
lmm AS (SELECT detector, month, l[CAST(floor(p) AS INT) + 1] + (l[CAST(ceil(p) AS INT) + 1] - l[CAST(floor(p) AS INT) + 1]) * (p - floor(p)) AS lim FROM (SELECT detector, month, list_sort(list(score) FILTER (score IS NOT NULL)) AS l, (1 - max(s)) * (count(score) - 1) AS p FROM best CROSS JOIN share GROUP BY ALL)),
budgeted AS (SELECT 'series' AS budget, * FROM a1
  UNION ALL SELECT 'mo', b.detector, territory_id, month, coalesce(score > lim, false) FROM best b JOIN lm ON lm.detector = b.detector
  UNION ALL SELECT 'mo_month', b.detector, territory_id, b.month, coalesce(score > lim, false) FROM best b JOIN lmm ON lmm.detector = b.detector AND lmm.month = b.month)
"""
EVENTS = f"cases AS (SELECT territory_id, month FROM sev WHERE severity >= 3 AND month BETWEEN DATE '{SINCE}' AND DATE '{LAST}')"


def alarms(spark, sf) -> DataFrame:
    return kept(evaluate.budget_alarms(kept(hybrid(spark, sf)), SINCE, SETTINGS["far"]))


def cases(spark, sf) -> DataFrame:
    return severity(spark, sf).where((F.col("severity") >= 3) & F.col("month").between(SINCE, LAST)).select("territory_id", "month")


ALARMED = (RESIDUALS, PANEL_SCORE, MULTI, HYBRID, BUDGETS, EVENTS)


@register(query("SELECT budget, detector, count(*) AS n, count(*) FILTER (alarm) AS alarms FROM budgeted GROUP BY ALL", *ALARMED))
def budget_alarms(spark, sf):
    return alarms(spark, sf).groupBy("budget", "detector").agg(F.count("*").alias("n"), F.count_if("alarm").alias("alarms"))


@register(query(f"""
, lags AS (SELECT unnest([-1, 0, 1, 2]) AS lag), runs AS (SELECT budget, detector, avg(alarm::INT) AS base_rate FROM budgeted GROUP BY ALL),
around AS (SELECT c.*, lag, CAST(c.month + to_months(lag) AS DATE) AS at FROM cases c CROSS JOIN lags WHERE c.month + to_months(lag) <= DATE '{LAST}'),
hit AS (SELECT r.budget, r.detector, a.territory_id, a.month, lag, coalesce(b.alarm, false)::INT AS hit FROM around a CROSS JOIN runs r LEFT JOIN budgeted b ON b.budget = r.budget AND b.detector = r.detector AND b.territory_id = a.territory_id AND b.month = a.at),
win AS (SELECT budget, detector, avg(h) AS hit_window FROM (SELECT budget, detector, territory_id, month, max(hit) AS h FROM hit GROUP BY ALL) GROUP BY ALL),
each AS (SELECT budget, detector, avg(hit) FILTER (lag = -1) AS b1, avg(hit) FILTER (lag = 0) AS h0, avg(hit) FILTER (lag = 1) AS h1, avg(hit) FILTER (lag = 2) AS h2 FROM hit GROUP BY ALL)
SELECT r.budget, r.detector, round(base_rate, 6) AS base_rate, round(b1, 6) AS hit_1_before, round(h0, 6) AS hit_0, round(h1, 6) AS hit_1, round(h2, 6) AS hit_2, round(hit_window, 6) AS hit_window, round(h0 / nullif(base_rate, 0), 6) AS lift
FROM runs r JOIN each e ON e.budget = r.budget AND e.detector = r.detector JOIN win w ON w.budget = r.budget AND w.detector = r.detector""", *ALARMED))
def event_hit_rates(spark, sf):
    """Hit rates of every detector around events, at three equal budgets."""
    out = evaluate.hit_rates(alarms(spark, sf), cases(spark, sf), LAST)
    return rounded(out, 6, "base_rate", "hit_1_before", "hit_0", "hit_1", "hit_2", "hit_window", "lift")


@register(query("""
, runs AS (SELECT DISTINCT budget, detector FROM budgeted)
SELECT r.budget, r.detector, count(*) AS cases, sum(CASE WHEN EXISTS (SELECT 1 FROM budgeted b WHERE b.budget = r.budget AND b.detector = r.detector AND b.territory_id = c.territory_id AND b.alarm AND b.month IN (c.month, CAST(c.month + to_months(1) AS DATE))) THEN 1 ELSE 0 END)::BIGINT AS hits FROM cases c CROSS JOIN runs r GROUP BY ALL""", *ALARMED))
def registry_hits(spark, sf):
    """Cases with an alarm in their month or the next."""
    return evaluate.registry_hits(alarms(spark, sf), cases(spark, sf))


@register(query("SELECT h.detector, round(avg(CASE WHEN NOT h.alarm THEN 1.0 ELSE 0 END), 6) AS displaced FROM a1 h JOIN a1 p ON p.detector = 'panel' AND p.alarm AND p.territory_id = h.territory_id AND p.month = h.month WHERE h.detector <> 'panel' GROUP BY ALL", *ALARMED))
def displaced_alarms(spark, sf):
    """Alarms of the panel detector that others give up for theirs."""
    return rounded(evaluate.displaced_share(alarms(spark, sf).where("budget = 'series'"), "panel"), 6, "displaced")


EXPLAINED = f"""
lim AS (SELECT quantile_cont(score, 0.9) AS lim FROM p1 WHERE month >= DATE '{SINCE}'),
high AS (SELECT territory_id, category, month, score FROM p1 CROSS JOIN lim WHERE score > lim AND month >= DATE '{SINCE}' QUALIFY row_number() OVER (PARTITION BY territory_id, month ORDER BY score DESC, category) = 1),
explained AS (SELECT h.*, s.territory_id IS NOT NULL AS explained FROM high h LEFT JOIN sev s ON s.territory_id = h.territory_id AND s.month = h.month AND severity >= 3)
"""


def explained(spark, sf) -> DataFrame:
    p = kept(detect.panel_score(residual(spark, sf)).where(F.col("month") >= SINCE).select(*SERIES, "month", "score"))
    return evaluate.explained_alarms(p, p.agg(F.percentile("score", F.lit(0.9)).alias("limit")), severity(spark, sf).where("severity >= 3"))


@register(query("SELECT territory_id, category, month, round(score, 6) AS score, explained FROM explained", RESIDUALS, PANEL_SCORE, BIG_ORDERS, EXPLAINED))
def explained_alarms(spark, sf):
    """Each territory-month's strongest alarm, and whether a major incident falls there."""
    return rounded(explained(spark, sf), 6, "score")


@register(query(f"SELECT c.month, count(e.month) AS alarms, count(*) FILTER (explained) AS explained FROM (SELECT month FROM calendar WHERE month >= DATE '{SINCE}') c LEFT JOIN explained e ON e.month = c.month GROUP BY ALL", RESIDUALS, PANEL_SCORE, BIG_ORDERS, EXPLAINED))
def alarms_by_month(spark, sf):
    return evaluate.alarms_by_month(explained(spark, sf), SINCE, LAST)


# Early warning

WARNING = f"""
lim AS (SELECT quantile_cont(score, 0.9) AS lim FROM p1 WHERE month >= DATE '{SINCE}'),
wt AS (SELECT territory_id, month, max(CASE WHEN score > lim THEN 1.0::DOUBLE ELSE 0 END) AS alarm, max(coalesce(score, 0)) AS score FROM p1 CROSS JOIN lim WHERE month >= DATE '{SINCE}' GROUP BY ALL),
wo AS (SELECT w.*, n_regionkey AS region_code, (sum(alarm) OVER r - alarm) / greatest(count(*) OVER r - 1, 1) AS others FROM wt w JOIN nation ON n_nationkey = territory_id WINDOW r AS (PARTITION BY n_regionkey, month)),
"""


def warnings(spark, sf, nowcast: bool = False) -> DataFrame:
    p = kept(detect.panel_score(residual(spark, sf)).where(F.col("month") >= SINCE).select(*SERIES, "month", "score"))
    rows = evaluate.warning_table(p, p.agg(F.percentile("score", F.lit(0.9)).alias("limit")), regions(spark, sf), nowcast)
    weather = weather_features(fx.weather(spark, sf), 1995, 1997).select("territory_id", "month", "t2m_c_anom", "wind_ms_anom")
    access = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("territory_id")).agg(F.avg("s_acctbal").alias("market_access"))
    return rows.drop("region_code").join(weather, ["territory_id", "month"], "left").join(access, "territory_id", "left")


SHOWN_WARNING = "SELECT w.territory_id, w.month, round(w.alarm, 6) AS alarm, round(w.score, 6) AS score, round(w.others, 6) AS others, y_next, round(t2m_c_anom, 6) + 0.0 AS t2m_c_anom, round(wind_ms_anom, 6) + 0.0 AS wind_ms_anom, round(market_access, 4) AS market_access FROM {} w LEFT JOIN weather e ON e.territory_id = w.territory_id AND e.month = w.month LEFT JOIN (SELECT s_nationkey AS territory_id, avg(s_acctbal) AS market_access FROM supplier GROUP BY ALL) a ON a.territory_id = w.territory_id"


def shown_warnings(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 6, "alarm", "score", "others", "t2m_c_anom", "wind_ms_anom"), 4, "market_access")


@register(query(SHOWN_WARNING.format("wf"), RESIDUALS, PANEL_SCORE, fx.WEATHER, WARNING + "wf AS (SELECT *, lead(alarm) OVER (PARTITION BY territory_id ORDER BY month) AS y_next FROM wo)"))
def early_warning_table(spark, sf):
    """What is known in a month, and the next month's alarm."""
    return shown_warnings(warnings(spark, sf))


@register(query(SHOWN_WARNING.format("wn"), RESIDUALS, PANEL_SCORE, fx.WEATHER, WARNING + "wn AS (SELECT territory_id, month, lag(alarm) OVER t AS alarm, lag(score) OVER t AS score, lag(others) OVER t AS others, alarm AS y_next FROM wo WINDOW t AS (PARTITION BY territory_id ORDER BY month))"))
def nowcast_table(spark, sf):
    """The month's own alarm by what was known a month before, with the month's weather."""
    return shown_warnings(warnings(spark, sf, True))


@register()
def early_warning(spark, sf):
    """Average precision and lift of boosted trees on growing sets of features, in the later months."""
    inertia, weather = ["alarm", "score"], ["t2m_c_anom", "wind_ms_anom"]
    sets = {"inertia": inertia, "neighbours": [*inertia, "others"], "weather": [*inertia, "others", *weather], "all": [*inertia, "others", *weather, "market_access"]}
    made = kept(learn.early_warning(kept(warnings(spark, sf)), sets, "2000-06-01", "2000-07-01", trees=5))
    parts = [evaluate.precision_curve(made.where(F.col("features") == n), "p", "y_next").withColumn("features", F.lit(n)) for n in sets]
    return detect.union(parts)


@register()
def boosted_correction(spark, sf):
    """Seasonal forecasts corrected by boosted trees that are trained again every two months."""
    d = kept(dense(spark, sf))
    base = kept(forecast.seasonal_growth(d, forecast.targets(d, "1999-07-01", LAST, (1, 3, 6)), more_than=LARGE))
    made = learn.corrected(d, base, ["2000-09-01", "2000-12-01"], ["2000-08-01", "2000-09-01", "2000-10-01", "2000-12-01"], trees=5)
    return made.select(*SERIES, "origin", "h", "y_pred")
