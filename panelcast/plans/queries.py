"""Queries of the panel engine over the star schema, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.functions import text as texts
from panelcast.operators import detect, evaluate, forecast, news, panel
from panelcast.plans.registry import LARGE, SERIES, dense, records, register, residual, rounded, scored
from panelcast.plans.sql import RECORDS, RESIDUALS, query, scale
from panelcast.sources.tables import LAST, messages, spending, table

# Panel


@register(query("SELECT territory_id, region_code, category, month, y, n_orders FROM panel"))
def panel_monthly(spark, sf):
    return spending(spark, sf)


@register(query("SELECT territory_id, category, n_obs, complete FROM dense GROUP BY ALL"))
def panel_completeness(spark, sf):
    return dense(spark, sf).select(*SERIES, "n_obs", "complete").distinct()


@register(query("SELECT territory_id, region_code, category, month, coalesce(y, 0) AS y FROM dense"))
def densify_fill(spark, sf):
    return dense(spark, sf).select("territory_id", "region_code", "category", "month", F.coalesce("y", F.lit(0.0)).alias("y"))


@register(query("""
SELECT territory_id, category, month, round(y, 2) AS y, share FROM (
  SELECT territory_id, category, month, y, 1.0::DOUBLE AS share FROM panel WHERE territory_id NOT IN (1, 2, 3)
  UNION ALL
  SELECT 3, category, month, sum(y * w) / sum(w), sum(w) / (SELECT count(*) FROM customer WHERE c_nationkey IN (1, 2))
  FROM panel JOIN (SELECT c_nationkey, count(*)::DOUBLE AS w FROM customer GROUP BY ALL) ON territory_id = c_nationkey WHERE territory_id IN (1, 2) GROUP BY ALL)"""))
def glue_weighted_mean(spark, sf):
    weights = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("territory_id")).agg(F.count("*").cast("double").alias("w"))
    return rounded(panel.glue(spending(spark, sf), {1: 3, 2: 3}, weights), 2, "y")


@register(query("SELECT territory_id, category, month, round(g, 6) AS g FROM grown"))
def yoy_growth(spark, sf):
    return rounded(forecast.yearly_growth(dense(spark, sf)).select(*SERIES, "month", "g"), 6, "g")


@register(query("SELECT category, month, round(g_cat, 6) AS g_cat FROM category_growth"))
def category_growth(spark, sf):
    return rounded(forecast.category_growth(dense(spark, sf), more_than=LARGE), 6, "g_cat")


@register(query("""
, numbered AS (SELECT *, row_number() OVER (PARTITION BY territory_id, category ORDER BY month) AS pos FROM dense),
bounds AS (
  SELECT *, max(CASE WHEN y IS NOT NULL THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS a,
    min(CASE WHEN y IS NOT NULL THEN pos END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM numbered WINDOW w AS (PARTITION BY territory_id, category ORDER BY month))
SELECT n.territory_id, n.category, n.month, round(CASE WHEN n.y IS NOT NULL THEN n.y WHEN a IS NULL THEN q.y WHEN b IS NULL THEN p.y ELSE p.y + (q.y - p.y) * (n.pos - a) / (b - a) END, 4) AS y
FROM bounds n LEFT JOIN numbered p ON p.territory_id = n.territory_id AND p.category = n.category AND p.pos = n.a
LEFT JOIN numbered q ON q.territory_id = n.territory_id AND q.category = n.category AND q.pos = n.b"""))
def interpolate_gaps(spark, sf):
    d = dense(spark, sf)
    return rounded(d.withColumn("y", panel.interpolated("y", panel.SERIES)).select(*SERIES, "month", "y"), 4, "y")


@register(query("SELECT territory_id, category, month, last_y FROM lagged"))
def last_valid_value(spark, sf):
    return dense(spark, sf).withColumn("last_y", panel.last_valid("y")).select(*SERIES, "month", "last_y")


INDEX = "idx AS (SELECT category, month, 100 * y / lag(y) OVER (PARTITION BY category ORDER BY month) AS x FROM total)"


def monthly_index(spark, sf):
    total = dense(spark, sf).groupBy("category", "month").agg(F.round(F.sum("y"), 2).alias("y"))
    return total.select("category", "month", (100 * F.col("y") / F.lag("y").over(Window.partitionBy("category").orderBy("month"))).alias("x"))


@register(query("SELECT category, month, round(CASE WHEN count(x) OVER w = 3 THEN exp(sum(ln(x / 100)) OVER w) * 100 END, 4) AS p FROM idx WINDOW w AS (PARTITION BY category ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)", INDEX))
def rolling_product(spark, sf):
    return monthly_index(spark, sf).select("category", "month", F.round(panel.rolling_product("x", ("category",)), 4).alias("p"))


@register(query("SELECT category, month, round(100 * exp(sum(ln(x / 100)) OVER (PARTITION BY category ORDER BY month ROWS UNBOUNDED PRECEDING)), 4) AS p FROM idx", INDEX))
def cumulative_index(spark, sf):
    return monthly_index(spark, sf).select("category", "month", F.round(panel.cumulative_index("x", ("category",)), 4).alias("p"))


@register(query("""
SELECT d.territory_id, d.category, d.month, d.y, round(lag(i.x) OVER w, 6) AS index_lag, round(i.x - lag(i.x, 3) OVER w, 6) AS index_change, a.n_suppliers
FROM dense d LEFT JOIN idx i ON i.category = d.category AND i.month = d.month LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY ALL) a ON a.s_nationkey = d.territory_id
WINDOW w AS (PARTITION BY d.territory_id, d.category ORDER BY d.month)""", INDEX))
def exog_left_chain(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("territory_id")).agg(F.count("*").alias("n_suppliers"))
    rows = dense(spark, sf).join(monthly_index(spark, sf), ["category", "month"], "left").join(s, "territory_id", "left")
    w = panel.over_time()
    return rows.select(*SERIES, "month", "y", F.round(F.lag("x").over(w), 6).alias("index_lag"), F.round(F.col("x") - F.lag("x", 3).over(w), 6).alias("index_change"), "n_suppliers")


@register(query("""
, share AS (SELECT territory_id, category, round(sum(y), 2) AS y FROM panel GROUP BY ALL)
SELECT territory_id, category, rank() OVER (PARTITION BY territory_id ORDER BY y DESC) + (count(*) OVER (PARTITION BY territory_id, y) - 1) / 2 AS r,
  round((sum(y) OVER (PARTITION BY territory_id) - y) / greatest(count(y) OVER (PARTITION BY territory_id) - 1, 1), 2) AS others FROM share"""))
def ranks_and_others(spark, sf):
    rows = spending(spark, sf).groupBy(*SERIES).agg(F.round(F.sum("y"), 2).alias("y"))
    return rows.select(*SERIES, panel.average_rank(F.col("y"), ["territory_id"]).alias("r"), F.round(panel.leave_one_out_mean("y", ["territory_id"]), 2).alias("others"))


# Forecasts


def accuracy(spark, sf, model):
    out = evaluate.summary(records(spark, sf, (model,)), ["h"])
    return rounded(out, 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


MEASURES = """avg(abs(y_true - y_pred)) AS mae, 100 * avg(abs(y_true - y_pred) / nullif(y_true, 0)) AS mape,
  avg(CASE WHEN mase_scale > 0 THEN abs(y_true - y_pred) / mase_scale END) AS mase,
  CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2_level,
  1 - sum(((y_true - y_pred) / nullif(y_lag12, 0)) ** 2) / nullif(var_pop(y_true / nullif(y_lag12, 0)) * count(y_true / nullif(y_lag12, 0)), 0) AS r2_yoy, count(*) AS n"""
SHOWN = "round(mae, 4) AS mae, round(mape, 4) AS mape, round(mase, 4) AS mase, round(r2_level, 4) AS r2_level, round(r2_yoy, 4) AS r2_yoy, n"


def accuracy_sql(by: str, where: str = "true") -> str:
    return query(f"SELECT {by}, {SHOWN} FROM (SELECT {by}, {MEASURES} FROM core WHERE {where} GROUP BY ALL)", RECORDS)


@register(accuracy_sql("h", "model = 'naive'"))
def naive_backtest(spark, sf):
    return accuracy(spark, sf, "naive")


@register(accuracy_sql("h", "model = 'snaive'"))
def seasonal_naive_backtest(spark, sf):
    return accuracy(spark, sf, "snaive")


@register(accuracy_sql("h", "model = 'snaive_growth'"))
def snaive_growth_backtest(spark, sf):
    return accuracy(spark, sf, "snaive_growth")


@register(accuracy_sql("model, h"))
def metrics_summary(spark, sf):
    return rounded(evaluate.summary(records(spark, sf), ["model", "h"]), 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


@register(accuracy_sql("model, h, category"))
def metrics_by_category(spark, sf):
    return rounded(evaluate.summary(records(spark, sf), ["model", "h", "category"]), 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


@register(accuracy_sql("model, h", "origin = CAST(DATE '2001-07-01' - to_months(h) AS DATE)"))
def metrics_holdout(spark, sf):
    rows = records(spark, sf).where(F.col("origin") == F.add_months(F.lit(LAST).cast("date"), -F.col("h")))
    return rounded(evaluate.summary(rows, ["model", "h"]), 4, "mae", "mape", "mase", "r2_level", "r2_yoy")


@register(query("SELECT territory_id, category, origin, h, model, round(y_pred, 2) AS y_pred FROM (SELECT *, count(DISTINCT model) OVER (PARTITION BY territory_id, category, origin, h) AS k FROM core) WHERE k = (SELECT count(DISTINCT model) FROM core)", RECORDS))
def common_support(spark, sf):
    rows = evaluate.common_support(records(spark, sf), [*SERIES, "origin", "h"])
    return rounded(rows.select(*SERIES, "origin", "h", "model", "y_pred"), 2, "y_pred")


@register(query("SELECT territory_id, category, origin, h, round(CASE WHEN count(y_pred) = count(*) THEN exp(avg(ln(y_pred))) END, 2) AS y_pred FROM records GROUP BY ALL", RECORDS))
def log_mean_ensemble(spark, sf):
    return rounded(forecast.log_mean(records(spark, sf), "ensemble").select(*SERIES, "origin", "h", "y_pred"), 2, "y_pred")


@register(query("""
, mae AS (
  SELECT a.category, a.origin, a.h, a.model, k.h AS h_used, avg(abs(y_true - y_pred)) AS mae
  FROM (SELECT DISTINCT category, origin, h, model FROM records) a JOIN core k ON k.category = a.category AND k.model = a.model AND k.target <= a.origin AND k.h <= a.h
  GROUP BY ALL HAVING count(*) > 20),
nearest AS (SELECT *, row_number() OVER (PARTITION BY category, origin, h ORDER BY mae, model) AS k FROM (SELECT *, max(h_used) OVER (PARTITION BY category, origin, h) AS top FROM mae) WHERE h_used = top),
weights AS (SELECT category, origin, h, model, CASE WHEN k <= 2 THEN 1 / mae ** 2 ELSE 0 END AS w FROM nearest),
weighed AS (SELECT r.*, CASE WHEN max(w) OVER (PARTITION BY r.category, r.origin, r.h) IS NULL THEN 1 ELSE coalesce(w, 0) END AS w FROM records r LEFT JOIN weights v ON v.category = r.category AND v.origin = r.origin AND v.h = r.h AND v.model = r.model)
SELECT territory_id, category, origin, h, round(CASE WHEN count(y_pred) = count(*) THEN exp(sum(w * ln(y_pred)) / sum(w)) END, 2) AS y_pred FROM weighed GROUP BY ALL""", RECORDS))
def online_stacking(spark, sf):
    return rounded(forecast.stacked(records(spark, sf), top_k=2, more_than=20).select(*SERIES, "origin", "h", "y_pred"), 2, "y_pred")


@register(query("""
, d AS (SELECT territory_id, category, origin, h, max(CASE WHEN model = 'snaive_growth' THEN abs(y_true - y_pred) END) - max(CASE WHEN model = 'snaive' THEN abs(y_true - y_pred) END) AS d FROM core GROUP BY ALL),
s AS (SELECT h, territory_id, category, sum(d) AS s, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY ALL)
SELECT h, round(sum(s) / sum(n), 2) AS d_mae, round(avg(CASE WHEN s < 0 THEN 1.0 ELSE 0 END), 6) AS win_share FROM s GROUP BY ALL""", RECORDS))
def model_compare(spark, sf):
    out = evaluate.compare(records(spark, sf, ("snaive", "snaive_growth")), "snaive_growth", "snaive")
    return out.select("h", F.round("d_mae", 2).alias("d_mae"), F.round("win_share", 6).alias("win_share"))


@register(query("""
, r AS (SELECT *, ln(y_true / y_pred) AS r FROM core WHERE model = 'snaive_growth' AND y_true > 0 AND y_pred > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY origin) AS k, count(*) OVER (PARTITION BY h) AS c FROM (SELECT DISTINCT h, origin FROM r)),
b AS (SELECT r.*, k <= c // 2 AS early FROM r JOIN o ON o.h = r.h AND o.origin = r.origin WHERE c >= 2),
q AS (SELECT category, h, quantile_cont(r, [0.05, 0.1, 0.9, 0.95]) AS q FROM b WHERE early GROUP BY ALL)
SELECT b.h, count(*) AS n, round(avg(CASE WHEN r >= q[2] AND r <= q[3] THEN 1.0 ELSE 0 END), 6) AS cover80, round(avg(CASE WHEN r >= q[1] AND r <= q[4] THEN 1.0 ELSE 0 END), 6) AS cover90
FROM b LEFT JOIN q ON q.category = b.category AND q.h = b.h WHERE NOT early GROUP BY ALL""", RECORDS))
def interval_coverage(spark, sf):
    return rounded(evaluate.interval_coverage(records(spark, sf, ("snaive_growth",))), 6, "cover80", "cover90")


# Detection


@register(query("SELECT territory_id, category, month, round(e, 6) + 0.0 AS e FROM e1", RESIDUALS))
def common_effect_removed(spark, sf):
    return rounded(detect.remove_common(residual(spark, sf)).select(*SERIES, "month", "e"), 6, "e")


@register(query("SELECT territory_id, category, month, round(s, 6) AS s FROM scaled_e", RESIDUALS, scale("e1", "e")))
def expanding_mad(spark, sf):
    rows = detect.with_scale(detect.remove_common(residual(spark, sf)), "e")
    return rows.select(*SERIES, "month", F.round("scale", 6).alias("s"))


@register(query("""
SELECT e.territory_id, e.category, e.month, round(abs(e.e) / q.q, 6) AS score FROM e1 e
LEFT JOIN (SELECT t.category, t.month, quantile_cont(abs(p.e), 0.9) AS q FROM (SELECT DISTINCT category, month FROM e1 WHERE month >= DATE '1996-07-01') t JOIN e1 p ON p.category = t.category AND p.month < t.month GROUP BY ALL) q
ON q.category = e.category AND q.month = e.month""", RESIDUALS))
def conformal_score(spark, sf):
    return scored(detect.conformal(detect.remove_common(residual(spark, sf))))


PANEL_SCORE = """
d AS (SELECT territory_id, region_code, category, month, e - CASE WHEN count(*) OVER (PARTITION BY category, region_code, month) >= 4 THEN median(e) OVER (PARTITION BY category, region_code, month) ELSE median(e) OVER (PARTITION BY category, month) END AS e FROM e0)
""" + "," + scale("d", "e", name="scaled_d") + ", p1 AS (SELECT territory_id, region_code, category, month, abs(e) / s AS score FROM scaled_d)"


@register(query("SELECT territory_id, category, month, round(score, 6) AS score FROM p1", RESIDUALS, PANEL_SCORE))
def panel_detector(spark, sf):
    return scored(detect.panel_score(residual(spark, sf)))


Z = scale("e1", "e") + ", zs AS (SELECT territory_id, region_code, category, month, e / s AS z FROM scaled_e)"


@register(query("""
, sums AS (SELECT *, sum(coalesce(z, 0) - 0.5) OVER w AS up, sum(-coalesce(z, 0) - 0.5) OVER w AS down FROM zs WINDOW w AS (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT territory_id, category, month, round(CASE WHEN z IS NOT NULL THEN greatest(up - least(0, min(up) OVER w), down - least(0, min(down) OVER w)) END, 6) AS score
FROM sums WINDOW w AS (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING)""", RESIDUALS, Z))
def cusum_closed_form(spark, sf):
    return scored(detect.cusum(detect.remove_common(residual(spark, sf))))


@register(query("""
, steps AS (SELECT *, row_number() OVER (PARTITION BY territory_id, category ORDER BY month) AS k FROM zs),
walk AS (
  SELECT territory_id, category, month, k, z, CAST(0 AS DOUBLE) AS p, CAST(0 AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS score FROM steps WHERE k = 0
  UNION ALL SELECT territory_id, category, NULL, 0, NULL, 0, 0, NULL FROM (SELECT DISTINCT territory_id, category FROM steps)
  UNION ALL
  SELECT territory_id, category, month, k, z, CASE WHEN z IS NOT NULL AND greatest(a, b) > 4 THEN 0 ELSE a END, CASE WHEN z IS NOT NULL AND greatest(a, b) > 4 THEN 0 ELSE b END, CASE WHEN z IS NOT NULL THEN greatest(a, b) END
  FROM (SELECT s.*, CASE WHEN s.z IS NULL THEN w.p ELSE greatest(0, w.p + s.z - 0.5) END AS a, CASE WHEN s.z IS NULL THEN w.n ELSE greatest(0, w.n - s.z - 0.5) END AS b
    FROM walk w JOIN steps s ON s.territory_id = w.territory_id AND s.category = w.category AND s.k = w.k + 1))
SELECT territory_id, category, month, round(score, 6) AS score FROM walk WHERE k > 0""", RESIDUALS, Z).replace("WITH ", "WITH RECURSIVE ", 1))
def cusum_reset(spark, sf):
    return scored(detect.cusum_reset(detect.remove_common(residual(spark, sf))))


@register(query("""
, steps AS (SELECT *, CASE WHEN z IS NOT NULL THEN z - avg(z) OVER w - 0.1 ELSE 0 END AS step FROM zs WINDOW w AS (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING)),
sums AS (SELECT *, sum(step) OVER (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING) AS t FROM steps)
SELECT territory_id, category, month, round(CASE WHEN z IS NOT NULL THEN greatest(t - least(0, min(t) OVER w), greatest(0, max(t) OVER w) - t) END, 6) AS score
FROM sums WINDOW w AS (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING)""", RESIDUALS, Z))
def page_hinkley(spark, sf):
    return scored(detect.page_hinkley(detect.remove_common(residual(spark, sf))))


MULTI = Z + ", m1 AS (SELECT territory_id, category, month, sqrt(avg(z * z) OVER (PARTITION BY territory_id, month)) AS score FROM zs)"


@register(query("SELECT territory_id, category, month, round(score, 6) AS score FROM m1", RESIDUALS, MULTI))
def multivariate_score(spark, sf):
    return scored(detect.multivariate(detect.remove_common(residual(spark, sf))))


def normed(name: str) -> str:
    return f"(SELECT a.territory_id, a.category, a.month, a.score / nullif(m.d, 0) AS score FROM {name} a LEFT JOIN (SELECT t.month, median(p.score) AS d FROM (SELECT DISTINCT month FROM e1) t JOIN {name} p ON p.month <= t.month GROUP BY ALL) m ON m.month = a.month)"


@register(query(f"SELECT a.territory_id, a.category, a.month, round(0.5 * (a.score + b.score), 6) AS score FROM {normed('p1')} a JOIN {normed('m1')} b ON b.territory_id = a.territory_id AND b.category = a.category AND b.month = a.month", RESIDUALS, PANEL_SCORE, MULTI))
def panel_multivariate(spark, sf):
    rows = residual(spark, sf)
    return scored(detect.mean_of(detect.expanding_median(detect.panel_score(rows)), detect.expanding_median(detect.multivariate(detect.remove_common(rows)))))


REGIONAL = (
    "rm AS (SELECT category, region_code, month, median(e) AS m FROM e1 GROUP BY ALL HAVING count(*) >= 4)," + scale("rm", "m", "category, region_code", "scaled_r")
    + ", r1 AS (SELECT e.territory_id, e.category, e.month, abs(m) / s AS score FROM e1 e LEFT JOIN scaled_r r ON r.category = e.category AND r.region_code = e.region_code AND r.month = e.month)"
)


@register(query("SELECT territory_id, category, month, round(score, 6) AS score FROM r1", RESIDUALS, REGIONAL))
def regional_score(spark, sf):
    return scored(detect.regional(residual(spark, sf)))


RANKS = """
pr AS (SELECT * FROM (SELECT a.territory_id, a.category, a.month, a.month AS own, t.month AS t, cume_dist() OVER (PARTITION BY t.month ORDER BY a.score) AS score FROM p1 a JOIN (SELECT DISTINCT month FROM e1) t ON a.month <= t.month WHERE a.score IS NOT NULL) WHERE own = t),
rr AS (SELECT * FROM (SELECT a.territory_id, a.category, a.month, a.month AS own, t.month AS t, cume_dist() OVER (PARTITION BY t.month ORDER BY a.score) AS score FROM r1 a JOIN (SELECT DISTINCT month FROM e1) t ON a.month <= t.month WHERE a.score IS NOT NULL) WHERE own = t)
"""


@register(query("SELECT e.territory_id, e.category, e.month, round(p.score, 9) AS score FROM e1 e LEFT JOIN pr p ON p.territory_id = e.territory_id AND p.category = e.category AND p.month = e.month", RESIDUALS, PANEL_SCORE, REGIONAL, RANKS))
def expanding_rank(spark, sf):
    return scored(detect.expanding_rank(detect.panel_score(residual(spark, sf))), 9)


@register(query("""SELECT e.territory_id, e.category, e.month, round(greatest(p.score, r.score), 9) AS score FROM e1 e
LEFT JOIN pr p ON p.territory_id = e.territory_id AND p.category = e.category AND p.month = e.month LEFT JOIN rr r ON r.territory_id = e.territory_id AND r.category = e.category AND r.month = e.month""", RESIDUALS, PANEL_SCORE, REGIONAL, RANKS))
def panel_regional(spark, sf):
    rows = residual(spark, sf)
    return scored(detect.either(detect.expanding_rank(detect.panel_score(rows)), detect.expanding_rank(detect.regional(rows))), 9)


ALARMS = """mo AS (SELECT territory_id, month, max(score) AS score FROM p1 WHERE month >= DATE '1997-01-01' GROUP BY ALL),
alarms AS (SELECT *, coalesce(score > quantile_cont(score, 0.8) OVER (PARTITION BY month), false) AS alarm FROM mo),
events_mo AS (SELECT o_nation AS territory_id, month FROM (SELECT c_nationkey AS o_nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '2001-05-01' GROUP BY ALL) WHERE top >= 450000)"""


def territory_alarms(spark, sf):
    each = detect.panel_score(residual(spark, sf)).where(F.col("month") >= "1997-01-01").groupBy("territory_id", "month").agg(F.max("score").alias("score"))
    return evaluate.top_share_alarms(each, 0.2, ["month"])


def large_orders(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where((F.col("o_orderdate") >= "1997-02-01") & (F.col("o_orderdate") < "2001-05-01"))
    return o.groupBy(F.col("c_nationkey").alias("territory_id"), F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(F.max("o_totalprice").alias("top")).where("top >= 450000").select("territory_id", "month")


@register(query("SELECT territory_id, month, round(score, 6) AS score, alarm FROM alarms", RESIDUALS, PANEL_SCORE, ALARMS))
def monthly_budget_alarms(spark, sf):
    return rounded(territory_alarms(spark, sf), 6, "score")


@register(query("""SELECT e.territory_id, e.month, coalesce(bool_or(a.alarm), false) AS hit FROM events_mo e
LEFT JOIN alarms a ON a.territory_id = e.territory_id AND a.month BETWEEN e.month - to_months(1) AND e.month + to_months(2) GROUP BY ALL""", RESIDUALS, PANEL_SCORE, ALARMS))
def event_window_hits(spark, sf):
    return evaluate.event_hits(territory_alarms(spark, sf), large_orders(spark, sf))


@register(query("""
, heads AS (SELECT c_nationkey AS territory_id, CAST(count(*) AS DOUBLE) AS people FROM customer GROUP BY ALL),
j AS (SELECT a.*, e.territory_id IS NOT NULL AS event, people FROM alarms a JOIN heads h ON h.territory_id = a.territory_id LEFT JOIN events_mo e ON e.territory_id = a.territory_id AND e.month = a.month WHERE a.score IS NOT NULL),
k AS (SELECT territory_id, row_number() OVER (ORDER BY people, territory_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT territory_id, people FROM j)),
s AS (SELECT j.*, 1 + CAST(r > 1 + (n - 1) * 0.25 AS INT) + CAST(r > 1 + (n - 1) * 0.5 AS INT) + CAST(r > 1 + (n - 1) * 0.75 AS INT) AS quartile FROM j JOIN k ON k.territory_id = j.territory_id)
SELECT coalesce(quartile, 0) AS quartile, count(*) AS n, round(avg(CASE WHEN event THEN alarm::INT END) / nullif(avg(CASE WHEN NOT event THEN alarm::INT END), 0), 6) AS lift FROM s GROUP BY ROLLUP (quartile)""", RESIDUALS, PANEL_SCORE, ALARMS))
def quartile_lift(spark, sf):
    """Alarm rates with and without an event by quartile of the territories' people."""
    heads = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("territory_id")).agg(F.count("*").cast("double").alias("people"))
    rows = territory_alarms(spark, sf).where("score is not null").join(large_orders(spark, sf).withColumn("_e", F.lit(True)), ["territory_id", "month"], "left")
    rows = rows.join(heads, "territory_id").withColumn("event", F.coalesce("_e", F.lit(False)))
    return rounded(evaluate.lift_by_quartile(rows, "people", "event", "alarm"), 6, "lift")


@register(query("""
, each AS (SELECT model, h, round(avg(abs(y_true - y_pred)), 4) AS mae, round(avg(abs(y_true - y_pred) / nullif(y_true, 0)), 6) AS mape FROM core GROUP BY ALL),
r AS (SELECT model, h, rank() OVER (PARTITION BY h ORDER BY mae DESC) + (count(*) OVER (PARTITION BY h, mae) - 1) / 2 AS a, rank() OVER (PARTITION BY h ORDER BY mape DESC) + (count(*) OVER (PARTITION BY h, mape) - 1) / 2 AS b FROM each)
SELECT model, round(avg((a + b) / 2), 6) AS mean_rank FROM r GROUP BY ALL""", RECORDS))
def scorecard_avg_rank(spark, sf):
    each = evaluate.core(records(spark, sf)).groupBy("model", "h").agg(F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred")) / F.nullif(F.col("y_true"), F.lit(0.0))), 6).alias("mape"))
    ranks = each.select("model", panel.average_rank(F.col("mae"), ["h"]).alias("a"), panel.average_rank(F.col("mape"), ["h"]).alias("b"))
    return ranks.groupBy("model").agg(F.round(F.avg((F.col("a") + F.col("b")) / 2), 6).alias("mean_rank"))


# News

GROUPS = ("click", "view", "purchase", "login", "error")
MESSAGES = """WITH m AS (SELECT 'c' || (event_id % 3) AS channel, event_id AS msg_id, CAST(user_id % 25 AS INT) AS territory_id, CAST(user_id % 5 AS INT) AS region_code, event_type, ts AS published, CAST(ts AS DATE) AS day,
  CAST(least(greatest(floor(value / 25), 0), 3) AS INT) AS severity FROM events)"""


@register(MESSAGES + """
, sparse AS (SELECT * FROM m WHERE msg_id % 7 = 0),
g AS (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month, lag(published) OVER (PARTITION BY territory_id, event_type, date_trunc('month', day) ORDER BY published, channel, msg_id) AS before FROM sparse),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR floor((floor(epoch(published)) - floor(epoch(before))) / 86400) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY territory_id, event_type, month ORDER BY published, channel, msg_id) AS chain FROM g)
SELECT territory_id, event_type, month, any_value(region_code) AS region_code, min(published) AS start, max(severity) AS severity, count(*) AS msgs, count(DISTINCT channel) AS channels FROM c GROUP BY territory_id, event_type, month, chain""")
def incident_chains(spark, sf):
    """Chains broken after more than three days; every seventh message, so that there are such gaps."""
    return news.incidents(messages(spark, sf).where("msg_id % 7 = 0"))


@register(MESSAGES + """
, grid AS (SELECT territory_id, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS month FROM (SELECT DISTINCT territory_id FROM m)),
c AS (SELECT territory_id, day, """ + ", ".join(f"count(*) FILTER (event_type = '{g}') AS n_{g}" for g in GROUPS) + """, sum(severity) AS sev, max(severity) AS max_sev, count(DISTINCT msg_id) AS msgs FROM m GROUP BY ALL),
f AS (SELECT grid.territory_id, grid.month, """ + ", ".join(f"coalesce(n_{g}, 0) AS n_{g}" for g in GROUPS) + """, coalesce(sev, 0) AS sev, coalesce(max_sev, 0) AS max_sev, coalesce(msgs, 0) AS msgs FROM grid LEFT JOIN c ON c.territory_id = grid.territory_id AND c.day = grid.month),
a AS (SELECT *, """ + " + ".join(f"n_{g}" for g in GROUPS) + """ AS n_all FROM f)
SELECT *, round(CASE WHEN count(*) OVER w >= 3 THEN ln(1 + n_all) - ln(1 + avg(n_all) OVER w) END, 6) + 0.0 AS surge FROM a WINDOW w AS (PARTITION BY territory_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def surge_feature(spark, sf):
    return rounded(news.daily_features(messages(spark, sf), "2024-01-01", "2024-01-30", GROUPS), 6, "surge")


TYPES = {"license": r"licen[sc]e", "money": r"\$|€", "mail": r"@", "number": r"[0-9]{4}", "heading": r"^[a-z]"}


@register("SELECT doc_id, list_aggregate(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in TYPES.items()) + "], lambda x: x IS NOT NULL), 'string_agg', ',') AS types, replace(left(text, 40), chr(10), ' ') AS snippet FROM documents")
def text_event_types(spark, sf):
    d = table(spark, sf, "documents")
    found = F.array_join(texts.types_of(F.col("text"), TYPES), ",")
    return d.select("doc_id", F.when(found != "", found).alias("types"), texts.snippet(F.col("text"), 40).alias("snippet"))


@register("""SELECT lang, k, n, round(((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
round(((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high
FROM (SELECT lang, CAST(sum(quality) AS BIGINT) AS k, count(*) AS n FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY ALL)""")
def wilson_accuracy(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum(F.col("quality").cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("""WITH r AS (SELECT n_chars AS s, count(*) AS n, sum(quality) AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - n AS before FROM r)
SELECT round((sum(p * (before + (n + 1) / 2)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) - sum(p) AS BIGINT) AS negatives FROM b""")
def roc_auc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(evaluate.auc(rows, "n_chars", "quality"), 6, "auc")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_isin(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@register("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-05-01')")
def anti_join_drop(spark, sf):
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '2001-05-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@register("""WITH w AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS week, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY ALL),
j AS (SELECT m.month, week, v, row_number() OVER (PARTITION BY m.month ORDER BY week DESC) AS k FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders) m JOIN w ON week <= last_day(m.month) AND week > last_day(m.month) - 63)
SELECT month, CASE WHEN count(*) >= 2 THEN round(avg(v), 4) END AS v, count(*) AS weeks FROM j WHERE k <= 4 GROUP BY ALL""")
def asof_last_weeks(spark, sf):
    """Mean of the last four weeks that end by each month's end; a week joins the months whose end is within nine weeks of it."""
    week = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 6)
    weeks = table(spark, sf, "lineitem").groupBy(week.alias("week")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    months = table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).distinct()
    near = weeks.withColumn("month", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.add_months(F.trunc("week", "MM"), i))))
    near = near.where((F.col("week") <= F.last_day("month")) & (F.col("week") > F.date_sub(F.last_day("month"), 63))).join(months, "month", "left_semi")
    last = near.withColumn("_k", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("week")))).where("_k <= 4")
    return last.groupBy("month").agg(F.when(F.count("*") >= 2, F.round(F.avg("v"), 4)).alias("v"), F.count("*").alias("weeks"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", texts.json_object(F.concat(F.lit("answer: "), "props", F.lit(" .")), "k long")["k"].alias("k"))


@register("""SELECT p_partkey, left(CASE WHEN length(d) < 8 THEN lpad(d, 8, '0') ELSE d END, 8) AS code, regexp_replace(lower(p_type), '^(standard|small|medium|large|economy|promo)\\s+', '') AS kind,
p_name ILIKE 'a%' AS starts FROM (SELECT *, regexp_replace(p_brand || '-' || p_partkey, '\\D', '', 'g') AS d FROM part)""")
def string_functions(spark, sf):
    p = table(spark, sf, "part")
    code = texts.area_code(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")))
    return p.select("p_partkey", code.alias("code"), texts.without_prefix(F.lower("p_type"), ("standard", "small", "medium", "large", "economy", "promo")).alias("kind"), F.lower("p_name").startswith("a").alias("starts"))


@register("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(day(last_day(CAST(o_orderdate AS DATE))) AS INT) AS days, CAST(month(o_orderdate) AS INT) AS moy, CAST(date_trunc('month', o_orderdate) + to_months(-12) AS DATE) AS year_ago,
CAST(date_trunc('month', o_orderdate + INTERVAL 12 HOUR) AS DATE) AS shifted FROM orders""")
def date_functions(spark, sf):
    day = F.to_date("o_orderdate")
    month = F.trunc(day, "MM")
    shifted = F.trunc(F.to_date(F.col("o_orderdate") + F.expr("interval 12 hours")), "MM")
    return table(spark, sf, "orders").select("o_orderkey", month.alias("month"), F.last_day(day).alias("month_end"), F.dayofmonth(F.last_day(day)).alias("days"), F.month(day).alias("moy"), F.add_months(month, -12).alias("year_ago"), shifted.alias("shifted"))


@register("""WITH c AS (SELECT c_custkey, round(c_acctbal / 250) * 250 AS cell FROM customer), g AS (SELECT DISTINCT round(s_acctbal / 250) * 250 AS cell, min(s_suppkey) OVER (PARTITION BY round(s_acctbal / 250) * 250) AS s_suppkey FROM supplier)
SELECT c_custkey, c.cell + 0.0 AS cell, s_suppkey FROM c LEFT JOIN g ON g.cell = c.cell""")
def nearest_grid_cell(spark, sf):
    cell = lambda c: (F.round(F.col(c) / 250) * 250).alias("cell")
    grid = table(spark, sf, "supplier").groupBy(cell("s_acctbal")).agg(F.min("s_suppkey").alias("s_suppkey"))
    return table(spark, sf, "customer").select("c_custkey", cell("c_acctbal")).join(grid, "cell", "left").select("c_custkey", "cell", "s_suppkey")


@register(query("SELECT territory_id, month, sum(y) FILTER (category = 'BUILDING') AS building, sum(y) FILTER (category = 'MACHINERY') AS machinery FROM panel GROUP BY ALL"))
def pivot_categories(spark, sf):
    return spending(spark, sf).groupBy("territory_id", "month").pivot("category", ["BUILDING", "MACHINERY"]).agg(F.sum("y")).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@register("SELECT c_nationkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey) WHERE k <= 3")
def top_k_orders(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return rows.withColumn("_k", k).where("_k <= 3").select("c_nationkey", "o_orderkey", "o_totalprice")


@register("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_version(spark, sf):
    return panel.latest_version(table(spark, sf, "orders"), "o_custkey", F.struct("o_orderdate", "o_orderkey").desc()).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()
    return keys.subtract(table(spark, sf, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@register(query("""
, a AS (SELECT category, month, sum(y * w) AS v FROM panel JOIN (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY ALL) ON territory_id = c_nationkey GROUP BY ALL),
b AS (SELECT category, c.month, v FROM calendar c JOIN a ON a.month = c.month)
SELECT category, month, round(v / lag(v, 12) OVER (PARTITION BY category ORDER BY month) - 1, 6) + 0.0 AS growth FROM b"""))
def weighted_growth(spark, sf):
    w = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("territory_id")).agg(F.count("*").alias("w"))
    v = spending(spark, sf).join(w, "territory_id").groupBy("category", "month").agg(F.sum(F.col("y") * F.col("w")).alias("v"))
    lag = F.lag("v", 12).over(Window.partitionBy("category").orderBy("month"))
    return v.select("category", "month", F.round(F.col("v") / lag - 1, 6).alias("growth"))


@register("""WITH r AS (SELECT n_chars AS s, count(*) AS n, sum(quality) AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY ALL),
u AS (SELECT *, sum(n) OVER w AS un, sum(p) OVER w AS up, sum(n) OVER () AS tn, sum(p) OVER () AS tp FROM r WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT max(un) AS hn, max(up) AS hp FROM u WHERE s >= (SELECT quantile_cont(n_chars, 0.95) FROM labels JOIN documents ON labels.doc_id = documents.doc_id))
SELECT round(sum(p * up / un) / max(tp), 6) AS average_precision, round(max(hp / hn), 6) AS precision_top, round(max(hp / tp), 6) AS recall_top, round(max(hp / hn) / max(tp / tn), 6) AS lift_top FROM u CROSS JOIN h""")
def precision_at_top(spark, sf):
    """Average precision, and precision, recall and lift in the highest 5 %."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(evaluate.precision_curve(rows, "n_chars", "quality"), 6, "average_precision", "precision_top", "recall_top", "lift_top")
