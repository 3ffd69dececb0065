"""DuckDB SQL of the shared parts of the panel queries."""

PANEL = """
panel AS (
  SELECT c_nationkey AS territory_id, n_regionkey AS region_code, c_mktsegment AS category,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS y, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL),
calendar AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS month),
dense AS (
  SELECT s.*, c.month, p.y, count(p.y) OVER (PARTITION BY s.territory_id, s.category) AS n_obs,
    count(p.y) OVER (PARTITION BY s.territory_id, s.category) >= 60 AS complete
  FROM (SELECT DISTINCT territory_id, region_code, category FROM panel) s CROSS JOIN calendar c
  LEFT JOIN panel p ON p.territory_id = s.territory_id AND p.category = s.category AND p.month = c.month),
lagged AS (
  SELECT *, lag(y) OVER w AS y1, lag(y, 12) OVER w AS y12, last_value(y IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_y
  FROM dense WINDOW w AS (PARTITION BY territory_id, category ORDER BY month)),
scaled AS (SELECT *, avg(abs(y - y1)) OVER (PARTITION BY territory_id, category ORDER BY month ROWS UNBOUNDED PRECEDING) AS mase_scale FROM lagged),
grown AS (SELECT *, avg(CASE WHEN y12 > 0 THEN y / y12 END) OVER (PARTITION BY territory_id, category ORDER BY month ROWS 2 PRECEDING) AS g FROM scaled),
total AS (SELECT category, month, round(sum(y), 2) AS y FROM dense GROUP BY ALL),
total_lag AS (SELECT *, lag(y, 12) OVER (PARTITION BY category ORDER BY month) AS y12 FROM total),
national AS (
  SELECT category, month, avg(y / y12) OVER (w ROWS 2 PRECEDING) AS g, avg(ln(y / y12)) OVER (w ROWS 35 PRECEDING) / 12 AS a
  FROM total_lag WINDOW w AS (PARTITION BY category ORDER BY month)),
category_growth AS (
  SELECT d.category, d.month, CASE WHEN count(d.g) > 10 THEN median(d.g) ELSE any_value(n.g) END AS g_cat
  FROM grown d JOIN national n ON n.category = d.category AND n.month = d.month GROUP BY ALL),
factors AS (
  SELECT d.territory_id, d.category, d.month, g_cat * pow(least(greatest(coalesce(d.g / g_cat, 1), 0.5), 2), 0.5) AS g_own
  FROM grown d JOIN category_growth c ON c.category = d.category AND c.month = d.month),
asked AS (
  SELECT territory_id, region_code, category, o.month AS origin, h, CAST(o.month + to_months(h) AS DATE) AS target
  FROM (SELECT DISTINCT territory_id, region_code, category FROM dense) CROSS JOIN (SELECT month FROM calendar WHERE month >= DATE '2000-07-01') o
  CROSS JOIN (SELECT unnest([1, 3, 6, 12]) AS h) WHERE o.month + to_months(h) <= DATE '2001-07-01')
"""

RECORDS = """
truth AS (
  SELECT a.*, t.y AS y_true, t.y12 AS y_lag12, t.complete, o.mase_scale, o.last_y AS p_naive, t.y12 AS p_snaive, t.y12 * f.g_own AS p_growth
  FROM asked a JOIN scaled t ON t.territory_id = a.territory_id AND t.category = a.category AND t.month = a.target
  JOIN scaled o ON o.territory_id = a.territory_id AND o.category = a.category AND o.month = a.origin
  JOIN factors f ON f.territory_id = a.territory_id AND f.category = a.category AND f.month = a.origin),
records AS (
  SELECT * EXCLUDE (p_naive, p_snaive, p_growth), p_naive AS y_pred, 'naive' AS model FROM truth
  UNION ALL SELECT * EXCLUDE (p_naive, p_snaive, p_growth), p_snaive, 'snaive' FROM truth
  UNION ALL SELECT * EXCLUDE (p_naive, p_snaive, p_growth), p_growth, 'snaive_growth' FROM truth),
core AS (SELECT * FROM records WHERE complete AND y_true IS NOT NULL AND y_pred IS NOT NULL)
"""

RESIDUALS = """
e0 AS (SELECT territory_id, region_code, category, month, CASE WHEN y > 0 AND y12 > 0 THEN ln(y) - ln(y12) END AS e FROM lagged WHERE month >= DATE '1996-01-01'),
e1 AS (SELECT * REPLACE (e - median(e) OVER (PARTITION BY category, month) AS e) FROM e0)
"""


def scale(source: str, x: str, keys: str = "territory_id, category", name: str = "scaled_e") -> str:
    """CTEs that add s, the expanding scale of x, to the rows of source, as name."""
    return f"""
{name}_past AS (SELECT *, list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY {keys} ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}),
{name}_centre AS (SELECT *, list_aggregate(before, 'median') AS centre FROM {name}_past),
{name} AS (SELECT *, CASE WHEN len(before) >= 4 THEN greatest(1.4826 * list_aggregate(list_transform(before, lambda v: abs(v - centre)), 'median'), 0.01) END AS s FROM {name}_centre)
"""


def query(select: str, *parts: str) -> str:
    return "WITH " + ",".join([PANEL, *parts]) + select
