"""Queries of the sequential detectors, of all detectors together, and of the cluster bootstrap."""

from __future__ import annotations

from panelcast.operators import detect, evaluate
from panelcast.plans.queries import PANEL_SCORE, RANKS, Z, REGIONAL
from panelcast.plans.registry import ORACLE_SQL, records, register, residual, rounded, scored
from panelcast.plans.sql import RECORDS, RESIDUALS, query
from pyspark.sql import functions as F


def recursive(select: str, *parts: str) -> str:
    return query(select, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


BOCPD = Z + """,
bsteps AS (SELECT territory_id, category, month, z, row_number() OVER (PARTITION BY territory_id, category ORDER BY month) AS k FROM zs),
bo AS (
  SELECT territory_id, category, 0::BIGINT AS k, NULL::DATE AS month, [1.0::DOUBLE] AS p, [0.0::DOUBLE] AS m, [1.0::DOUBLE] AS b, NULL::DOUBLE AS score FROM (SELECT DISTINCT territory_id, category FROM bsteps)
  UNION ALL
  SELECT territory_id, category, k, month, CASE WHEN z IS NULL THEN p ELSE list_prepend(1 / 24, list_transform(w, lambda x: x * 23 / 24 / t)) END,
    CASE WHEN z IS NULL THEN m ELSE list_prepend(0, list_transform(m, lambda x, i: (i * x + z) / (i + 1))) END,
    CASE WHEN z IS NULL THEN b ELSE list_prepend(1, list_transform(b, lambda x, i: x + i * pow(z - m[i], 2) / (2 * (i + 1)))) END, CASE WHEN z IS NOT NULL THEN 1 / 24 + 23 / 24 * (w[1] / t) END
  FROM (SELECT *, list_sum(w) AS t FROM (SELECT s.territory_id, s.category, s.k, s.month, z, p, m, b,
      list_transform(range(1, len(p) + 1), lambda i: p[i] * exp(lgamma((i + 2) / 2) - lgamma((i + 1) / 2)) / sqrt((i + 1) * pi() * b[i] * (i + 1) / ((i + 1) / 2 * i)) * pow(1 + pow(z - m[i], 2) / (b[i] * (i + 1) / ((i + 1) / 2 * i)) / (i + 1), -(i + 2) / 2)) AS w
    FROM bo JOIN bsteps s ON s.territory_id = bo.territory_id AND s.category = bo.category AND s.k = bo.k + 1))),
b1 AS (SELECT territory_id, category, month, score FROM bo WHERE k > 0)"""


def cost(a: str, b: str) -> str:
    return f"greatest(c2[({b}) + 1] - c2[({a}) + 1] - pow(c1[({b}) + 1] - c1[({a}) + 1], 2) / (({b}) - ({a})), 0)"


SEGMENTS = """
px AS (SELECT territory_id, category, list(coalesce(e, 0) ORDER BY month) AS x, list(month ORDER BY month) AS months FROM e1 GROUP BY ALL),
pd AS (SELECT *, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(x[1:i]), 0)) AS c1, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda v: v * v)), 0)) AS c2,
  list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS steps FROM px),
pe AS (SELECT territory_id, category, months[t + 1] AS month, t, p, p * CASE WHEN unit = 0 THEN 1e-6 ELSE unit END AS pen
  FROM (SELECT territory_id, category, months, t, list_aggregate(steps[1:t], 'var_pop') AS unit FROM pd, LATERAL (SELECT unnest(range(6, len(x))) AS t) WHERE t % 5 = 1), (SELECT unnest([0.5, 1, 2, 4, 8, 16, 32])::DOUBLE AS p))"""


def last_run(found: str) -> str:
    """The largest of the rising penalties before the first without a cut; 0 elsewhere."""
    return f"""SELECT e.territory_id, e.category, e.month, coalesce(b.score, 0)::DOUBLE AS score FROM e1 e LEFT JOIN
(SELECT territory_id, category, month, max(p) FILTER (p < missed) AS score FROM (SELECT *, coalesce(min(p) FILTER (NOT found) OVER (PARTITION BY territory_id, category, month), 1e9) AS missed FROM {found}) GROUP BY ALL) b
ON b.territory_id = e.territory_id AND b.category = e.category AND b.month = e.month"""


PELT = SEGMENTS + f""",
po AS (
  SELECT territory_id, category, month, t, p, pen, 0 AS k, [-pen] AS f FROM pe
  UNION ALL
  SELECT o.territory_id, o.category, month, t, p, pen, k + 1, list_append(f, list_min(list_transform(range(0, k + 1), lambda j: f[j + 1] + {cost('5 * j', '5 * (k + 1)')})) + pen) FROM po o JOIN pd ON pd.territory_id = o.territory_id AND pd.category = o.category WHERE 5 * (k + 1) <= t - 1),
pf AS (SELECT o.territory_id, o.category, month, p, f[k + 1] + {cost('5 * k', 't + 1')} < list_min(list_transform(range(0, k), lambda j: f[j + 1] + {cost('5 * j', 't + 1')})) AS found
  FROM po o JOIN pd ON pd.territory_id = o.territory_id AND pd.category = o.category WHERE 5 * k = t - 1)"""
BINSEG = SEGMENTS + f""",
bi AS (
  SELECT territory_id, category, month, t, p, pen, 0::BIGINT AS a, 0 AS found FROM pe
  UNION ALL
  SELECT territory_id, category, month, t, p, pen, 5 * (a // 5 + list_position(gains, list_max(gains))), CASE WHEN list_max(gains) > pen THEN CASE WHEN 5 * (a // 5 + list_position(gains, list_max(gains))) = t - 1 THEN 1 ELSE 0 END ELSE 2 END
  FROM (SELECT o.territory_id, o.category, month, t, p, pen, a, list_transform(range(a // 5 + 1, (t - 1) // 5 + 1), lambda j: {cost('a', 't + 1')} - {cost('a', '5 * j')} - {cost('5 * j', 't + 1')}) AS gains FROM bi o JOIN pd ON pd.territory_id = o.territory_id AND pd.category = o.category WHERE found = 0)),
bf AS (SELECT territory_id, category, month, p, max(found) = 1 AS found FROM bi GROUP BY ALL)"""
ROUNDED = "SELECT territory_id, category, month, round(score, {digits}) AS score FROM {source}"


@register(recursive(ROUNDED.format(digits=6, source="b1"), RESIDUALS, BOCPD))
def bocpd_score(spark, sf):
    """Probability that a run has just begun, of the residuals freed of their category's month."""
    return scored(detect.change_points(detect.remove_common(residual(spark, sf))))


@register(recursive(ROUNDED.format(digits=6, source=f"({last_run('pf')})"), RESIDUALS, PELT))
def pelt_score(spark, sf):
    """The last cut of the optimal segmentation with pruning."""
    return scored(detect.segmentation(detect.remove_common(residual(spark, sf))))


@register(recursive(ROUNDED.format(digits=6, source=f"({last_run('bf')})"), RESIDUALS, BINSEG))
def binseg_score(spark, sf):
    """The last cut of binary segmentation."""
    return scored(detect.segmentation(detect.remove_common(residual(spark, sf)), "binseg"))


CONFORMAL_RAW = query("""
SELECT e.territory_id, e.category, e.month, round(abs(e.e) / q.q, 6) AS score FROM e0 e
LEFT JOIN (SELECT t.category, t.month, quantile_cont(abs(p.e), 0.9) AS q FROM (SELECT DISTINCT category, month FROM e0 WHERE month >= DATE '1996-07-01') t JOIN e0 p ON p.category = t.category AND p.month < t.month GROUP BY ALL) q
ON q.category = e.category AND q.month = e.month""", RESIDUALS)
RANKED_BOCPD = RANKS.replace("rr AS", "br AS").replace("FROM r1 a", "FROM b1 a")
PANEL_BOCPD = recursive("""SELECT e.territory_id, e.category, e.month, round(greatest(p.score, b.score), 9) AS score FROM e1 e
LEFT JOIN pr p ON p.territory_id = e.territory_id AND p.category = e.category AND p.month = e.month LEFT JOIN br b ON b.territory_id = e.territory_id AND b.category = e.category AND b.month = e.month""", RESIDUALS, PANEL_SCORE, BOCPD, RANKED_BOCPD)
EACH = {
    "conformal_raw": CONFORMAL_RAW, "panel_bocpd": PANEL_BOCPD, "conformal": "conformal_score", "panel": "panel_detector", "cusum": "cusum_closed_form", "cusum_reset": "cusum_reset", "page_hinkley": "page_hinkley",
    "multivariate": "multivariate_score", "panel_multivariate": "panel_multivariate", "bocpd": "bocpd_score", "pelt": "pelt_score", "binseg": "binseg_score", "regional": "regional_score", "panel_regional": "panel_regional",
}


@register(PANEL_BOCPD)
def panel_bocpd(spark, sf):
    """The greater of the expanding ranks of the panel's score and of the run's."""
    rows = residual(spark, sf)
    return scored(detect.either(detect.expanding_rank(detect.panel_score(rows)), detect.expanding_rank(detect.change_points(detect.remove_common(rows)))), 9)


@register(" UNION ALL ".join(f"SELECT '{name}' AS detector, territory_id, category, month, score FROM ({ORACLE_SQL.get(sql, sql)})" for name, sql in EACH.items()))
def all_detectors(spark, sf):
    """All detectors over the same residuals; ranks have nine digits, as in their own queries."""
    rank = F.col("detector").isin("panel_bocpd", "panel_regional")
    return detect.all_scores(residual(spark, sf)).withColumn("score", F.when(rank, F.round("score", 9)).otherwise(F.round("score", 6)))


@register(query("""
, dd AS (SELECT a.h, a.territory_id, abs(a.y_true - a.y_pred) - abs(b.y_true - b.y_pred) AS d FROM core a JOIN core b ON a.territory_id = b.territory_id AND a.category = b.category AND a.origin = b.origin AND a.h = b.h WHERE a.model = 'snaive_growth' AND b.model = 'snaive'),
cl AS (SELECT h, territory_id, sum(d) AS s, count(*) AS n FROM dd GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY territory_id) - 1 AS rank, count(*) OVER (PARTITION BY h) AS size FROM cl),
picks AS (SELECT h, draw, ('0x' || substr(md5(h || ':' || draw || ':' || j), 1, 13))::BIGINT % size AS rank FROM (SELECT DISTINCT h, size FROM cr), LATERAL (SELECT unnest(range(1, 501)) AS draw), LATERAL (SELECT unnest(range(size)) AS j)),
means AS (SELECT p.h, draw, sum(s) / sum(n) AS m FROM picks p JOIN cr ON cr.h = p.h AND cr.rank = p.rank GROUP BY ALL)
SELECT h, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY ALL""", RECORDS))
def cluster_bootstrap(spark, sf):
    """Interval of the difference of errors, by 500 draws of as many territories with replacement as there are."""
    out = evaluate.cluster_bootstrap(records(spark, sf, ("snaive", "snaive_growth")), "snaive_growth", "snaive")
    return rounded(out, 6, "ci_low", "ci_high")
