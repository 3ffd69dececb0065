"""Accuracy, coverage, lift and hit rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.selection import with_grouped_quantile


def core(records: DataFrame) -> DataFrame:
    return records.where("complete and y_true is not null and y_pred is not null")


def r_squared(y: Column, p: Column) -> Column:
    total = F.var_pop(F.when(p.isNotNull(), y)) * F.count(F.when(p.isNotNull(), y))
    return F.when(total > 0, 1 - F.sum((y - p) * (y - p)) / total)


def summary(records: DataFrame, by: list[str]) -> DataFrame:
    """MAE, MAPE, MASE, R2 of the level and of yearly growth, n, over the core rows."""
    y, p, lag = F.col("y_true"), F.col("y_pred"), F.col("y_lag12")
    error = F.abs(y - p)
    return core(records).groupBy(*by).agg(
        F.avg(error).alias("mae"),
        (100 * F.avg(error / F.when(y != 0, y))).alias("mape"),
        F.avg(F.when(F.col("mase_scale") > 0, error / F.col("mase_scale"))).alias("mase"),
        r_squared(y, p).alias("r2_level"),
        r_squared(y / F.when(lag != 0, lag) - 1, p / F.when(lag != 0, lag) - 1).alias("r2_yoy"),
        F.count("*").alias("n"),
    )


def common_support(records: DataFrame, keys: list[str]) -> DataFrame:
    """Core rows that every model has."""
    rows = core(records)
    n = rows.select("model").distinct().groupBy().agg(F.count("*").alias("_models"))
    found = F.size(F.collect_set("model").over(Window.partitionBy(*keys)))
    return rows.withColumn("_n", found).crossJoin(F.broadcast(n)).where("_n = _models").drop("_n", "_models")


def differences(records: DataFrame, model: str, ref: str) -> DataFrame:
    """Rows of both models: d, the absolute error of model less that of ref."""
    keys = ["territory_id", "category", "origin", "h"]
    rows = core(records).where(F.col("model").isin(model, ref))
    of = lambda m: F.max(F.when(F.col("model") == m, F.abs(F.col("y_true") - F.col("y_pred"))))
    return rows.groupBy(*keys).agg((of(model) - of(ref)).alias("d")).where("d is not null")


def compare(records: DataFrame, model: str, ref: str) -> DataFrame:
    """h, d_mae and the share of series on which model wins."""
    by_series = differences(records, model, ref).groupBy("h", "territory_id", "category").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    return by_series.groupBy("h").agg((F.sum("s") / F.sum("n")).alias("d_mae"), F.avg((F.col("s") < 0).cast("double")).alias("win_share"))


#: Clusters of a bucket in which ranks are given, and draws of a row from which they are exploded.
RANKED, DRAWN = 1024, 4096


def ranked_clusters(clusters: DataFrame, by: str, key: str) -> DataFrame:
    """clusters, unique by (by, key), with rank from 0 within by, and size, the clusters of by.

    Ranks are given within buckets of about RANKED clusters and moved on by the sizes of the buckets before, so no task sorts all.
    """
    sizes = clusters.groupBy(by).agg(F.count("*").alias("size"))
    rows = clusters.join(sizes, by).withColumn("_b", F.pmod(F.xxhash64(key), F.ceil(F.col("size") / RANKED)))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(by, "_b").agg(F.count("*").alias("_n")).select(by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_b").orderBy(key)) - 1
    return rows.withColumn("_own", own).join(offsets, [by, "_b"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_b", "_own", "_before")


def resample_counts(sizes: DataFrame, by: str, draws: int) -> DataFrame:
    """by, draw, rank, w: how often each rank is drawn when size of them are drawn with replacement, draws times; ranks never drawn are left out.

    A pick is the MD5 of (by, draw, number) modulo size, so that it doesn't depend on where it is computed.
    """
    each = sizes.select(by, "size", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    each = each.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(DRAWN).cast("long"))))
    each = each.withColumn("_j", F.explode(F.sequence("_from", F.least(F.col("_from") + DRAWN, F.col("size")) - 1)))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", by, "draw", "_j")), 1, 13), 16, 10).cast("long")
    return each.groupBy(by, "draw", (number % F.col("size")).alias("rank")).agg(F.count("*").alias("w"))


def cluster_bootstrap(records: DataFrame, model: str, ref: str, draws: int = 500) -> DataFrame:
    """h, ci_low, ci_high of d_mae: of each draw as many territories with replacement as there are."""
    by_cluster = differences(records, model, ref).groupBy("h", "territory_id").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    ranked = ranked_clusters(by_cluster, "h", "territory_id")
    counts = resample_counts(ranked.select("h", "size").distinct(), "h", draws)
    rows = counts.join(ranked.select("h", "rank", "s", "n"), ["h", "rank"])
    mean = rows.groupBy("h", "draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return mean.groupBy("h").agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))


def interval_coverage(records: DataFrame, by: tuple = ("category", "h")) -> DataFrame:
    """h, n, cover80, cover90: quantiles of log errors at the earlier half of origins, tried on the later half."""
    rows = core(records).where("y_true > 0 and y_pred > 0").withColumn("r", F.log(F.col("y_true") / F.col("y_pred")))
    origins = rows.select("h", "origin").distinct()
    origins = origins.withColumn("_k", F.row_number().over(Window.partitionBy("h").orderBy("origin"))).withColumn("_n", F.count("*").over(Window.partitionBy("h")))
    rows = rows.join(origins, ["h", "origin"]).where("_n >= 2").withColumn("early", F.col("_k") <= F.floor(F.col("_n") / 2))
    q = rows.where("early").groupBy(*by).agg(F.percentile("r", F.array(*map(F.lit, (0.05, 0.1, 0.9, 0.95)))).alias("q"))
    late = rows.where("not early").join(q, list(by), "left")
    inside = lambda a, b: F.avg(F.coalesce((F.col("r") >= F.col("q")[a]) & (F.col("r") <= F.col("q")[b]), F.lit(False)).cast("double"))
    return late.groupBy("h").agg(F.count("*").alias("n"), inside(1, 2).alias("cover80"), inside(0, 3).alias("cover90"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return middle - half, middle + half


def top_share_alarms(scores: DataFrame, budget: float, by: list[str]) -> DataFrame:
    """alarm: whether the score is above the quantile 1 - budget of its group."""
    rows = with_grouped_quantile(scores, by, "score", 1 - budget, "_limit")
    return rows.withColumn("alarm", F.coalesce(F.col("score") > F.col("_limit"), F.lit(False))).drop("_limit")


def event_hits(alarms: DataFrame, events: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """events (territory_id, month) with hit: an alarm of the territory from before months earlier to after months later."""
    on = alarms.where("alarm").select("territory_id", F.col("month").alias("_at"), F.lit(True).alias("_on")).distinct()
    near = events.select("territory_id", "month").distinct().withColumn("_at", F.explode(F.transform(F.sequence(F.lit(-before), F.lit(after)), lambda i: F.add_months("month", i))))
    return near.join(on, ["territory_id", "_at"], "left").groupBy("territory_id", "month").agg(F.coalesce(F.max("_on"), F.lit(False)).alias("hit"))


#: Ranges that sums over sorted scores are cut into.
RANGES = 256


def distinct_scores(rows: DataFrame, score: str, label: str) -> DataFrame:
    """s, n, p, before_n, before_p: rows and positives of each distinct score, and those of all smaller ones.

    Scores are dealt into ranges by approximate percentiles; sums within a range and over the ranges before
    are exact, and no range but that of one frequent score is large.
    """
    each = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    edges = each.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_edges"))
    each = each.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("s")))).drop("_edges")
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = each.groupBy("_range").agg(F.sum("n").alias("_n"), F.sum("p").alias("_p")).select("_range", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_p").over(w), F.lit(0)).alias("_bp"))
    inside = Window.partitionBy("_range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = each.withColumns({"_in": F.coalesce(F.sum("n").over(inside), F.lit(0)), "_ip": F.coalesce(F.sum("p").over(inside), F.lit(0))})
    return rows.join(F.broadcast(sums), "_range").select("s", "n", "p", (F.col("_bn") + F.col("_in")).alias("before_n"), (F.col("_bp") + F.col("_ip")).alias("before_p"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by mean ranks, and the counts of both labels."""
    each = distinct_scores(rows, score, label)
    total = each.agg(F.sum(F.col("p") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("r"), F.sum("p").alias("positives"), (F.sum("n") - F.sum("p")).alias("negatives"))
    return total.select(((F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2) / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def lift_by_quartile(rows: DataFrame, x: str, event: str, alarm: str, key: str = "territory_id") -> DataFrame:
    """quartile (0: all), n, lift: the alarm rate given the event over that without it, by quartile of x.

    Quartiles are of key's ranks by x, ties by key: edges are the percentiles of the ranks 1 to n, linear between
    them, so a key is in the first quartile whose edge isn't below its rank.
    """
    keys = rows.select(key, x).distinct()
    ranked = distinct_scores(keys.withColumn("_one", F.lit(1)), x, "_one").select(F.col("s").alias(x), F.col("before_n").alias("_before"))
    rank = F.row_number().over(Window.partitionBy(x).orderBy(key)) + F.col("_before")
    n = keys.agg(F.count("*").alias("_n"))
    edge = lambda q: 1 + q / 4 * (F.col("_n") - 1)
    quartile = 1 + sum(((F.col("_rank") > edge(q)).cast("int") for q in (1, 2, 3)), F.lit(0))
    quarters = keys.join(ranked, x).withColumn("_rank", rank).crossJoin(F.broadcast(n)).select(key, quartile.alias("quartile"))
    rate = lambda on: F.avg(F.when(F.col(event) == F.lit(on), F.col(alarm).cast("double")))
    out = rows.join(quarters, key).rollup("quartile").agg(F.count("*").alias("n"), rate(True).alias("_with"), rate(False).alias("_without"))
    return out.select(F.coalesce("quartile", F.lit(0)).alias("quartile"), "n", F.when(F.col("_without") > 0, F.col("_with") / F.col("_without")).alias("lift"))


def largest_gap(accuracy: DataFrame, by: list[str]) -> DataFrame:
    """model, max_gap: the largest excess, in percent, of a model's mae over the best of its group."""
    best = F.min("mae").over(Window.partitionBy(*by))
    gap = accuracy.withColumn("_gap", 100 * (F.col("mae") / F.when(best > 0, best) - 1))
    return gap.groupBy("model").agg(F.round(F.max("_gap"), 4).alias("max_gap"))


def reproducibility(new: DataFrame, old: DataFrame) -> DataFrame:
    """h, n, worst, middle: relative differences of two runs' forecasts of the same points."""
    keys = ["territory_id", "category", "origin", "h"]
    both = new.select(*keys, F.col("y_pred").alias("_new")).join(old.select(*keys, F.col("y_pred").alias("_old")), keys).where("_old <> 0")
    rel = F.abs(F.col("_new") / F.col("_old") - 1)
    return both.groupBy("h").agg(F.count(rel).alias("n"), F.max(rel).alias("worst"), F.median(rel).alias("middle"))


def by_shock(records: DataFrame, marks: DataFrame) -> DataFrame:
    """model, h, shock, mae, mape, n; marks: territory_id, category, target, shock."""
    rows = core(records).join(marks, ["territory_id", "category", "target"])
    error = F.abs(F.col("y_true") - F.col("y_pred"))
    return rows.groupBy("model", "h", "shock").agg(F.avg(error).alias("mae"), (100 * F.avg(error / F.when(F.col("y_true") != 0, F.col("y_true")))).alias("mape"), F.count("*").alias("n"))


def last_before(rows: DataFrame, dates: list[str], at: str, name: str) -> DataFrame:
    """rows with the last of a few dates that isn't after column at; null before the first."""
    known = F.array(*[F.lit(d).cast("date") for d in dates])
    return rows.withColumn(name, F.array_max(F.filter(known, lambda d: d <= F.col(at))))


def precision_curve(rows: DataFrame, score: str, label: str, top: float = 0.05) -> DataFrame:
    """average_precision, and precision, recall and lift of the share top of rows with the highest scores.

    Scores are reduced to distinct values; precision at each is taken over all rows with as much or more.
    """
    each = distinct_scores(rows, score, label)
    total = each.agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    limit = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.percentile(score, F.lit(1 - top)).alias("_limit"))
    each = each.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(limit))  # one row each
    up = F.col("_p") - F.col("before_p"), F.col("_n") - F.col("before_n")
    high = F.col("s") >= F.col("_limit")
    out = each.agg(F.sum(F.col("p") * up[0] / up[1]).alias("_ap"), F.sum(F.when(high, F.col("p"))).alias("_hp"), F.sum(F.when(high, F.col("n"))).alias("_hn"), F.first("_p").alias("_p"), F.first("_n").alias("_n"))
    precision = F.col("_hp") / F.col("_hn")
    return out.select((F.col("_ap") / F.col("_p")).alias("average_precision"), precision.alias("precision_top"), (F.col("_hp") / F.col("_p")).alias("recall_top"), (precision / (F.col("_p") / F.col("_n"))).alias("lift_top"))


# Alarms against events


def budget_alarms(scores: DataFrame, since: str, far: float = 0.02, reference: str = "panel") -> DataFrame:
    """budget, detector, territory_id, month, alarm in the months from since on, under three budgets.

    series: scores above the quantile 1 - far of all of the detector's. mo: a territory's best score above the
    quantile that gives as many territory-months an alarm as the reference detector has by series. mo_month:
    the same share in each month. scores: detector, territory_id, category, month, score.
    """
    late = scores.where(F.col("month") >= since)
    over = lambda limit: F.coalesce(F.col("score") > limit, F.lit(False))
    limits = late.groupBy("detector").agg(F.percentile("score", F.lit(1 - far)).alias("_limit"))
    series = late.join(F.broadcast(limits), "detector").groupBy("detector", "territory_id", "month").agg(F.max(over(F.col("_limit"))).alias("alarm"))
    share = series.where(F.col("detector") == reference).agg(F.avg(F.col("alarm").cast("double"))).first()[0]
    best = late.groupBy("detector", "territory_id", "month").agg(F.max("score").alias("score"))
    if share is None:
        return series.select(F.lit("series").alias("budget"), "detector", "territory_id", "month", "alarm")
    each = {"series": series}
    for name, by in (("mo", ["detector"]), ("mo_month", ["detector", "month"])):
        limits = best.groupBy(*by).agg(F.percentile("score", F.lit(1 - share)).alias("_limit"))
        each[name] = best.join(F.broadcast(limits), by).withColumn("alarm", over(F.col("_limit"))).drop("score", "_limit")
    out = [x.select(F.lit(name).alias("budget"), "detector", "territory_id", "month", "alarm") for name, x in each.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def hit_rates(alarms: DataFrame, events: DataFrame, last: str, lags: tuple = (-1, 0, 1, 2)) -> DataFrame:
    """budget, detector, base_rate, hit_1_before, hit_0, ..., hit_window and lift: alarms in the months around events.

    events: territory_id, month. A lag past the last month doesn't count. Events and alarms meet by territory and month.
    """
    base = alarms.groupBy("budget", "detector").agg(F.avg(F.col("alarm").cast("double")).alias("base_rate"))
    asked = events.select("territory_id", "month").distinct().withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("at", F.add_months("month", F.col("lag"))).where(F.col("at") <= F.lit(last).cast("date"))
    runs = F.broadcast(alarms.select("budget", "detector").distinct())
    on = alarms.where("alarm").select("budget", "detector", "territory_id", F.col("month").alias("at"), F.lit(1).alias("_on"))
    met = asked.crossJoin(runs).join(on, ["budget", "detector", "territory_id", "at"], "left").withColumn("_hit", F.coalesce("_on", F.lit(0)))  # a few runs
    by_event = met.groupBy("budget", "detector", "territory_id", "month").agg(F.max("_hit").alias("_any"))
    window = by_event.groupBy("budget", "detector").agg(F.avg("_any").alias("hit_window"))
    name = lambda x: f"hit_{-x}_before" if x < 0 else f"hit_{x}"
    each = met.groupBy("budget", "detector").agg(*[F.avg(F.when(F.col("lag") == x, F.col("_hit"))).alias(name(x)) for x in lags])
    return base.join(each, ["budget", "detector"]).join(window, ["budget", "detector"]).withColumn("lift", F.col("hit_0") / F.when(F.col("base_rate") > 0, F.col("base_rate")))


def registry_hits(alarms: DataFrame, registry: DataFrame) -> DataFrame:
    """budget, detector, cases, hits: cases (territory_id, month) with an alarm in their month or the next."""
    near = registry.select("territory_id", "month").distinct().withColumn("at", F.explode(F.array(F.col("month"), F.add_months("month", 1))))
    runs = F.broadcast(alarms.select("budget", "detector").distinct())
    on = alarms.where("alarm").select("budget", "detector", "territory_id", F.col("month").alias("at"), F.lit(1).alias("_on"))
    met = near.crossJoin(runs).join(on, ["budget", "detector", "territory_id", "at"], "left")  # a few runs
    cases = met.groupBy("budget", "detector", "territory_id", "month").agg(F.max(F.coalesce("_on", F.lit(0))).alias("_hit"))
    return cases.groupBy("budget", "detector").agg(F.count("*").alias("cases"), F.sum("_hit").alias("hits"))


def displaced_share(alarms: DataFrame, reference: str) -> DataFrame:
    """detector, displaced: the share of the reference detector's alarms that another one doesn't raise."""
    own = alarms.where((F.col("detector") == reference) & F.col("alarm")).select("territory_id", "month")
    others = alarms.where(F.col("detector") != reference)
    return others.join(own, ["territory_id", "month"]).groupBy("detector").agg(F.avg((~F.col("alarm")).cast("double")).alias("displaced"))


def explained_alarms(scores: DataFrame, limit: DataFrame, major: DataFrame) -> DataFrame:
    """Of each territory and month with a score above the limit the highest one, with explained: whether a major incident falls there.

    scores: territory_id, category, month, score; limit: one row, limit; major: territory_id, month.
    """
    w = Window.partitionBy("territory_id", "month").orderBy(F.desc("score"), "category")
    high = scores.crossJoin(F.broadcast(limit)).where("score > limit").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "limit")
    known = major.select("territory_id", "month", F.lit(True).alias("_m")).distinct()
    return high.join(known, ["territory_id", "month"], "left").withColumn("explained", F.coalesce("_m", F.lit(False))).drop("_m")


def alarms_by_month(alarms: DataFrame, first: str, last: str) -> DataFrame:
    """month, alarms, explained for every month from first to last."""
    months = alarms.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    counts = alarms.groupBy("month").agg(F.count("*").alias("alarms"), F.count_if("explained").alias("explained"))
    return months.join(counts, "month", "left").na.fill(0, ["alarms", "explained"])


def warning_table(scores: DataFrame, limit: DataFrame, region_of: DataFrame, nowcast: bool = False) -> DataFrame:
    """territory_id, month, alarm, score, others (the alarm share of the region's other territories), y_next.

    y_next is the next month's alarm; with nowcast it is the month's own, and the rest is a month old.
    scores: territory_id, category, month, score; limit: one row, limit.
    """
    rows = scores.crossJoin(F.broadcast(limit)).groupBy("territory_id", "month").agg(F.max(F.coalesce(F.col("score") > F.col("limit"), F.lit(False)).cast("double")).alias("alarm"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    rows = rows.join(region_of, "territory_id")
    group, own = Window.partitionBy("region_code", "month"), Window.partitionBy("territory_id").orderBy("month")
    rows = rows.withColumn("others", (F.sum("alarm").over(group) - F.col("alarm")) / F.greatest(F.count("*").over(group) - 1, F.lit(1)))
    if nowcast:
        return rows.withColumn("y_next", F.col("alarm")).withColumns({c: F.lag(c).over(own) for c in ("alarm", "score", "others")})
    return rows.withColumn("y_next", F.lead("alarm").over(own))
