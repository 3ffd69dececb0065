"""Semi-synthetic shocks and how detectors fare on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.panel import SERIES

TYPES = ("step", "dip", "ramp", "spike")


def uniform(seed: int, what: str, *keys: str) -> Column:
    """A number in 0 to 1 that depends on keys alone."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def drawn(keys: DataFrame, by: tuple, first: int, last: int, seed: int, least: float, most: float) -> DataFrame:
    """keys with t (month number from first to last), type, size and length, drawn by the columns by; most are falls."""
    u = lambda what: uniform(seed, what, *by)
    size = (least + (most - least) * u("size")) * F.when(u("sign") < 0.3, 1).otherwise(-1)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.floor(u("type") * len(TYPES)) + 1).cast("int"))
    return keys.select("*", (first + F.floor(u("t") * (last - first + 1))).cast("int").alias("t"), kind.alias("type"), size.alias("size"), (1 + F.floor(u("length") * 2)).cast("int").alias("length"))


def draw_shocks(rows: DataFrame, keys: tuple, first: int, last: int, share: float, seed: int, least: float = 0.1, most: float = 0.3) -> DataFrame:
    """A local shock for the share of keys."""
    chosen = rows.select(*keys).distinct().where(uniform(seed, "chosen", *keys) < share)
    return drawn(chosen, keys, first, last, seed, least, most)


def draw_regional(rows: DataFrame, categories: list[str], first: int, last: int, share: float, seed: int, least: float = 0.1, most: float = 0.3) -> DataFrame:
    """One shock for all territories of the share of regions, in one category each: territory_id, category, t, type, size, length."""
    hit = rows.select("region_code").distinct().where(uniform(seed, "chosen", "region_code") < share)
    named = F.element_at(F.array(*map(F.lit, categories)), (F.floor(uniform(seed, "category", "region_code") * len(categories)) + 1).cast("int"))
    made = drawn(hit.withColumn("category", named), ("region_code",), first, last, seed, least, most)
    return rows.select("territory_id", "region_code", "category").distinct().join(made, ["region_code", "category"]).drop("region_code")


def inject(dense: DataFrame, shocks: DataFrame, keys: tuple, first: str) -> DataFrame:
    """dense with y multiplied by each shock's path from its month on."""
    rows = dense.withColumn("_m", F.months_between("month", F.lit(first).cast("date")).cast("int")).join(shocks, list(keys), "left")
    since, s = F.col("_m") - F.col("t"), F.col("size")
    ramp = 1 + s * F.least(since + 1, F.lit(3)) / 3
    path = F.when(F.col("type") == "step", 1 + s).when(F.col("type") == "ramp", ramp).when((F.col("type") == "dip") & (since < F.col("length")), 1 + s).when((F.col("type") == "spike") & (since == 0), 1 + s)
    factor = F.coalesce(F.when(since >= 0, path), F.lit(1.0))
    return rows.withColumn("y", F.col("y") * factor).drop("_m", "t", "type", "size", "length")


def false_alarm_threshold(scores: DataFrame, rate: float = 0.02) -> DataFrame:
    """detector, threshold: the quantile 1 - rate of the clean rows' scores."""
    return scores.where("clean and score is not null").groupBy("detector").agg(F.percentile("score", F.lit(1 - rate)).alias("threshold"))


def evaluate(scores: DataFrame, shocks: DataFrame, thresholds: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """recall, precision, f1, delay, false_alarms by detector.

    scores: detector, series keys, m (month number), score, clean. A shock is found if its series alarms from
    before months earlier to after later; precision counts the alarms of all series.
    """
    rows = scores.join(F.broadcast(thresholds), "detector").withColumn("alarm", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))
    met = rows.join(shocks, list(SERIES), "left").withColumn("inside", F.coalesce(F.col("alarm") & F.col("m").between(F.col("t") - before, F.col("t") + after), F.lit(False)))
    by_shock = met.where("t is not null").groupBy("detector", *SERIES, "t").agg(F.min(F.when(F.col("inside"), F.col("m"))).alias("first"))
    found = by_shock.groupBy("detector").agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg(F.when(F.col("first").isNotNull(), F.greatest(F.lit(0), F.col("first") - F.col("t")))).alias("delay"), F.count("*").alias("n_shocks"))
    alarms = met.groupBy("detector").agg((F.sum(F.col("inside").cast("int")) / F.greatest(F.sum(F.col("alarm").cast("int")), F.lit(1))).alias("precision"), (100 * F.avg(F.when(F.col("clean"), F.col("alarm").cast("double")))).alias("false_alarms"))
    p, r = F.col("precision"), F.col("recall")
    return found.join(alarms, "detector").withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
