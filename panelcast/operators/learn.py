"""Boosted trees of Spark ML over features that are column expressions: forecast correction and early warning."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.panel import SERIES

FEATURES = ("category_no", "region_code", "log_y", "mom1", "mom3", "yoy", "mom1_rel", "res1", "res1_m3", "hist", "h", "moy", "base_growth")


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with features; missing ones are -9, a value that no feature takes."""
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows.na.fill(-9.0, names))


def correction_rows(dense: DataFrame, base: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Rows of base (series, origin, h, target, y_pred) with the features known at the origin, and the features' names.

    res1 is the last one-step error, res1_m3 the mean of the last three; mom1_rel is the last change less its
    median in the category and region. more: territory_id, month and exogenous features.
    """
    w = Window.partitionBy(*SERIES).orderBy("month")
    y = F.when(F.col("y") > 0, F.log("y"))
    one = base.where("h = 1").select(*SERIES, F.col("target").alias("month"), F.when(F.col("y_pred") > 0, F.log("y_pred")).alias("_p"))
    rows = dense.select(*SERIES, "region_code", "month", y.alias("log_y")).join(one, [*SERIES, "month"], "left")
    rows = rows.withColumns({
        "mom1": F.col("log_y") - F.lag("log_y").over(w), "mom3": F.col("log_y") - F.lag("log_y", 3).over(w), "yoy": F.col("log_y") - F.lag("log_y", 12).over(w),
        "res1": F.col("log_y") - F.col("_p"), "hist": F.row_number().over(w).cast("double"),
    })
    rows = rows.withColumn("res1_m3", F.avg("res1").over(w.rowsBetween(-2, 0))).withColumn("mom1_rel", F.col("mom1") - F.median("mom1").over(Window.partitionBy("category", "region_code", "month")))
    rows = rows.drop("region_code", "_p").withColumnRenamed("month", "origin")
    if more is not None:
        rows = rows.join(more.withColumnRenamed("month", "origin"), ["territory_id", "origin"], "left")
    names = [*FEATURES, *[c for c in (more.columns if more is not None else []) if c not in ("territory_id", "month")]]
    category = F.pmod(F.crc32("category"), F.lit(997)).cast("double")
    out = base.join(rows, [*SERIES, "origin"]).withColumns({"category_no": category, "moy": F.month("target"), "base_growth": F.log("y_pred") - F.col("log_y")})
    return out.withColumns({c: F.col(c).cast("double") for c in names}), names


def corrected(dense: DataFrame, base: DataFrame, retrain: list[str], origins: list[str], more: DataFrame | None = None, look_back: int = 12, trees: int = 20, seed: int = 0) -> DataFrame:
    """base at origins with y_pred corrected by boosted trees, trained at each date of retrain on what was known then.

    The target is the log error less its median over category and horizon; rows weigh as much as their y. An origin takes the
    last model at or before it, and horizons beyond the trained ones stay as they are.
    """
    rows, names = correction_rows(dense, base, more)
    truth = dense.select(*SERIES, F.col("month").alias("target"), F.col("y").alias("y_true"))
    out, last = [], None
    asked = rows.where(F.col("origin").isin([*origins]))
    for date, until in zip(sorted(retrain), [*sorted(retrain)[1:], "9999-12-01"], strict=True):
        known = rows.where((F.col("origin") >= F.add_months(F.lit(date).cast("date"), -look_back)) & (F.col("target") <= date)).join(truth, [*SERIES, "target"]).where("y_true > 0 and y_pred > 0 and log_y is not null")
        error = F.log(F.col("y_true") / F.col("y_pred"))
        known = known.withColumn("_e", error - F.median(error).over(Window.partitionBy("category", "h", "origin")))
        own = asked.where((F.col("origin") >= date) & (F.col("origin") < until))
        if last is None:
            out.append(asked.where(F.col("origin") < date).select(*base.columns))
        top = known.agg(F.max("h")).first()[0]
        if top is None:
            out.append(own.select(*base.columns))
            continue
        last = GBTRegressor(labelCol="_e", weightCol="y_true", lossType="absolute", maxDepth=4, maxIter=trees, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(assembled(known, names))
        made = last.transform(assembled(own, names)).withColumn("y_pred", F.when(F.col("h") <= top, F.col("y_pred") * F.exp("prediction")).otherwise(F.col("y_pred")))
        out.append(made.select(*base.columns))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def early_warning(table: DataFrame, sets: dict[str, list[str]], train_until: str, test_from: str, trees: int = 20, seed: int = 0) -> DataFrame:
    """territory_id, month, y_next, features and p: the chance of a shock by boosted trees on each set of features, in the later months."""
    rows = table.where("y_next is not null").withColumn("y_next", F.col("y_next").cast("double"))
    out = []
    for name, columns in sets.items():
        model = GBTClassifier(labelCol="y_next", maxDepth=3, maxIter=trees, stepSize=0.1, subsamplingRate=0.8, seed=seed).fit(assembled(rows.where(F.col("month") <= train_until), columns))
        scored = model.transform(assembled(rows.where(F.col("month") >= test_from), columns))
        out.append(scored.select("territory_id", "month", "y_next", F.lit(name).alias("features"), vector_to_array("probability")[1].alias("p")))
    made = out[0]
    for part in out[1:]:
        made = made.unionByName(part)
    return made
