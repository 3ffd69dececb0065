"""Registry of queries and their DuckDB SQL, and the frames over the star schema that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import forecast, panel
from panelcast.sources.tables import FIRST, LAST, spending

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Series of the star schema count as complete from this many months on; groups as large from this many series on.
COMPLETE, LARGE = 60, 10
BACKTEST, LAG_START = "2000-07-01", "1996-01-01"
SERIES = ["territory_id", "category"]


def register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:  # a part that starts with a comma continues the list of common table expressions
            ORACLE_SQL[f.__name__] = sql.replace(")\n\n,", "),").replace(")\n,", "),")
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return panel.with_completeness(panel.densify(spending(spark, sf), FIRST, LAST), COMPLETE)


MODELS = ("naive", "snaive", "snaive_growth")


def records(spark: SparkSession, sf: str, models: tuple = MODELS, first: str = BACKTEST, complete: int = COMPLETE) -> DataFrame:
    """Forecast records of the named models at the origins from first on."""
    d = panel.with_completeness(panel.densify(spending(spark, sf), FIRST, LAST), complete)
    asked = forecast.targets(d, first, LAST)
    made = {"naive": lambda: forecast.naive(d, asked), "snaive": lambda: forecast.seasonal_naive(d, asked), "snaive_growth": lambda: forecast.seasonal_growth(d, asked, more_than=LARGE)}
    return forecast.records(d, {m: made[m]() for m in models})


def residual(spark: SparkSession, sf: str) -> DataFrame:
    """Log residuals of the seasonal naive one-step forecast."""
    w = panel.over_time()
    lag = F.lag("y", 12).over(w)
    rows = dense(spark, sf).withColumn("e", F.when((F.col("y") > 0) & (lag > 0), F.log("y") - F.log(lag)))
    return rows.where(F.col("month") >= LAG_START).select("territory_id", "region_code", "category", "month", "e")


def scored(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*SERIES, "month", F.round("score", digits).alias("score"))
