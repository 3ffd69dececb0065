"""Readers with explicit schemas, and the adapter from the star schema to the spending panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast import schemas


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spending(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of territory, category, date 'YYYY-MM' and value as territory_id, category, month, y."""
    rows = spark.read.schema(schemas.SPENDING).parquet(path)
    return rows.select("territory_id", "category", F.to_date(F.concat("date", F.lit("-01"))).alias("month"), F.nanvl("value", F.lit(None).cast("double")).alias("y"))


def separator(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon, tab and bar in the first line of a CSV."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return max(",;\t|", key=line.count)


def read_periodic(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """CSV of period, name and value: month, day, name, value. Names are trimmed, bad numbers null; the separator is found if not given."""
    rows = spark.read.schema(schemas.PERIODIC).option("header", True).option("sep", sep or separator(spark, path)).csv(path)
    day = F.to_date("period")
    return rows.select(F.trunc(day, "MM").alias("month"), day.alias("day"), F.trim("name").alias("name"), "value")


def read_wide(spark: SparkSession, path: str, names: dict[str, str], by: str = "month", sep: str | None = None) -> DataFrame:
    """read_periodic with a column for each of names (name -> column), repeats averaged."""
    return read_periodic(spark, path, sep).groupBy(by).pivot("name", list(names)).agg(F.avg("value")).withColumnsRenamed(names)


def read_rates(spark: SparkSession, path: str, nominal: str, real: str) -> DataFrame:
    """CSV of period, kind and value: month, key_rate, real_rate."""
    of = lambda kind: F.avg(F.when(F.col("name") == kind, F.col("value")))
    return read_periodic(spark, path).groupBy("month").agg(of(nominal).alias("key_rate"), of(real).alias("real_rate"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """CSV of territory_id, lat, lon."""
    return spark.read.schema(schemas.POINTS).option("header", True).csv(path)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """The columns of the weather table that become features."""
    return spark.read.schema(schemas.WEATHER).parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon CSV with a byte-order mark; Spark drops the mark with the header line."""
    return spark.read.schema(schemas.LABELS).option("header", True).option("sep", ";").option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


#: Entities of a message whose text is a link, not prose.
LINKS = ("link", "text_link", "mention", "hashtag", "custom_emoji")


def read_export(spark: SparkSession, path: str, channel: str, lines: bool = False) -> DataFrame:
    """A channel's JSON export: channel, msg_id, text, published_msk, month; only real messages, links left out.

    An export is one object; with lines it is cut into one for each line, so that it can be read in parallel.
    """
    each = spark.read.schema(schemas.EXPORT).option("multiLine", not lines).json(path).select(F.explode("messages").alias("m")).where("m.type = 'message'")
    prose = F.filter("m.text_entities", lambda e: ~e["type"].isin(*LINKS))
    rows = each.select(F.lit(channel).alias("channel"), F.col("m.id").alias("msg_id"), F.array_join(prose["text"], "").alias("text"), F.from_utc_timestamp(F.timestamp_seconds(F.col("m.date_unixtime").cast("long")), "Europe/Moscow").cast("timestamp_ntz").alias("published_msk"))
    return rows.withColumn("month", F.trunc(F.to_date("published_msk"), "MM"))


def read_parts(spark: SparkSession, pattern: str, without: str | None = None, key: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """Parquet files of a glob, less those whose name holds a word; of rows with equal key the first by the columns first."""
    rows = spark.read.parquet(pattern)
    if without:
        rows = rows.where(~F.col("_metadata.file_path").contains(without))
    if key:
        w = Window.partitionBy(*key).orderBy(*(first or rows.columns))
        rows = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return rows


FIRST, LAST = "1995-01-01", "2001-07-01"


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """territory_id, region_code, category, month, y, n_orders: orders as spending of nations by segment.

    The one sparse month at the end is left out. Sums are rounded to cents, so they don't depend on order.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    orders = orders.where((F.col("day") >= FIRST) & (F.col("day") < F.add_months(F.lit(LAST).cast("date"), 1)))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("territory_id"), F.col("c_mktsegment").alias("category"), F.trunc("day", "MM").alias("month"))
    rows = rows.agg(F.round(F.sum("o_totalprice"), 2).alias("y"), F.count("*").alias("n_orders"))
    return rows.join(nations, F.col("territory_id") == F.col("n_nationkey")).select("territory_id", F.col("n_regionkey").alias("region_code"), "category", "month", "y", "n_orders")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as located messages of one month: channel, msg_id, territory_id, region_code, event_type, published, day, severity."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("c"), F.pmod("event_id", F.lit(3)).cast("string")).alias("channel"),
        F.col("event_id").alias("msg_id"),
        F.pmod("user_id", F.lit(25)).cast("int").alias("territory_id"),
        F.pmod("user_id", F.lit(5)).cast("int").alias("region_code"),
        "event_type",
        F.col("ts").alias("published"),
        F.to_date("ts").alias("day"),
        F.least(F.greatest(F.floor(F.col("value") / 25), F.lit(0)), F.lit(3)).cast("int").alias("severity"),
    )
