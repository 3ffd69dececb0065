"""Frames over the star schema that stand for territories, news and weather, and the same as DuckDB SQL.

The star schema has none of these: nations are territories, regions their regions, suppliers settlements,
customers people, events messages whose texts come from a few phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.text import LOCAL_EVENTS, NATIONAL_EVENTS, stemmed
from panelcast.sources.tables import table

KINDS = ("городской округ", "муниципальный район", "муниципальный округ", "внутригородская территория")
STATES = ("административный центр", "ЗАТО")
MERGED = {5: 4321.0, 11: 1234.0}


def array(values: tuple):
    return F.array(*map(F.lit, values))


def territories(spark: SparkSession, sf: str) -> DataFrame:
    n, k = table(spark, sf, "nation"), F.col("n_nationkey")
    return n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("territory_id"), F.col("n_regionkey").alias("region_code"), F.lower("r_name").alias("region_name"),
        F.concat(F.lit("Округ "), F.initcap("n_name")).alias("name"), F.initcap("n_name").alias("name_short"),
        F.element_at(array(KINDS), k % 4 + 1).alias("mo_type"), F.when(k % 5 < 2, F.element_at(array(STATES), k % 5 + 1)).alias("mo_status"),
        F.when(k % 3 > 0, 50.0 + k).alias("lat"), F.when(k % 3 > 0, 30.0 + 2 * k).alias("lon"),
        F.lpad((k * 1000).cast("string"), 8, "0").alias("code"), F.lit(2010).alias("year_from"), F.when(k % 7 == 6, 2020).otherwise(9999).alias("year_to"),
    )


TERRITORIES = f"""
terr AS (SELECT n_nationkey AS territory_id, n_regionkey AS region_code, lower(r_name) AS region_raw, n_name,
  [{", ".join(f"'{k}'" for k in KINDS)}][n_nationkey % 4 + 1] AS mo_type, CASE n_nationkey % 5 WHEN 0 THEN '{STATES[0]}' WHEN 1 THEN '{STATES[1]}' END AS mo_status,
  CASE WHEN n_nationkey % 3 > 0 THEN 50.0::DOUBLE + n_nationkey END AS lat, CASE WHEN n_nationkey % 3 > 0 THEN 30.0::DOUBLE + 2 * n_nationkey END AS lon,
  lpad(CAST(n_nationkey * 1000 AS VARCHAR), 8, '0') AS code, CASE WHEN n_nationkey % 7 = 6 THEN 2020 ELSE 9999 END AS year_to
  FROM nation JOIN region ON n_regionkey = r_regionkey)
"""

#: A hexagon with uneven sides around each territory's centre.
OFFSETS = ((4.5, 0.0), (1.5, 2.5), (-2.25, 4.0), (-3.0, 0.0), (-2.25, -4.0), (1.5, -2.5))


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = 10.0 * (k % 5) + 5.0, 10.0 * F.floor(k / 5) + 5.0
    ring = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in OFFSETS])
    return table(spark, sf, "nation").select(k.alias("territory_id"), ring.alias("ring"))


def points(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    return table(spark, sf, name).select("*", ((k * 37 % 5000) / 100.0).alias("x"), ((k * 91 % 5000) / 100.0).alias("y"))


def within_sql(name: str, key: str) -> str:
    corners = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(OFFSETS))
    return f"""
corner(i, ox, oy) AS (VALUES {corners}),
pts AS (SELECT {key} AS id, {key} * 37 % 5000 / 100.0::DOUBLE AS x, {key} * 91 % 5000 / 100.0::DOUBLE AS y FROM {name}),
edge AS (SELECT n_nationkey AS territory_id, 10.0::DOUBLE * (n_nationkey % 5) + 5.0 + a.ox AS ax, 10.0::DOUBLE * (n_nationkey // 5) + 5.0 + a.oy AS ay, 10.0::DOUBLE * (n_nationkey % 5) + 5.0 + b.ox AS bx, 10.0::DOUBLE * (n_nationkey // 5) + 5.0 + b.oy AS by_
  FROM nation CROSS JOIN corner a JOIN corner b ON b.i = (a.i + 1) % {len(OFFSETS)}),
placed AS (SELECT id, min(territory_id) AS territory_id FROM (
  SELECT id, territory_id, count(*) AS crossings FROM pts JOIN edge ON (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY ALL) WHERE crossings % 2 = 1 GROUP BY ALL)
"""


TYPES = (*LOCAL_EVENTS,)
NATIONAL = (*NATIONAL_EVENTS,)
FIRST_NEWS, LAST_NEWS = "2022-01-01", "2024-12-01"


def news_events(spark: SparkSession, sf: str) -> DataFrame:
    """channel, msg_id, published, day, month, event_type, scope, level, territory_id, region_code, severity over three years."""
    e, k, place = table(spark, sf, "events"), F.col("event_id"), (F.col("user_id") % 25).cast("int")
    rows = e.join(table(spark, sf, "nation"), place == F.col("n_nationkey"))
    published = F.expr("ts + make_ym_interval(0, cast(event_id % 36 - 24 as int))")
    national, far, wide = k % 10 == 0, k % 7 == 0, k % 7 < 3
    rows = rows.select(
        F.concat(F.lit("c"), (k % 3).cast("string")).alias("channel"), F.floor(k / 2).alias("msg_id"), published.alias("published"),
        F.when(national, F.element_at(array(NATIONAL), (k % 6 + 1).cast("int"))).otherwise(F.element_at(array(TYPES), ((k * 7 + F.col("user_id")) % 14 + 1).cast("int"))).alias("event_type"),
        F.when(national, "national").otherwise("local").alias("scope"), F.when(national, "national").when(far, "unresolved").when(wide, "region").otherwise("mo").alias("level"),
        F.when(~national & ~wide, place).alias("territory_id"), F.when(~national & ~far, F.col("n_regionkey")).alias("region_code"),
        F.least(F.greatest(F.floor(F.col("value") / 25), F.lit(0)), F.lit(3)).cast("int").alias("severity"),
    )
    return rows.withColumn("day", F.to_date("published")).withColumn("month", F.trunc("day", "MM"))


def listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NEWS = f"""
ev AS (SELECT *, CAST(published AS DATE) AS day, CAST(date_trunc('month', published) AS DATE) AS month FROM (
  SELECT 'c' || (event_id % 3) AS channel, event_id // 2 AS msg_id, ts + to_months(CAST(event_id % 36 - 24 AS INT)) AS published,
    CASE WHEN event_id % 10 = 0 THEN {listed(NATIONAL)}[event_id % 6 + 1] ELSE {listed(TYPES)}[(event_id * 7 + user_id) % 14 + 1] END AS event_type,
    CASE WHEN event_id % 10 = 0 THEN 'national' ELSE 'local' END AS scope,
    CASE WHEN event_id % 10 = 0 THEN 'national' WHEN event_id % 7 = 0 THEN 'unresolved' WHEN event_id % 7 < 3 THEN 'region' ELSE 'mo' END AS level,
    CASE WHEN event_id % 10 <> 0 AND event_id % 7 >= 3 THEN CAST(user_id % 25 AS INT) END AS territory_id,
    CASE WHEN event_id % 10 <> 0 AND event_id % 7 <> 0 THEN n_regionkey END AS region_code,
    CAST(least(greatest(floor(value / 25), 0), 3) AS INT) AS severity FROM events JOIN nation ON n_nationkey = user_id % 25)),
news_calendar AS (SELECT CAST(unnest(generate_series(DATE '{FIRST_NEWS}', DATE '{LAST_NEWS}', INTERVAL 1 MONTH)) AS DATE) AS month),
news_grid AS (SELECT n_nationkey AS territory_id, n_regionkey AS region_code, month FROM nation CROSS JOIN news_calendar)
"""

# Hand-made phrases with places in several cases.
PHRASES = (
    "Администрация Орска набирает добровольцев для эвакуации",
    "В Туапсинском районе Краснодарского края четыре человека пропали",
    "Режим ЧС введен в Оренбургской области",
    "Пожар на рынке в Москве потушен",
    "Пожар в турецком порту Искендерун продолжается",
    "В Донецке прозвучали взрывы",
    "В Орске объявлена эвакуация из-за паводка",
    "Банк России сохранил ключевую ставку",
    "МЧС провело учения по тушению пожара",
    "Лесной пожар у Красногорска, беспилотник сбит над Курском",
    "Дрон атаковал завод, без света остались жители Бугуруслана",
    "Цены на бензин и курс доллара растут, санкции расширены",
    "Ураган и сильный снегопад: аэропорт Пулково закрыт",
    "В Донецке Ростовской области обесточены дома",
)


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose text is one of the phrases, by event_id."""
    k = F.col("event_id")
    at = (F.floor(k / 3) % len(PHRASES) + 1).cast("int")
    return table(spark, sf, "events").select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("channel"), k.alias("msg_id"), F.element_at(array(PHRASES), at).alias("text"))


PHRASED = f"""
said AS (SELECT 'c' || (event_id % 3) AS channel, event_id AS msg_id, {listed(PHRASES)}[event_id // 3 % {len(PHRASES)} + 1] AS text FROM events)
"""

#: alias, level, territory, region, region's name, people: a small hand-made gazetteer for the phrases.
PLACES = (
    ("орск", "settlement", 1673, 56, 228_000), ("орск", "settlement", 1500, 40, 120), ("туапсинский район", "mo", 662, 23, None),
    ("краснодарский край", "region", None, 23, None), ("оренбургская область", "region", None, 56, None), ("москва", "region", None, 77, None),
    ("донецк", "settlement", 1795, 61, 47_000), ("донецк", "mo", 1795, 61, None), ("ростовская область", "region", None, 61, None),
    ("красногорск", "settlement", 1459, 50, 175_000), ("курск", "settlement", 1303, 46, 440_000), ("бугуруслан", "settlement", 1668, 56, 46_000),
    ("лесной", "mo", 2001, 66, None),
)


def small_gazetteer(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*p[:4], None, p[4]) for p in PLACES], "alias string, level string, territory_id long, region_code int, region_name string, population long")
    return rows.withColumn("stem", stemmed(F.col("alias")))


def value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


GAZETTEER = "places(alias, level, territory_id, region_code, population) AS (VALUES " + ", ".join("(" + ", ".join(map(value, p)) + ")" for p in PLACES) + ")"


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """territory_id, month, t2m (kelvin), tp (metres), si10 from lineitems by the supplier's nation."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.col("s_nationkey").alias("territory_id"), F.trunc(F.to_date("l_shipdate"), "MM").alias("month"))
    return rows.agg((F.avg("l_quantity") + 250).alias("t2m"), (F.avg("l_discount") / 100).alias("tp"), (F.avg("l_tax") * 100).alias("si10"))


WEATHER = """
wraw AS (SELECT s_nationkey AS territory_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) + 250 AS t2m, avg(l_discount) / 100 AS tp, avg(l_tax) * 100 AS si10 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
wuse AS (SELECT territory_id, month, t2m - 273.15 AS t2m_c, tp * 1000 AS precip_mm_day, si10 AS wind_ms FROM wraw),
wclim AS (SELECT territory_id, month(month) AS m, avg(t2m_c) AS t, avg(precip_mm_day) AS p, avg(wind_ms) AS w FROM wuse WHERE year(month) BETWEEN 1995 AND 1997 GROUP BY ALL),
weather AS (SELECT u.*, t2m_c - t AS t2m_c_anom, precip_mm_day - p AS precip_mm_day_anom, wind_ms - w AS wind_ms_anom FROM wuse u LEFT JOIN wclim c ON c.territory_id = u.territory_id AND c.m = month(u.month))
"""
