"""Queries of sources and sinks, territory attributes and the exogenous table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import text as texts
from panelcast.operators import news, spatial, territory
from panelcast.plans import fixtures as fx
from panelcast.plans.registry import SERIES, dense, records, register, residual, rounded
from panelcast.plans.sql import RECORDS, RESIDUALS, query
from panelcast.sources import sinks, tables
from panelcast.sources.tables import spending, table

# Sources and sinks: what a writer wrote, as its reader returns it


@register(query("SELECT territory_id, category, month, y FROM panel"))
def source_spending(spark, sf):
    raw = spending(spark, sf).select(F.col("territory_id").cast("long").alias("territory_id"), "category", F.date_format("month", "yyyy-MM").alias("date"), F.col("y").alias("value"))
    return sinks.round_trip(raw, sinks.write_table, tables.read_spending)


@register("""WITH m AS (SELECT 'c' || (event_id % 3) AS channel, event_id // 2 AS msg_id, event_type, user_id % 25 AS place, event_id FROM events)
SELECT channel, msg_id, event_type, place, min(event_id) AS event_id FROM m WHERE channel <> 'c2' GROUP BY ALL""")
def source_event_parts(spark, sf):
    """Parts by channel, without those of one name; repeats keep the first."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    rows = e.select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("channel"), F.floor(k / 2).alias("msg_id"), "event_type", (F.col("user_id") % 25).alias("place"), k)
    key = ["channel", "msg_id", "event_type", "place"]
    return sinks.round_trip(rows, partial(sinks.write_parts, by="channel"), lambda s, p: tables.read_parts(s, p, "channel=c2", key, ["event_id"]))


@register("""SELECT CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS day, event_type AS name, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def source_periodic_csv(spark, sf):
    """A CSV whose separator is found and whose names have spaces around."""
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("period"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("name")).agg(F.round(F.sum("value"), 2).alias("value"))
    return sinks.round_trip(rows, partial(sinks.write_report, sep=";"), tables.read_periodic)


@register("""SELECT CAST(ts AS DATE) AS day, round(avg(value) FILTER (event_type = 'click'), 4) AS click, round(avg(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY ALL""")
def source_weekly_wide(spark, sf):
    """Categories as columns, repeats averaged."""
    rows = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("period"), F.concat("event_type", F.lit(" ")).alias("name"), "value")
    out = sinks.round_trip(rows, sinks.write_report, lambda s, p: tables.read_wide(s, p, {"click": "click", "view": "view"}, "day"))
    return rounded(out, 4, "click", "view")


@register("""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS key_rate, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS real_rate FROM orders GROUP BY ALL""")
def source_key_rates(spark, sf):
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").cast("string").alias("period"), F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("value"))
    return rounded(sinks.round_trip(rows, sinks.write_report, lambda s, p: tables.read_rates(s, p, "O", "F")), 4, "key_rate", "real_rate")


@register("SELECT s_suppkey AS territory_id, s_acctbal AS lat, s_acctbal / 2 AS lon FROM supplier")
def source_points(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("territory_id"), F.col("s_acctbal").alias("lat"), (F.col("s_acctbal") / 2).alias("lon"))
    return sinks.round_trip(rows, sinks.write_report, tables.read_points)


@register("SELECT 'c' || (doc_id % 3) AS channel, doc_id AS msg_id, CAST(doc_id % 4 AS INT) AS row, CAST(quality AS VARCHAR) AS place_ok, CAST(toxic AS VARCHAR) AS type_ok, 'a; b' AS comment FROM labels")
def source_labels(spark, sf):
    """A semicolon CSV that begins with a byte-order mark."""
    k = F.col("doc_id")
    rows = table(spark, sf, "labels").select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("﻿channel"), k.alias("msg_id"), (k % 4).cast("int").alias("row"), F.col("quality").alias("place_ok"), F.col("toxic").alias("type_ok"), F.lit("a; b").alias("comment"))
    return sinks.round_trip(rows, partial(sinks.write_report, sep=";"), tables.read_labels)


@register("""SELECT 'chat' AS channel, conv_id * 100 + turn AS msg_id, text, TIMESTAMP '2024-01-01 03:00:00' + to_seconds(conv_id * 3600 + turn) AS published_msk, CAST(date_trunc('month', TIMESTAMP '2024-01-01 03:00:00' + to_seconds(conv_id * 3600 + turn)) AS DATE) AS month
FROM conversations WHERE role <> 'system' AND text IS NOT NULL""")
def source_chat_export(spark, sf):
    """A JSON export: real messages only, links left out of the text, times in Moscow."""
    c = table(spark, sf, "conversations").where("text is not null")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    at = (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn")).cast("string")
    message = F.struct((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("role") == "system", "service").otherwise("message").alias("type"), at.alias("date_unixtime"), F.array(part("plain", F.col("text")), part("link", F.lit("https://example.com"))).alias("text_entities"))
    lines = c.select(F.to_json(F.struct(F.array(message).alias("messages"))).alias("value"))
    return sinks.round_trip(lines, lambda df, p: df.write.text(p), lambda s, p: tables.read_export(s, p, "chat", lines=True))


@register("WITH " + fx.WEATHER + "SELECT territory_id, month, round(t2m_c, 6) AS t2m_c, round(t2m_c_anom, 6) AS t2m_c_anom, round(precip_mm_day_anom, 6) AS precip_mm_day_anom, CAST(NULL AS DOUBLE) AS snowfall_mm_day_anom, round(wind_ms_anom, 6) AS wind_ms_anom FROM weather")
def source_weather(spark, sf):
    """The weather table's columns that become features; the snow column isn't in the file."""
    made = territory.weather_features(fx.weather(spark, sf), 1995, 1997)
    return rounded(sinks.round_trip(made, sinks.write_table, tables.read_weather), 6, "t2m_c", "t2m_c_anom", "precip_mm_day_anom", "wind_ms_anom")


@register(query("SELECT territory_id, category, origin, h, round(y_pred, 2) AS y_pred FROM records WHERE model = 'snaive'", RECORDS))
def sink_records(spark, sf):
    """Records of all models in folders by model; one model's folder is read."""
    r = records(spark, sf).select("model", *SERIES, "origin", "h", F.round("y_pred", 2).alias("y_pred"))
    return sinks.round_trip(r, partial(sinks.write_parts, by="model"), lambda s, p: s.read.parquet(p).where("model = 'snaive'").drop("model"))


@register(query("SELECT 'up' AS detector, territory_id, category, month, round(e, 6) + 0.0 AS score FROM e0 WHERE e > 0", RESIDUALS))
def sink_scores(spark, sf):
    """Scores in folders by detector; the one above 0 is read."""
    e = residual(spark, sf).where("e is not null and e <> 0")
    rows = e.select(F.when(F.col("e") > 0, "up").otherwise("down").alias("detector"), *SERIES, "month", F.round("e", 6).alias("score"))
    return sinks.round_trip(rows, partial(sinks.write_parts, by="detector"), lambda s, p: s.read.parquet(p).where("detector = 'up'"))


@register(query("SELECT model, h, round(avg(abs(y_true - y_pred)), 2) AS mae FROM core GROUP BY ALL", RECORDS))
def sink_report(spark, sf):
    """A result table as one CSV file."""
    rows = records(spark, sf).where("complete and y_true is not null and y_pred is not null").groupBy("model", "h").agg(F.round(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))), 2).alias("mae"))
    return sinks.round_trip(rows, sinks.write_report, lambda s, p: s.read.schema("model string, h int, mae double").option("header", True).csv(p))


@register(query("SELECT category, round(sum(y), 2) AS total, count(*) AS months FROM panel WHERE territory_id = 3 GROUP BY ALL"))
def sink_json(spark, sf):
    """Objects by key as JSON lines."""
    rows = spending(spark, sf).where("territory_id = 3").groupBy("category").agg(F.round(F.sum("y"), 2).alias("total"), F.count("*").alias("months"))
    back = lambda s, p: s.read.schema("category string, value struct<total: double, months: long>").json(p).select("category", "value.*")
    return sinks.round_trip(rows, partial(sinks.write_json, key="category"), back)


# Territories


STATIC = fx.TERRITORIES + """,
bulletin AS (SELECT CASE WHEN n_nationkey % 6 <> 0 THEN lpad(CAST(n_nationkey * 1000 AS VARCHAR), 8, '0') || ' 00' END AS code, ' Округ ' || n_name || ' ' AS name, count(*) * 10.0::DOUBLE AS population FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (5, 11) GROUP BY n_nationkey, n_name),
people AS (SELECT t.territory_id, coalesce(a.population, b.population, CASE t.territory_id WHEN 5 THEN 4321.0 WHEN 11 THEN 1234.0 END)::DOUBLE AS population FROM terr t
  LEFT JOIN bulletin a ON left(replace(a.code, ' ', ''), 8) = t.code LEFT JOIN bulletin b ON lower(trim(b.name)) = 'округ ' || lower(t.n_name)),
income AS (SELECT c_nationkey AS territory_id, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 7 GROUP BY ALL),
regional AS (SELECT n_regionkey AS region_code, year(o_orderdate) AS year, round(avg(o_totalprice), 4) AS income_pc, round(min(o_totalprice), 4) AS spending_pc FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
"""


@register("WITH " + STATIC + """SELECT t.territory_id, t.region_code, round(coalesce(t.lat, p.lat), 6) AS lat, round(coalesce(t.lon, p.lon), 6) AS lon, CAST(mo_type = 'городской округ' AS INT) AS is_city, CAST(starts_with(mo_type, 'внутригородская') AS INT) AS is_federal_city_district,
CAST(contains(coalesce(mo_status, ''), 'административный центр') AS INT) AS is_regional_center, CAST(contains(coalesce(mo_status, ''), 'ЗАТО') AS INT) AS is_zato, population, round(ln(population), 6) AS log_pop, round(market_access, 4) AS market_access,
round(i9.total * 1000 / 12 / population, 4) AS mo_income_pc_1999, round(i0.total * 1000 / 12 / population, 4) AS mo_income_pc_2000, r9.income_pc AS reg_income_pc_1999, r0.income_pc AS reg_income_pc_2000, r9.spending_pc AS reg_spending_pc_1999, r0.spending_pc AS reg_spending_pc_2000,
round(coalesce(i0.total * 1000 / 12 / population, r0.income_pc), 4) AS income_pc_best_2000
FROM terr t LEFT JOIN people USING (territory_id) LEFT JOIN (SELECT n_nationkey AS territory_id, 1.5 * n_nationkey AS lat, 2.5 * n_nationkey AS lon FROM nation) p USING (territory_id)
LEFT JOIN (SELECT s_nationkey AS territory_id, avg(s_acctbal) AS market_access FROM supplier GROUP BY ALL) m USING (territory_id)
LEFT JOIN income i9 ON i9.territory_id = t.territory_id AND i9.year = 1999 LEFT JOIN income i0 ON i0.territory_id = t.territory_id AND i0.year = 2000
LEFT JOIN regional r9 ON r9.region_code = t.region_code AND r9.year = 1999 LEFT JOIN regional r0 ON r0.region_code = t.region_code AND r0.year = 2000""")
def static_features(spark, sf):
    t, k = fx.territories(spark, sf), F.col("n_nationkey")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == k)
    bulletin = c.where(~k.isin(5, 11)).groupBy(k, "n_name").agg((F.count("*") * 10.0).alias("population"))
    bulletin = bulletin.select(F.when(k % 6 != 0, F.concat(F.lpad((k * 1000).cast("string"), 8, "0"), F.lit(" 00"))).alias("code"), F.concat(F.lit(" Округ "), "n_name", F.lit(" ")).alias("name"), "population")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate").alias("year")
    income = o.where(k != 7).groupBy(k.alias("territory_id"), year).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    regional = o.groupBy(F.col("n_regionkey").alias("region_code"), year).agg(F.round(F.avg("o_totalprice"), 4).alias("income_pc"), F.round(F.min("o_totalprice"), 4).alias("spending_pc"))
    points = table(spark, sf, "nation").select(k.alias("territory_id"), (1.5 * k).alias("lat"), (2.5 * k).alias("lon"))
    access = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("territory_id")).agg(F.avg("s_acctbal").alias("market_access"))
    out = territory.static_features(t, points, territory.population(t, bulletin, fx.MERGED), access, income, regional, (1999, 2000))
    return rounded(out, 6, "lat", "lon", "log_pop").transform(lambda d: rounded(d, 4, "market_access", "mo_income_pc_1999", "mo_income_pc_2000", "income_pc_best_2000"))


@register("WITH " + fx.within_sql("customer", "c_custkey") + "SELECT id, p.territory_id FROM pts LEFT JOIN placed p USING (id)")
def points_in_polygons(spark, sf):
    pts = fx.points(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("id"), "x", "y")
    return spatial.within(pts, fx.polygons(spark, sf), "id", 2.0).select("id", "territory_id")


@register("WITH " + fx.TERRITORIES + ", " + fx.within_sql("supplier", "s_suppkey") + """,
mo AS (SELECT territory_id, region_code, region_raw, 'округ ' || lower(n_name) AS alias, lower(n_name) AS sh, mo_type FROM terr WHERE year_to > 2022),
forms AS (SELECT territory_id, region_code, region_raw, unnest(list_distinct(list_concat([alias], CASE WHEN mo_type = 'городской округ' THEN [sh, 'город ' || sh, 'городской округ ' || sh]
  WHEN mo_type IN ('муниципальный район', 'муниципальный округ') THEN [sh || ' район', sh || ' муниципальный район', sh || ' округ', sh || ' муниципальный округ', sh || ' городской округ']
  ELSE ['район ' || sh, 'муниципальный округ ' || sh, sh || ' район', sh] END))) AS alias FROM mo),
every AS (
  SELECT DISTINCT lower(region_raw) AS alias, 'region' AS level, NULL::BIGINT AS territory_id, region_code, region_raw AS region_name, NULL::BIGINT AS population FROM terr
  UNION ALL SELECT alias, 'mo', territory_id, region_code, region_raw, NULL FROM forms
  UNION ALL SELECT lower(s_name), 'settlement', p.territory_id, t.region_code, t.region_raw, CAST(floor(abs(s_acctbal) * 10 + 0.5) AS BIGINT) FROM supplier JOIN placed p ON p.id = s_suppkey JOIN terr t ON t.territory_id = p.territory_id WHERE CAST(floor(abs(s_acctbal) * 10 + 0.5) AS BIGINT) > 0)
SELECT alias, level, territory_id, region_code, min(region_name) AS region_name, max(population) AS population FROM every WHERE length(alias) >= 3 GROUP BY ALL""")
def gazetteer_build(spark, sf):
    settlements = fx.points(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "x", "y", F.floor(F.abs("s_acctbal") * 10 + 0.5).alias("population"))
    return news.gazetteer(fx.territories(spark, sf), settlements, fx.polygons(spark, sf), cell=2.0).drop("stem")


NAMES = ("Москва", "город Москва", "в том числе: Ненецкий автономный округ", "Ямало-Ненецкий автономный округ", "Архангельская область", "Тюменская область без автономных округов", "Архангельская область (кроме НАО)", "Курская область", "Республика Саха (Якутия)", "нечто")
NAMED = dict(zip(NAMES, ("Москва", "Москва", "Ненецкий автономный округ", "Ямало-Ненецкий автономный округ", None, "Тюменская область", "Архангельская область", "Курская область", "Республика Саха (Якутия)", None), strict=True))
KNOWN = ["Курская область", "Архангельская область", "Тюменская область"]


@register(f"SELECT event_id, {fx.listed(NAMES)}[event_id % {len(NAMES)} + 1] AS name, CASE event_id % {len(NAMES)} " + " ".join(f"WHEN {i} THEN {fx.value(NAMED[n] if n != 'Архангельская область (кроме НАО)' else 'Архангельская область')}" for i, n in enumerate(NAMES)) + " END AS region FROM events")
def matched_regions(spark, sf):
    """Row names of statistical tables as regions."""
    name = F.element_at(fx.array(NAMES), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", name.alias("name"), territory.matched_region(name, KNOWN).alias("region"))


@register("""SELECT p_partkey, last_value(CASE WHEN p_partkey % 7 = 1 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS section FROM part""")
def labels_filled(spark, sf):
    """Section labels carried down to the rows below."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 7 == 1, F.col("p_brand")).alias("section"))
    return territory.labels_filled(p, "section", "p_partkey", "p_size").select("p_partkey", "section")


# Exogenous table


WEATHER_COLUMNS = ("t2m_c", "precip_mm_day", "wind_ms", "t2m_c_anom", "precip_mm_day_anom", "wind_ms_anom")


@register("WITH " + fx.WEATHER + "SELECT territory_id, month, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in WEATHER_COLUMNS) + " FROM weather")
def weather_anomalies(spark, sf):
    return rounded(territory.weather_features(fx.weather(spark, sf), 1995, 1997), 6, *WEATHER_COLUMNS)


CPI_GROUPS = {"BUILDING": "cpi_building", "MACHINERY": "cpi_machinery"}


def cpi(spark, sf) -> DataFrame:
    """Monthly index of a region's spending by category; one region has none."""
    rows = dense(spark, sf).where("region_code <> 4").groupBy("region_code", "category", "month").agg(F.round(F.sum("y"), 2).alias("y"))
    lag = F.lag("y").over(Window.partitionBy("region_code", "category").orderBy("month"))
    return rows.select("region_code", "month", F.col("category").alias("group"), F.round(100 * F.col("y") / F.when(lag > 0, lag), 6).alias("cpi_mom"))


CPI = """
cy AS (SELECT region_code, category, month, round(sum(y), 2) AS y FROM dense WHERE region_code <> 4 GROUP BY ALL),
cl AS (SELECT *, lag(y) OVER (PARTITION BY region_code, category ORDER BY month) AS y0 FROM cy),
cw AS (SELECT region_code, month, avg(x) FILTER (category = 'BUILDING') AS b, avg(x) FILTER (category = 'MACHINERY') AS m FROM (SELECT *, round(100 * y / CASE WHEN y0 > 0 THEN y0 END, 6) AS x FROM cl) GROUP BY ALL),
cpi_region AS (SELECT region_code, month, lag(b) OVER r AS cpi_building, lag(m) OVER r AS cpi_machinery, CASE WHEN count(b) OVER w = 3 THEN exp(sum(ln(b / 100)) OVER w) * 100 END AS cpi_building_3m, CASE WHEN count(m) OVER w = 3 THEN exp(sum(ln(m / 100)) OVER w) * 100 END AS cpi_machinery_3m
  FROM cw WINDOW r AS (PARTITION BY region_code ORDER BY month), w AS (PARTITION BY region_code ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
cpi AS (SELECT n_nationkey AS territory_id, c.* EXCLUDE (region_code) FROM nation JOIN cpi_region c ON c.region_code = n_regionkey)
"""
CPI_COLUMNS = ("cpi_building", "cpi_machinery", "cpi_building_3m", "cpi_machinery_3m")


def regions(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("territory_id"), F.col("n_regionkey").alias("region_code"))


@register(query("SELECT territory_id, month, " + ", ".join(f"round({c}, {4 if c.endswith('3m') else 6}) AS {c}" for c in CPI_COLUMNS) + " FROM cpi", CPI))
def cpi_features(spark, sf):
    return rounded(territory.cpi_features(cpi(spark, sf), regions(spark, sf), CPI_GROUPS), 4, *CPI_COLUMNS[2:]).transform(lambda d: rounded(d, 6, *CPI_COLUMNS[:2]))


def macro(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '2001-08-01'").groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month"))
    of = lambda s: F.round(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 4)
    rates = o.agg(of("O").alias("key_rate"), of("F").alias("real_rate"))
    national = dense(spark, sf).groupBy("month", F.col("category").alias("name")).agg(F.round(F.sum("y"), 2).alias("value"))
    return territory.macro_features(rates, national, {"BUILDING": "building", "MACHINERY": "machinery"})


MACRO = """
mr AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS key_rate, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS real_rate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL),
mn AS (SELECT category, month, y / y12 AS g FROM total_lag),
mg AS (SELECT month, max(g) FILTER (category = 'BUILDING') AS b, max(g) FILTER (category = 'MACHINERY') AS m FROM mn GROUP BY ALL),
ml AS (SELECT month, lag(b) OVER (ORDER BY month) AS nat_yoy_building, lag(m) OVER (ORDER BY month) AS nat_yoy_machinery FROM mg),
macro AS (SELECT mr.*, key_rate - lag(key_rate, 3) OVER (ORDER BY mr.month) AS key_rate_chg3, nat_yoy_building, nat_yoy_machinery FROM mr LEFT JOIN ml ON ml.month = mr.month)
"""
MACRO_COLUMNS = ("key_rate", "real_rate", "key_rate_chg3", "nat_yoy_building", "nat_yoy_machinery")


@register(query("SELECT month, " + ", ".join(f"round({c}, 4) AS {c}" for c in MACRO_COLUMNS) + " FROM macro", MACRO))
def macro_features(spark, sf):
    return rounded(macro(spark, sf), 4, *MACRO_COLUMNS)


@register(query("""SELECT g.territory_id, g.month, n_orders, """ + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("t2m_c", "t2m_c_anom", *CPI_COLUMNS[2:], *MACRO_COLUMNS)) + ", cpi_building, cpi_machinery" + """
FROM (SELECT territory_id, month, sum(n_orders)::BIGINT AS n_orders FROM panel GROUP BY ALL) g LEFT JOIN weather w ON w.territory_id = g.territory_id AND w.month = g.month
LEFT JOIN cpi c ON c.territory_id = g.territory_id AND c.month = g.month LEFT JOIN macro m ON m.month = g.month""", fx.WEATHER, CPI, MACRO))
def exogenous_table(spark, sf):
    """Counts, weather, prices and macro series of each territory and month: four left joins."""
    counts = spending(spark, sf).groupBy("territory_id", "month").agg(F.sum("n_orders").alias("n_orders"))
    w = territory.weather_features(fx.weather(spark, sf), 1995, 1997).select("territory_id", "month", "t2m_c", "t2m_c_anom")
    out = territory.exogenous(counts, w, territory.cpi_features(cpi(spark, sf), regions(spark, sf), CPI_GROUPS), macro(spark, sf))
    return rounded(out, 4, "t2m_c", "t2m_c_anom", *CPI_COLUMNS[2:], *MACRO_COLUMNS)


# Small operators


@register("SELECT event_id, least(greatest(coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'none' ELSE CAST(value / 20 AS VARCHAR) END AS DOUBLE), 1), 0), 3) AS severity, CASE WHEN event_id % 3 = 0 THEN 'reg:' || (user_id % 5) ELSE 'mo:' || user_id END AS place FROM events")
def coerced_and_tagged(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, "none").otherwise((F.col("value") / 20).cast("string"))
    return table(spark, sf, "events").select("event_id", texts.severity(raw).alias("severity"), texts.tagged_place(F.when(k % 3 != 0, F.col("user_id")), F.col("user_id") % 5).alias("place"))


@register(query("SELECT territory_id, month, category, y FROM (SELECT territory_id, month, unnest(['building', 'machinery']) AS category, unnest([b, m]) AS y FROM (SELECT territory_id, month, sum(y) FILTER (category = 'BUILDING') AS b, sum(y) FILTER (category = 'MACHINERY') AS m FROM panel GROUP BY ALL)) WHERE y IS NOT NULL"))
def unpivot_categories(spark, sf):
    wide = spending(spark, sf).groupBy("territory_id", "month").pivot("category", ["BUILDING", "MACHINERY"]).agg(F.sum("y")).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})
    return wide.unpivot(["territory_id", "month"], ["building", "machinery"], "category", "y").where("y is not null")


@register("SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY ALL")
def pivot_mean(spark, sf):
    """Repeats are averaged."""
    return rounded(table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")), 6, "click", "view")


@register(query("SELECT territory_id, category, month, y, row_number() OVER (ORDER BY territory_id, category, month) AS place FROM panel WHERE territory_id < 3 QUALIFY place <= 50"))
def first_rows(spark, sf):
    """The first rows of the sorted panel, numbered."""
    head = spending(spark, sf).where("territory_id < 3").orderBy("territory_id", "category", "month").limit(50)
    return head.select(*SERIES, "month", "y", F.row_number().over(Window.orderBy("territory_id", "category", "month")).alias("place"))


@register("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(o_orderstatus), list(left(o_orderpriority, 1))))), ',') AS tags FROM orders GROUP BY ALL")
def united_tags(spark, sf):
    """The union of two sets for each customer."""
    both = F.array_union(F.collect_set("o_orderstatus"), F.collect_set(F.substring("o_orderpriority", 1, 1)))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(both), ",").alias("tags"))


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) = 1")
def keep_first(spark, sf):
    """Of rows with an equal key the first in order, nulls last, of equal ones in order the first in the files."""
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(F.asc_nulls_last("l_linenumber"), "_metadata.file_path", "_metadata.row_index")
    return table(spark, sf, "lineitem").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("l_orderkey", "l_linenumber", "l_partkey")


@register("SELECT event_id, user_id FROM events WHERE event_id % 4 = 1")
def shard_of_events(spark, sf):
    """One of four shards by message number."""
    return table(spark, sf, "events").where(F.pmod("event_id", F.lit(4)) == 1).select("event_id", "user_id")


@register(query("SELECT territory_id, month, n_a + lag_a AS n_a_3m, n_b + lag_b AS n_b_3m FROM (SELECT territory_id, month, n_a, n_b, coalesce(sum(n_a) OVER w, 0)::BIGINT AS lag_a, coalesce(sum(n_b) OVER w, 0)::BIGINT AS lag_b FROM (SELECT territory_id, month, sum(n_orders)::BIGINT AS n_a, count(*) AS n_b FROM panel GROUP BY ALL) WINDOW w AS (PARTITION BY territory_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))"))
def trailing_sums(spark, sf):
    rows = spending(spark, sf).groupBy("territory_id", "month").agg(F.sum("n_orders").alias("n_a"), F.count("*").alias("n_b"), F.lit(0).alias("n_c_surge"))
    out = territory.trailing_sums(rows, "n_")
    return territory.without_prefix(out.select("territory_id", "month", "n_a_3m", "n_b_3m", "n_c_surge"), "n_c")
