"""Territory attributes, and the exogenous table of a territory and month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.text import folded

# Words of the territory types and states that the flags stand for.
CITY, FEDERAL, CENTRE, CLOSED = "городской округ", "внутригородская", "административный центр", "ЗАТО"

# Parts of region names and the regions that they stand for.
REGION_NAMES = {
    "москва": "Москва", "санкт-петербург": "Санкт-Петербург", "севастополь": "Севастополь",
    "кемеровская": "Кемеровская область", "адыгея": "Республика Адыгея", "татарстан": "Республика Татарстан",
    "чувашская": "Чувашская Республика", "северная осетия": "Республика Северная Осетия — Алания",
    "ханты-мансийский": "Ханты-Мансийский автономный округ — Югра",
    "ямало-ненецкий": "Ямало-Ненецкий автономный округ", "ненецкий автономный округ": "Ненецкий автономный округ",
    "республика саха": "Республика Саха (Якутия)",
}
COMPOUND = ("архангельская область", "тюменская область")


def flags(kind: Column, status: Column) -> dict[str, Column]:
    """0/1 columns by the words in a territory's type and state; a missing state has none."""
    state = F.coalesce(status, F.lit(""))
    found = {"is_city": kind == CITY, "is_federal_city_district": kind.startswith(FEDERAL), "is_regional_center": state.contains(CENTRE), "is_zato": state.contains(CLOSED)}
    return {name: F.coalesce(x, F.lit(False)).cast("int") for name, x in found.items()}


def population(territories: DataFrame, bulletin: DataFrame, merged: dict[int, float] | None = None) -> DataFrame:
    """territory_id, population: by code (ten digits, the first eight match), else by name, else from merged.

    territories: territory_id, name, code; bulletin: code, name, population.
    """
    coded = bulletin.withColumn("code", F.replace("code", F.lit(" "), F.lit(""))).where(F.length("code") == 10)
    by_code = coded.groupBy(F.substring("code", 1, 8).alias("code")).agg(F.min_by("population", F.col("code")).alias("_a"))
    key = lambda c: F.trim(folded(F.col(c)))
    by_name = bulletin.groupBy(key("name").alias("_name")).agg(F.max("population").alias("_b"))
    rows = territories.select("territory_id", "code", key("name").alias("_name")).join(by_code, "code", "left").join(by_name, "_name", "left")
    known = F.coalesce("_a", "_b")
    if merged:
        known = F.coalesce(known, F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])[F.col("territory_id")])
    return rows.select("territory_id", known.cast("double").alias("population"))


def static_features(territories: DataFrame, points: DataFrame, people: DataFrame, access: DataFrame, income: DataFrame, regional: DataFrame, years: tuple = (2022, 2023)) -> DataFrame:
    """One row for each territory: place, flags, population, market access and income a head and month.

    Coordinates come from points where the territory has none; income is the total of a year in thousands
    over the population, and in the last year the region's where it is missing.
    income: territory_id, year, total; regional: region_code, year, income_pc, spending_pc.
    """
    first, last = years[0], years[-1]
    own = income.groupBy("territory_id").pivot("year", list(years)).agg(F.first("total"))
    per_region = regional.groupBy("region_code").pivot("year", list(years)).agg(F.first("income_pc").alias("income"), F.first("spending_pc").alias("spending"))
    rows = territories.join(points.select("territory_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "territory_id", "left")
    rows = reduce(lambda a, b: a.join(b, "territory_id", "left"), [people, access, own], rows).join(per_region, "region_code", "left")
    heads = F.when(F.col("population") > 0, F.col("population"))
    out = rows.select(
        "territory_id", "region_code", F.coalesce("lat", "_lat").alias("lat"), F.coalesce("lon", "_lon").alias("lon"),
        *[c.alias(name) for name, c in flags(F.col("mo_type"), F.col("mo_status")).items()],
        "population", F.log(heads).alias("log_pop"), "market_access",
        *[(F.col(str(y)) * 1000 / 12 / heads).alias(f"mo_income_pc_{y}") for y in (first, last)],
        *[F.col(f"{y}_income").alias(f"reg_income_pc_{y}") for y in (first, last)],
        *[F.col(f"{y}_spending").alias(f"reg_spending_pc_{y}") for y in (first, last)],
    )
    return out.withColumn(f"income_pc_best_{last}", F.coalesce(f"mo_income_pc_{last}", f"reg_income_pc_{last}"))


def matched_region(name: Column, regions: list[str]) -> Column:
    """The known region that a statistical table's row name stands for; null for totals that hold other regions.

    Names are folded and freed of lead-ins; 'without districts' and 'except' rows are the region itself.
    """
    n = F.trim(F.regexp_replace(folded(name), r"\s+", " "))
    n = F.regexp_replace(F.replace(n, F.lit("–"), F.lit("-")), "^в том числе:? ?", "")
    without = F.trim(F.split_part(n, F.lit(" без "), F.lit(1)))
    head = F.trim(F.split_part(n, F.lit("("), F.lit(1)))
    title = F.create_map(*[F.lit(x) for c in COMPOUND for x in (c, c[0].upper() + c[1:])])
    found = F.when(n.contains("без автономн"), title[without]).when(n.isin(*COMPOUND), F.lit(None))
    for part, region in REGION_NAMES.items():
        hit = head.contains(part)
        found = found.when(hit & ~head.contains("ямало") if part == "ненецкий автономный округ" else hit, F.lit(region))
    known = F.create_map(*[F.lit(x) for r in regions for x in (r.lower().replace("ё", "е"), r)]) if regions else F.create_map(F.lit(""), F.lit(None).cast("string"))
    return found.otherwise(known[head])


def labels_filled(rows: DataFrame, label: str, order: str, *by: str) -> DataFrame:
    """Header or section labels carried forward to the rows below them."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return rows.withColumn(label, F.last(label, True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def weather_features(raw: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """territory_id, month, t2m_c, precip_mm_day, wind_ms and their anomalies.

    raw: territory_id, month, t2m (kelvin), tp (metres a day), si10. The climate is the mean of the same month
    of the year over the base years.
    """
    rows = raw.select("territory_id", "month", (F.col("t2m") - 273.15).alias("t2m_c"), (F.col("tp") * 1000).alias("precip_mm_day"), F.col("si10").alias("wind_ms"))
    names = ["t2m_c", "precip_mm_day", "wind_ms"]
    base = rows.where(F.year("month").between(first_year, last_year)).groupBy("territory_id", F.month("month").alias("_m")).agg(*[F.avg(c).alias(f"_{c}") for c in names])
    out = rows.withColumn("_m", F.month("month")).join(base, ["territory_id", "_m"], "left")
    return out.select("territory_id", "month", *names, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_anom") for c in names])


def cpi_features(cpi: DataFrame, territories: DataFrame, groups: dict[str, str]) -> DataFrame:
    """territory_id, month and for each group the index of the month before and its product over three months.

    cpi: region_code, month, group, cpi_mom; groups: group -> column. Territories of regions without an index have no row.
    """
    wide = cpi.groupBy("region_code", "month").pivot("group", list(groups)).agg(F.avg("cpi_mom")).withColumnsRenamed(groups)
    w = Window.partitionBy("region_code").orderBy("month")
    before = w.rowsBetween(-3, -1)
    lags = {c: F.lag(c).over(w) for c in groups.values()}
    products = {f"{c}_3m": F.when(F.count(c).over(before) == 3, F.exp(F.sum(F.log(F.col(c) / 100)).over(before)) * 100) for c in groups.values()}
    wide = wide.select("region_code", "month", *[x.alias(c) for c, x in (lags | products).items()])
    return territories.select("territory_id", "region_code").distinct().join(wide, "region_code").drop("region_code")


def macro_features(rates: DataFrame, national: DataFrame, names: dict[str, str]) -> DataFrame:
    """month, key_rate, its change over three months, real_rate, and the yearly growth of national series a month before.

    rates: month, key_rate, real_rate; national: month, name, value; names: name -> column suffix.
    """
    w = Window.orderBy("month")  # a row for each month: the calendar, not the data
    rates = rates.withColumn("key_rate_chg3", F.col("key_rate") - F.lag("key_rate", 3).over(w))
    wide = national.groupBy("month").pivot("name", list(names)).agg(F.avg("value"))
    grown = {f"nat_yoy_{s}": F.col(f"`{n}`") / F.lag(f"`{n}`", 12).over(w) for n, s in names.items()}
    wide = wide.select("month", *[x.alias(c) for c, x in grown.items()]).select("month", *[F.lag(c).over(w).alias(c) for c in grown])
    return rates.join(wide, "month", "left")


def exogenous(news: DataFrame, weather: DataFrame, cpi: DataFrame, macro: DataFrame) -> DataFrame:
    """Left joins of all features onto the news features of each territory and month."""
    keys = ["territory_id", "month"]
    return news.join(weather, keys, "left").join(cpi, keys, "left").join(F.broadcast(macro), "month", "left")


def without_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def trailing_sums(df: DataFrame, prefix: str, rows: int = 3, not_ending: str = "_surge", suffix: str = "_3m") -> DataFrame:
    """df with sums over the last rows months of the columns that start with prefix, renamed by suffix."""
    w = Window.partitionBy("territory_id").orderBy("month").rowsBetween(1 - rows, 0)
    names = [c for c in df.columns if c.startswith(prefix) and not c.endswith(not_ending)]
    return df.withColumns({f"{c}{suffix}": F.sum(c).over(w) for c in names})
