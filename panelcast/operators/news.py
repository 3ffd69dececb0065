"""From messages to events, places, incidents and territory features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from panelcast.functions.text import bare_name, local_types, national_types, normal_name, proper_names, snippet, stemmed, tagged_place
from panelcast.operators.matching import closest, dealt, looked_up, similar
from panelcast.operators.panel import surge
from panelcast.operators.spatial import within
from panelcast.sources.sinks import kept

# Groups of event types.
GROUPS = {
    "security": ("drone_attack", "shelling", "evacuation", "terror"),
    "disaster": ("flood", "fire", "wildfire", "emergency_regime", "weather_extreme"),
    "infra": ("utility_outage", "transport_disruption", "industrial_accident"),
    "other": ("epidemic", "enterprise_shock"),
}
# Names that also stand for places elsewhere; they count only where their region is named.
RISKY = ("донецк", "алтай", "мирный", "киров", "троицк", "красноармейск", "октябрьский", "советский", "первомайский", "заречный", "лесной", "северск", "кировск")
# Cities that are regions, by their names.
FEDERAL = {"москва": 77, "санкт-петербург": 78, "петербург": 78, "спб": 78, "севастополь": 92}
# Other names of regions.
REGION_ALIASES = {
    "Москва": ("москва", "столица"),
    "Санкт-Петербург": ("петербург", "санкт-петербург", "питер", "спб"),
    "Московская область": ("подмосковье", "московский регион"),
    "Ленинградская область": ("ленобласть",),
    "Кемеровская область": ("кузбасс", "кемеровская область - кузбасс", "кемеровская область — кузбасс"),
    "Ханты-Мансийский автономный округ — Югра": ("югра", "хмао", "хмао-югра", "ханты-мансийский автономный округ", "ханты-мансийский автономный округ - югра"),
    "Ямало-Ненецкий автономный округ": ("ямал", "янао", "ямало-ненецкий округ"),
    "Ненецкий автономный округ": ("нао",),
    "Республика Саха (Якутия)": ("якутия", "республика саха", "саха"),
    "Республика Башкортостан": ("башкирия", "башкортостан"),
    "Республика Татарстан": ("татарстан", "татария"),
    "Чувашская Республика": ("чувашия",),
    "Удмуртская Республика": ("удмуртия",),
    "Республика Мордовия": ("мордовия",),
    "Чеченская Республика": ("чечня",),
    "Кабардино-Балкарская Республика": ("кабардино-балкария", "кбр"),
    "Карачаево-Черкесская Республика": ("карачаево-черкесия", "кчр"),
    "Республика Северная Осетия — Алания": ("северная осетия", "северная осетия-алания", "алания"),
    "Республика Крым": ("крым",),
    "Севастополь": ("севастополь",),
    "Приморский край": ("приморье",),
    "Ставропольский край": ("ставрополье",),
    "Краснодарский край": ("кубань",),
    "Забайкальский край": ("забайкалье",),
    "Чукотский автономный округ": ("чукотка",),
    "Камчатский край": ("камчатка",),
    "Республика Хакасия": ("хакасия",),
    "Республика Тыва": ("тыва", "тува"),
    "Республика Бурятия": ("бурятия",),
    "Республика Калмыкия": ("калмыкия",),
    "Республика Карелия": ("карелия",),
    "Республика Коми": ("коми",),
    "Республика Адыгея": ("адыгея",),
    "Республика Алтай": ("горный алтай",),
    "Республика Ингушетия": ("ингушетия",),
    "Республика Дагестан": ("дагестан",),
    "Республика Марий Эл": ("марий эл",),
    "Еврейская автономная область": ("еао",),
    "Пермский край": ("прикамье",),
    "Алтайский край": ("алтайский край",),
}
BIG_CITY, TIMES = 50_000, 10
#: Names of a gazetteer that are sent to all tasks, and messages that a task resolves.
KNOWN, MESSAGES = 200_000, 10_000


def group_of(event_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for g, types in GROUPS.items() for t in types for x in (t, g)])[event_type]


# Places


def territory_aliases(name: Column, short: Column, kind: Column) -> Column:
    """Normalised names under which a territory stands in the news, by its type."""
    full, sh = normal_name(name), F.nullif(normal_name(short), F.lit(""))
    of = lambda *forms: F.array(*[F.format_string(f, sh) for f in forms])
    adjective = sh.rlike("(ский|цкий|ской|ный)$")
    more = (
        F.when(sh.isNull(), F.array().cast("array<string>"))
        .when((kind == "городской округ") & adjective, of("%s городской округ", "%s округ", "%s район"))
        .when(kind == "городской округ", of("%s", "город %s", "городской округ %s"))
        .when(kind.isin("муниципальный район", "муниципальный округ"), of("%s район", "%s муниципальный район", "%s округ", "%s муниципальный округ", "%s городской округ"))
        .otherwise(of("район %s", "муниципальный округ %s", "%s район", "%s"))
    )
    return F.array_union(F.array(full), more)


def gazetteer(territories: DataFrame, settlements: DataFrame, polygons: DataFrame, until: int = 2022, cell: float = 1.0) -> DataFrame:
    """alias, level (region, mo, settlement), territory_id, region_code, region_name, population, stem.

    territories: versions with territory_id, region_code, region_name, name, name_short, mo_type, year_from, year_to;
    of the names, versions that end after until count. settlements: id, name, x, y, population; a
    settlement with people is in the territory whose polygon holds it. Aliases have three letters or more.
    """
    regions = territories.select("region_code", "region_name").distinct()
    others = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in REGION_ALIASES.items() for x in pair])
    name = normal_name(F.col("region_name"))
    names = F.array_distinct(F.concat(F.array(name, F.regexp_replace(name, "^республика ", "")), F.coalesce(others[F.col("region_name")], F.array().cast("array<string>"))))
    none = lambda kind: F.lit(None).cast(kind)
    by_region = regions.select(F.explode(names).alias("alias"), F.lit("region").alias("level"), none("long").alias("territory_id"), "region_code", "region_name", none("long").alias("population"))
    known = territories.where(F.col("year_to") > until)
    by_mo = known.select(F.explode(territory_aliases(F.col("name"), F.col("name_short"), F.col("mo_type"))).alias("alias"), F.lit("mo").alias("level"), F.col("territory_id").cast("long").alias("territory_id"), "region_code", "region_name", none("long").alias("population"))
    live = settlements.where("population > 0").where(~normal_name(F.col("name")).isin(list(FEDERAL)))
    w = Window.partitionBy("territory_id").orderBy(F.desc("year_from"))
    latest = territories.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(F.col("territory_id").cast("long").alias("territory_id"), "region_code", "region_name")
    placed = within(live, polygons, "id", cell).where("territory_id is not null").withColumn("territory_id", F.col("territory_id").cast("long")).join(latest, "territory_id")
    by_settlement = placed.select(normal_name(F.col("name")).alias("alias"), F.lit("settlement").alias("level"), "territory_id", "region_code", "region_name", F.col("population").cast("long").alias("population"))
    every = reduce(DataFrame.unionByName, [by_region, by_mo, by_settlement]).where(F.length("alias") >= 3)
    one = every.groupBy("alias", "level", "territory_id", "region_code").agg(F.min("region_name").alias("region_name"), F.max("population").alias("population"))
    return one.withColumn("stem", stemmed(F.col("alias")))


def name_tokens(messages: DataFrame) -> DataFrame:
    """channel, msg_id, token, kind for each proper name of a message; a recogniser of names can give kind ner instead."""
    return messages.select("channel", "msg_id", F.explode(proper_names(F.col("text"))).alias("token"), F.lit("fallback").alias("kind"))


def resolve_places(tokens: DataFrame, gazetteer: DataFrame, big: int = BIG_CITY, times: int = TIMES) -> DataFrame:
    """channel, msg_id, territory_id, region_code, level, confidence, matched of the places that each message names.

    tokens: channel, msg_id, token (normalised and stemmed), kind. A name counts where one of its territories is
    in a region that the message names or in that of a dominant city (high), or if it is itself a
    dominant city, of big people or more and times as many as the next of its name (medium), or if a recogniser
    found it and it stands for one territory (medium). Risky names need their region. Of several territories the
    largest settlement is taken, if it is times as large as the next. Regions without such a
    place stand for themselves.

    What a name can stand for is drawn from the gazetteer once (leaders) and sent to all tasks where it is small, so that a message is one
    row with its names from its text to its places: rows for each name or region are made and gathered again within a task.
    """
    key = ["channel", "msg_id"]
    token = tokens.select(*key, F.explode(F.array_distinct(F.array("token", bare_name(F.col("token"))))).alias("stem"), (F.col("kind") == "ner").alias("ner"))
    names, leading = leaders(gazetteer, big, times)
    order = F.collect_list(F.struct("town", "territory_id", "region_code", "_rows"))
    names = looked_up(names.join(leading.groupBy("stem").agg(F.sort_array(order, asc=False).alias("_places")), "stem", "left"), KNOWN)
    naming = names.where((F.size("_regions") > 0) | F.col("_nameless")).select("stem", "_regions", "_nameless")
    placed = names.where("_placed").select("stem", "_places", "_dominant", "_single", "_sure")

    # a message's names, then the regions that they name
    met = token.join(names.select("stem"), "stem").groupBy(*key).agg(F.collect_set(F.struct("stem", "ner")).alias("_met"))
    each = dealt(met, MESSAGES, *key).select(*key, F.inline("_met")).join(naming, "stem", "left")
    named = each.groupBy(*key).agg(F.collect_list(F.struct("stem", "ner")).alias("_met"), F.array_distinct(F.flatten(F.collect_list("_regions"))).alias("_named"), F.max("_nameless").alias("_nameless"))

    # of each name the places in those regions, the largest settlement first
    each = named.select(*key, "_named", "_nameless", F.inline("_met")).join(placed, "stem", "left")
    told = F.col("channel").isNotNull() & F.col("msg_id").isNotNull()
    inside = F.filter("_places", lambda p: F.array_contains(F.col("_named"), p["region_code"]))
    each = each.withColumn("_inside", F.when(told, inside)).withColumn("_first", F.get("_inside", F.lit(0)))
    each = each.withColumn("_next", F.get(F.filter("_inside", lambda p: ~p["territory_id"].eqNullSafe(F.col("_first.territory_id"))), F.lit(0)))
    rows = F.filter("_first._rows", lambda r: F.array_contains(F.col("_named"), r["region_code"]))
    level = lambda mo: F.when(mo, "mo").otherwise("settlement")
    high = F.struct(F.col("_first.territory_id"), F.array_min(F.transform(rows, lambda r: r["region_code"])).alias("region_code"), level(F.exists(rows, lambda r: r["mo"])).alias("level"), F.lit("high").alias("confidence"))
    alone = F.when(told & F.col("_dominant").isNotNull(), F.col("_dominant")).when(F.col("_sure") & F.col("ner"), F.col("_single"))
    medium = F.struct(alone["territory_id"].alias("territory_id"), alone["region_code"].alias("region_code"), level(alone["mo"]).alias("level"), F.lit("medium").alias("confidence"))
    chosen = F.when(F.col("_first").isNotNull(), F.when(lone(times), high)).when(alone.isNotNull(), medium)
    each = each.select(*key, "_named", "_nameless", "stem", chosen.alias("_one")).select(*key, "_named", "_nameless", "stem", "_one.*")

    # a message's places, each once, and the regions without one
    hits = each.groupBy(*key, "territory_id", "region_code", "level").agg(F.min("confidence").alias("confidence"), F.min("stem").alias("matched"), F.first("_named").alias("_named"), F.first("_nameless").alias("_nameless"))
    place = F.struct("territory_id", "region_code", "level", "confidence", "matched")
    found = hits.groupBy(*key).agg(F.collect_list(F.when(F.col("level").isNotNull(), place)).alias("_hits"), F.first("_named").alias("_named"), F.first("_nameless").alias("_nameless"))
    code = hits.schema["region_code"].dataType
    left = F.concat(F.array_except("_named", "_hits.region_code"), F.when(F.col("_nameless"), F.array(F.lit(None).cast(code))).otherwise(F.array().cast(ArrayType(code))))
    bare = F.transform(left, lambda r: F.struct(F.lit(None).cast("long").alias("territory_id"), r.alias("region_code"), F.lit("region").alias("level"), F.lit("high").alias("confidence"), F.lit("").alias("matched")))
    return found.select(*key, F.inline(F.concat("_hits", bare)))


def lone(times: int) -> Column:
    """Whether a place (_first) is the only one, or the largest settlement and times as large as the _next."""
    town, after = F.col("_first.town"), F.col("_next.town")
    return F.col("_next").isNull() | (town.isNotNull() & (after.isNull() | (town >= times * F.greatest(after, F.lit(1)))))


def leaders(gazetteer: DataFrame, big: int, times: int) -> tuple[DataFrame, DataFrame]:
    """What each stem of a gazetteer stands for, and the first two territories of each stem and region.

    Of a stem: _regions that it names by itself or by its dominant city, _placed (whether it has territories),
    _dominant and _single (territory_id, region_code, mo of its dominant city and of its one territory), _sure, and _nameless (whether it names a region without a code). Of a stem and region:
    territory_id, town (people of its largest settlement there) and _rows, the regions in which the territory has the name and whether as mo.
    """
    rows = gazetteer.select("stem", "level", F.col("territory_id").cast("long").alias("territory_id"), "region_code", F.col("population").cast("long").alias("population")).where("stem is not null").distinct()
    size = F.coalesce("population", F.lit(0).cast("long"))
    settled = F.col("level") == "settlement"
    places = kept(rows.where("level <> 'region'").groupBy("stem", "territory_id", "region_code").agg(F.max(F.col("level") == "mo").alias("mo"), F.max(F.when(settled, size)).alias("town")))
    of = Window.partitionBy("stem", "territory_id")
    each = places.withColumn("_rows", F.collect_list(F.struct("region_code", "mo")).over(of))
    first = Window.partitionBy("stem", "region_code").orderBy(F.desc_nulls_last("town"), F.desc("territory_id"))
    leading = each.where("region_code is not null").withColumn("_k", F.row_number().over(first)).where("_k <= 2").select("stem", "region_code", "territory_id", "town", "_rows")

    towns = rows.where(settled).select("stem", "territory_id", "region_code", size.alias("_size"))
    order = Window.partitionBy("stem").orderBy(F.desc("_size"), "territory_id", "region_code")
    clear = (F.col("_size") >= big) & (F.col("_next").isNull() | (F.col("_size") >= times * F.greatest("_next", F.lit(1)))) & ~F.col("stem").isin(stemmed_set(RISKY))
    best = towns.withColumns({"_k": F.row_number().over(order), "_next": F.lead("_size").over(order)}).where("_k = 1").where(clear).select("stem", F.col("territory_id").alias("_t"), F.col("region_code").alias("_r"))
    whole = places.groupBy("stem", "territory_id").agg(F.min("region_code").alias("region_code"), F.max("mo").alias("mo"))
    one = F.struct("territory_id", "region_code", "mo")
    dominant = best.join(whole, (best["stem"] == whole["stem"]) & F.col("_t").eqNullSafe(F.col("territory_id"))).select(best["stem"], F.array("_r").alias("_city"), one.alias("_dominant"))
    single = whole.groupBy("stem").agg(F.count_distinct("territory_id").alias("_n"), F.max("mo").alias("_mo"), F.min(one).alias("_single"))
    single = single.select("stem", "_single", ((F.col("_n") == 1) & F.col("_mo") & ~F.col("stem").isin(stemmed_set(RISKY))).alias("_sure"))
    own = rows.groupBy("stem").agg(F.collect_set(F.when(F.col("level") == "region", F.col("region_code"))).alias("_regions"), F.max(F.col("level") != "region").alias("_placed"), F.max((F.col("level") == "region") & F.col("region_code").isNull()).alias("_nameless"))
    out = own.join(dominant, "stem", "left").join(single, "stem", "left")
    regions = F.array_compact(F.array_union("_regions", F.coalesce("_city", F.array().cast("array<int>"))))
    nameless = F.col("_nameless") | F.coalesce(F.get("_city", F.lit(0)).isNull() & F.col("_dominant").isNotNull(), F.lit(False))
    return out.withColumns({"_regions": regions, "_nameless": nameless}).drop("_city"), leading


def stemmed_set(names: tuple) -> list[Column]:
    return [stemmed(F.lit(n)) for n in names]


def expand_events(messages: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each message, local type and place (an unresolved one, where none is known), and each national type.

    places: as from resolve_places.
    """
    typed = messages.withColumns({"_local": local_types(F.col("text")), "_national": national_types(F.col("text")), "snippet": snippet(F.col("text"))})
    local = typed.withColumn("event_type", F.explode("_local")).join(places, ["channel", "msg_id"], "left").withColumns({"scope": F.lit("local"), "level": F.coalesce("level", F.lit("unresolved")), "confidence": F.coalesce("confidence", F.lit("none")), "matched": F.coalesce("matched", F.lit(""))})
    wide = typed.withColumn("event_type", F.explode("_national")).withColumns({"scope": F.lit("national"), "level": F.lit("national"), "confidence": F.lit("high"), "matched": F.lit(""), "territory_id": F.lit(None).cast("long"), "region_code": F.lit(None).cast("int")})
    columns = ["channel", "msg_id", "snippet", "event_type", "scope", "territory_id", "region_code", "level", "confidence", "matched"]
    return local.select(*columns).unionByName(wide.select(*columns))


def candidates(places: DataFrame, gazetteer: DataFrame, k: int = 8, cutoff: float = 80, limit: int = 40) -> DataFrame:
    """The k most similar territories of each place within its region: place_id, territory_id, score, rank.

    places: place_id, region_code, name, a row for each name of a place. The score is the best weighted ratio of a name, cutoff or more,
    and a ten-millionth of the population breaks near ties. Each name of a region is looked up once, in an index of the aliases' grams,
    and brings its limit most similar aliases at most (ties by alias, then territory), a feature of the search.
    """
    places = kept(places.select("place_id", "region_code", "name").distinct())
    gazetteer = kept(gazetteer.select("region_code", "alias", "territory_id", "population"))
    first = F.row_number().over(Window.partitionBy("region_code", "alias").orderBy("territory_id"))
    held = gazetteer.withColumn("_k", first).where(F.col("_k") <= limit).drop("_k")  # a name takes no more of an alias
    best = similar(places, gazetteer, cutoff, most=limit).join(held, ["region_code", "alias"])
    rank = F.row_number().over(Window.partitionBy("region_code", "name").orderBy(F.desc("similarity"), "alias", "territory_id"))
    best = best.withColumn("_k", rank).where(F.col("_k") <= limit)
    best = best.groupBy("region_code", "name", "territory_id").agg(F.max(F.col("similarity") + F.coalesce("population", F.lit(0)) / 1e7).alias("score"))
    own = F.row_number().over(Window.partitionBy("region_code", "name").orderBy(F.desc("score"), "territory_id"))
    best = best.withColumn("_k", own).where(F.col("_k") <= k).drop("_k")  # a place takes no more of a name
    each = places.join(best, ["region_code", "name"]).groupBy("place_id", "territory_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("score"), "territory_id")))
    return ranked.where(F.col("rank") <= k).select("place_id", "territory_id", "score", "rank")


def place_name(place: Column, *fields: str) -> Column:
    """The first of a place's fields that isn't blank, normalised."""
    return F.coalesce(*[F.nullif(normal_name(place[f]), F.lit("")) for f in fields])


def with_regions(places: DataFrame, gazetteer: DataFrame, big: int = BIG_CITY, cutoff: float = 88) -> DataFrame:
    """places (place: settlement, district, city, region) with region_code and region_only.

    region_only: a federal city without a district, or a place of which only the region is known. Else the code is that
    of the named region, or of the one region that has a city of the name with big people or more. A region's name that
    none has counts as the most similar one, of a weighted ratio of cutoff or more.
    """
    city, district, region = place_name(F.col("place"), "city", "settlement"), place_name(F.col("place"), "district"), place_name(F.col("place"), "region")
    federal = F.create_map(*[F.lit(x) for pair in FEDERAL.items() for x in pair])[city]
    by_name = gazetteer.where("level = 'region'").groupBy(F.col("alias").alias("_region")).agg(F.min("region_code").alias("_by_name"))
    cities = gazetteer.where((F.col("level") != "region") & (F.col("population") >= big)).groupBy(F.col("alias").alias("_city")).agg(F.min("region_code").alias("_by_city"), F.count_distinct("region_code").alias("_n")).where("_n = 1").drop("_n")
    rows = places.withColumns({"_region": region, "_city": city, "_district": district, "_federal": federal})
    aliases = by_name.select(F.lit(0).alias("_all"), F.col("_region").alias("alias"))
    unknown = rows.where("_region is not null").select("_region").distinct().join(by_name, "_region", "left_anti").select(F.lit(0).alias("_all"), F.col("_region").alias("name"))
    found = closest(unknown, aliases, cutoff, "_all").select(F.col("name").alias("_said"), F.col("alias").alias("_region")).join(by_name, "_region")
    by_name = by_name.unionByName(found.select(F.col("_said").alias("_region"), "_by_name"))
    rows = rows.join(looked_up(by_name), "_region", "left").join(looked_up(cities), "_city", "left")
    alone = F.when(F.col("_federal").isNotNull() & F.col("_district").isNull(), F.col("_federal")).when(F.col("_city").isNull() & F.col("_district").isNull(), F.col("_by_name"))
    code = F.coalesce(alone, "_by_name", "_federal", "_by_city")
    return rows.withColumns({"region_code": code, "region_only": alone.isNotNull()}).drop("_region", "_city", "_district", "_federal", "_by_name", "_by_city")


def exact_unique(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """places (place_id, place, region_code) with exact: the one territory of the region that a name fits exactly.

    Settlement, city and district are tried in this order; the first that fits one territory counts.
    """
    own = gazetteer.where("level <> 'region'").groupBy("alias", "region_code").agg(F.min("territory_id").alias("t"), F.count_distinct("territory_id").alias("_n")).where("_n = 1").drop("_n")
    own = looked_up(own)
    fields = ("settlement", "city", "district")
    rows = places.withColumns({f"_{f}": place_name(F.col("place"), f) for f in fields})
    for f in fields:
        rows = rows.join(own.select(F.col("alias").alias(f"_{f}"), "region_code", F.col("t").alias(f"_t_{f}")), [f"_{f}", "region_code"], "left")
    return rows.select(*places.columns, F.coalesce(*[f"_t_{f}" for f in fields]).alias("exact"))


def decide(choice: Column, n_candidates: Column, region: Column) -> Column:
    """mo for a candidate's number, region for 0 or -1 where the region is known; null: dropped."""
    return F.when((choice >= 1) & (choice <= n_candidates), "mo").when(choice.isin(0, -1) & region.isNotNull(), "region")


# Incidents and features


def incidents(events: DataFrame, gap_days: int = 3, keys: tuple = ("territory_id", "event_type")) -> DataFrame:
    """Chains of messages of a place and type within a month, cut where more than gap_days whole days pass."""
    month = F.trunc("day", "MM")
    w = Window.partitionBy(*keys, "month").orderBy("published", "channel", "msg_id")
    seconds = F.unix_timestamp(F.col("published").cast("timestamp")) - F.unix_timestamp(F.lag("published").over(w).cast("timestamp"))
    new = F.coalesce((F.floor(seconds / 86400) > gap_days).cast("int"), F.lit(1))
    rows = events.withColumn("month", month).withColumn("_new", new).withColumn("_chain", F.sum("_new").over(w))
    return rows.groupBy(*keys, "month", "_chain").agg(F.first("region_code").alias("region_code"), F.min("published").alias("start"), F.max("severity").alias("severity"), F.count("*").alias("msgs"), F.count_distinct("channel").alias("channels")).drop("_chain")


def placed_incidents(events: DataFrame, gap_days: int = 3) -> DataFrame:
    """incidents by place: a territory, or a region for events without one; with place and group."""
    placed = events.withColumn("place", tagged_place(F.col("territory_id"), F.col("region_code")))
    found = incidents(placed, gap_days, ("place", "event_type", "territory_id"))
    return found.withColumn("group", group_of(F.col("event_type")))


def daily_features(events: DataFrame, first: str, last: str, groups: tuple) -> DataFrame:
    """territory_id, month (here: the day), counts by group, all, severity and their surge, over a dense calendar."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("month")
    grid = events.select("territory_id").distinct().select("territory_id", days)
    counts = events.groupBy("territory_id", F.col("day").alias("month")).agg(*[F.count_if(F.col("event_type") == g).alias(f"n_{g}") for g in groups], F.sum("severity").alias("sev"), F.max("severity").alias("max_sev"), F.count_distinct("msg_id").alias("msgs"))
    rows = grid.join(counts, ["territory_id", "month"], "left").na.fill(0)
    total = sum((F.col(f"n_{g}") for g in groups), F.lit(0))
    rows = rows.withColumn("n_all", total)
    return rows.withColumn("surge", surge("n_all", ("territory_id",)))


def grid(territories: DataFrame, first: str, last: str) -> DataFrame:
    months = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month")
    return territories.select("territory_id", "region_code").distinct().select("territory_id", "region_code", months)


def counted(rows: DataFrame, keys: list[str], prefix: str, *more: Column) -> DataFrame:
    """Rows by group and in all, for each of keys."""
    counts = [F.count_if(F.col("group") == g).alias(f"{prefix}_{g}") for g in GROUPS]
    return rows.groupBy(*keys).agg(*counts, F.count("*").alias(f"{prefix}_all"), *more)


def with_surges(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({f"{c}_surge": surge(c, ("territory_id",)) for c in names})


def national_counts(events: DataFrame, first: str, last: str, types: tuple) -> DataFrame:
    """month and the messages of each national type, 0 in months without any; a message counts once for each type."""
    months = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    once = events.where("scope = 'national'").select("channel", "msg_id", "event_type", "month").distinct()
    counts = once.groupBy("month").agg(*[F.count_if(F.col("event_type") == t).alias(f"news_nat_{t}") for t in types])
    return months.join(counts, "month", "left").na.fill(0)


def monthly_features(events: DataFrame, territories: DataFrame, first: str, last: str, national: tuple) -> DataFrame:
    """territory_id, month, counts of local events by group for the territory and its region, national counts, surges.

    events: channel, msg_id, month, event_type, scope, level, territory_id, region_code. A message counts once for a
    group and place; unresolved events don't count.
    """
    local = events.where("scope = 'local' and level <> 'unresolved'").withColumn("group", group_of(F.col("event_type")))
    local = local.select("channel", "msg_id", "month", "group", "territory_id", "region_code").where("group is not null").distinct()
    mo = counted(local.where("territory_id is not null"), ["territory_id", "month"], "news_mo")
    region = counted(local, ["region_code", "month"], "news_reg")
    rows = grid(territories, first, last).join(mo, ["territory_id", "month"], "left").join(region, ["region_code", "month"], "left")
    rows = rows.join(F.broadcast(national_counts(events, first, last, national)), "month", "left").na.fill(0)
    surging = [f"news_{a}_{b}" for a in ("mo", "reg") for b in ("all", "security", "disaster")]
    return with_surges(rows.drop("region_code"), surging)


def incident_features(events: DataFrame, territories: DataFrame, first: str, last: str, gap_days: int = 3) -> DataFrame:
    """territory_id, month, incidents by group, severity and messages of the territory, incidents and severity of its region, surges.

    As published, messages are told apart by msg_id alone, whatever their channel.
    """
    found = placed_incidents(events.where(group_of(F.col("event_type")).isNotNull()), gap_days)
    severity = F.sum("severity")
    mo = counted(found.where("territory_id is not null"), ["territory_id", "month"], "news2_mo", severity.alias("news2_mo_sev"), F.max("severity").alias("news2_mo_max_sev"))
    heard = events.where(F.col("territory_id").isNotNull() & group_of(F.col("event_type")).isNotNull()).groupBy("territory_id", F.trunc("day", "MM").alias("month")).agg(F.count_distinct("msg_id").alias("news2_mo_msgs"))
    region = counted(found, ["region_code", "month"], "news2_reg", severity.alias("news2_reg_sev"))
    rows = grid(territories, first, last).join(mo, ["territory_id", "month"], "left").join(heard, ["territory_id", "month"], "left").join(region, ["region_code", "month"], "left").na.fill(0)
    return with_surges(rows.drop("region_code"), ["news2_mo_all", "news2_mo_sev", "news2_mo_msgs", "news2_reg_all", "news2_reg_sev"])


# Accuracy


def validation_sample(events: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """n located messages, drawn by a hash of their keys; of a message's events the first by type and place."""
    placed = events.where("scope = 'local' and level <> 'unresolved'")
    w = Window.partitionBy("channel", "msg_id").orderBy("event_type", "territory_id", "region_code")
    once = placed.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return once.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "channel", F.col("msg_id").cast("string"))), "channel", "msg_id").limit(n)


def judged(events: DataFrame, labelled: DataFrame, manual: DataFrame) -> DataFrame:
    """Events of labelled messages with row (their number within the message), place_ok, type_ok and group_ok.

    labelled: channel, msg_id, event_type, level, territory_id, region_code, place_final, type_final, of an earlier
    run: an event that agrees with a right one is right. Where that says nothing, manual (channel, msg_id, row,
    place_ok, type_ok) does. A wrong type of the right type's group is a right group.
    """
    w = Window.partitionBy("channel", "msg_id").orderBy("event_type", "territory_id", "region_code")
    rows = events.withColumn("row", F.row_number().over(w) - 1)
    known = labelled.select("channel", "msg_id", *[F.col(c).alias(f"_{c}") for c in ("event_type", "level", "territory_id", "region_code", "place_final", "type_final")])
    rows = rows.join(known, ["channel", "msg_id"]).join(manual, ["channel", "msg_id", "row"], "left")
    same = (F.col("_level") == F.col("level")) & F.when(F.col("level") == "region", F.col("_region_code") == F.col("region_code")).otherwise(F.col("_territory_id") == F.col("territory_id"))
    place = F.coalesce(F.when((F.col("_place_final") == 1) & same, 1), F.col("place_ok"))
    kind = F.coalesce(F.when((F.col("_type_final") == 1) & (F.col("_event_type") == F.col("event_type")), 1), F.col("type_ok"))
    rows = rows.withColumns({"place_ok": place, "type_ok": kind})
    near = (F.col("_type_final") == 1) & (group_of(F.col("_event_type")) == group_of(F.col("event_type")))
    return rows.withColumn("group_ok", F.when(F.col("type_ok") == 0, F.coalesce(near, F.lit(False)).cast("int")).otherwise(F.col("type_ok"))).drop(*[c for c in rows.columns if c.startswith("_")])


def by_message(rows: DataFrame) -> DataFrame:
    """channel, msg_id, place2, type2, group2: the least of its events' marks, null if one has none."""
    strict = lambda c: F.when(F.count(c) == F.count("*"), F.min(c))
    return rows.groupBy("channel", "msg_id").agg(strict("place_ok").alias("place2"), strict("type_ok").alias("type2"), strict("group_ok").alias("group2"), F.count("*").alias("n_rows"))
