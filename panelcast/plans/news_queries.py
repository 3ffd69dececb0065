"""Queries of the news chain: event types, places, model answers, incidents, features and accuracy."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast import config, schemas
from panelcast.functions import text as texts
from panelcast.operators import evaluate, news
from panelcast.operators.territory import without_prefix
from panelcast.plans import fixtures as fx
from panelcast.plans.feature_queries import regions
from panelcast.plans.registry import register, rounded
from panelcast.sources.tables import table

SETTINGS = config.load("news")

# Event types


def ascii_classes(pattern: str) -> str:
    """A pattern for an engine whose word classes are ASCII: its text is lower case and has a space before and after."""
    return re.sub(r"\\b", "[^а-яёa-z0-9_]", pattern).replace(r"\w", "[а-яёa-z0-9_]")


def types_sql(patterns: dict[str, str]) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{ascii_classes(p)}') THEN '{n}' END" for n, p in patterns.items())
    return f"list_filter([{found}], lambda x: x IS NOT NULL)"


CLASSED = fx.PHRASED + f""",
folded AS (SELECT *, ' ' || replace(lower(text), 'ё', 'е') || ' ' AS t FROM said),
typed AS (SELECT channel, msg_id, text, t, CASE WHEN regexp_matches(t, '{ascii_classes(texts.NO_EVENT)}') THEN [] ELSE {types_sql(texts.LOCAL_EVENTS)} END AS l, CASE WHEN regexp_matches(t, '{ascii_classes(texts.NO_EVENT)}') THEN [] ELSE {types_sql(texts.NATIONAL_EVENTS)} END AS n FROM folded),
classed AS (SELECT channel, msg_id, text, t, CASE WHEN list_contains(l, 'wildfire') THEN list_filter(l, lambda x: x <> 'fire') ELSE l END AS local_types, n AS national_types FROM typed)
"""


@register("WITH " + CLASSED + "SELECT msg_id, array_to_string(local_types, ',') AS local_types, array_to_string(national_types, ',') AS national_types FROM classed")
def event_types(spark, sf):
    """Local and national types by the real patterns."""
    m = fx.phrases(spark, sf)
    return m.select("msg_id", F.array_join(texts.local_types(F.col("text")), ",").alias("local_types"), F.array_join(texts.national_types(F.col("text")), ",").alias("national_types"))


@register("WITH " + CLASSED + f"SELECT msg_id, left(text, 20) AS snippet FROM classed WHERE regexp_matches(t, '{ascii_classes(SETTINGS['prefilter'])}')")
def prefiltered_messages(spark, sf):
    """Messages worth a model's time, by a wide pattern on folded text."""
    m = fx.phrases(spark, sf).where(texts.folded(F.col("text")).rlike(f"(?iuU){SETTINGS['prefilter']}"))
    return m.select("msg_id", texts.snippet(F.col("text"), 20).alias("snippet"))


# Places


def stem_sql(name: str) -> str:
    return f"regexp_replace({name}, '([а-яё]{{3}}){texts.ENDINGS}( |$)', '\\1\\3', 'g')"


GENERIC_SQL = "^(" + "|".join(g.replace(".", r"\.") for g in texts.GENERIC) + r")\s+"
RESOLVED = fx.PHRASED + ", " + fx.GAZETTEER + f""",
gz AS (SELECT *, {stem_sql("alias")} AS stem FROM places),
plain AS (SELECT channel, msg_id, regexp_replace(text, '[^А-Яа-яЁёA-Za-z -]+', ' ', 'g') AS p FROM said),
words AS (SELECT channel, msg_id, list_filter(string_split(p, ' '), lambda x: x <> '') AS w, list_transform(string_split(p, ' '), lambda x: x) AS raw FROM plain),
cap AS (SELECT channel, msg_id, unnest(range(1, len(w) + 1)) AS i, w FROM words),
tok AS (SELECT channel, msg_id, w[i] AS token FROM cap WHERE regexp_matches(w[i], '^[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-][А-Яа-яЁёA-Za-z-]+$')
  UNION SELECT channel, msg_id, w[i] || ' ' || w[i + 1] FROM cap WHERE i < len(w) AND regexp_matches(w[i], '^[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-][А-Яа-яЁёA-Za-z-]+$') AND regexp_matches(w[i + 1], '^[А-Яа-яЁёA-Za-z-]+$')),
named AS (SELECT DISTINCT channel, msg_id, {stem_sql("lower(token)")} AS s FROM tok),
tokens AS (SELECT channel, msg_id, s AS stem FROM named UNION SELECT channel, msg_id, regexp_replace(s, '{GENERIC_SQL}', '') FROM named),
met AS (SELECT t.*, level, territory_id, region_code, coalesce(population, 0) AS size, list_contains([{", ".join(stem_sql(fx.value(n)) for n in news.RISKY)}], t.stem) AS risky FROM tokens t JOIN gz ON gz.stem = t.stem),
towns AS (SELECT *, row_number() OVER w AS k, lead(size) OVER w AS nxt FROM met WHERE level = 'settlement' WINDOW w AS (PARTITION BY channel, msg_id, stem ORDER BY size DESC, territory_id)),
dominant AS (SELECT channel, msg_id, stem, territory_id, region_code FROM towns WHERE k = 1 AND size >= 50000 AND (nxt IS NULL OR size >= 10 * greatest(nxt, 1)) AND NOT risky),
rg AS (SELECT channel, msg_id, region_code FROM met WHERE level = 'region' UNION SELECT channel, msg_id, region_code FROM dominant),
mo AS (SELECT m.*, r.region_code IS NOT NULL AS in_region, d.territory_id AS dom FROM met m LEFT JOIN rg r ON r.channel = m.channel AND r.msg_id = m.msg_id AND r.region_code = m.region_code
  LEFT JOIN dominant d ON d.channel = m.channel AND d.msg_id = m.msg_id AND d.stem = m.stem WHERE level <> 'region'),
pool AS (SELECT *, bool_or(in_region) OVER (PARTITION BY channel, msg_id, stem) AS anyin FROM mo),
chosen AS (SELECT *, CASE WHEN anyin THEN CASE WHEN in_region THEN 'high' END WHEN dom = territory_id THEN 'medium' END AS confidence FROM pool),
each AS (SELECT channel, msg_id, stem, territory_id, min(region_code) AS region_code, bool_or(level = 'mo') AS is_mo, max(size) FILTER (level = 'settlement') AS town, min(confidence) AS confidence FROM chosen WHERE confidence IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY channel, msg_id, stem) AS n, row_number() OVER w AS k, lead(town) OVER w AS nxt FROM each WINDOW w AS (PARTITION BY channel, msg_id, stem ORDER BY town DESC NULLS LAST, territory_id DESC)),
hits AS (SELECT channel, msg_id, territory_id, region_code, CASE WHEN is_mo THEN 'mo' ELSE 'settlement' END AS level, min(confidence) AS confidence, min(stem) AS matched FROM ranked WHERE n = 1 OR (k = 1 AND town IS NOT NULL AND (nxt IS NULL OR town >= 10 * greatest(nxt, 1))) GROUP BY ALL),
resolved AS (SELECT * FROM hits UNION ALL SELECT channel, msg_id, NULL, region_code, 'region', 'high', '' FROM rg r WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.channel = r.channel AND h.msg_id = r.msg_id AND h.region_code = r.region_code))
"""


def resolved(spark, sf) -> DataFrame:
    return news.resolve_places(news.name_tokens(fx.phrases(spark, sf)), fx.small_gazetteer(spark))


@register("WITH " + RESOLVED + "SELECT channel, msg_id, territory_id, region_code, level, confidence, matched FROM resolved")
def resolved_places(spark, sf):
    return resolved(spark, sf)


@register("WITH " + RESOLVED + CLASSED.replace(fx.PHRASED, "") + """,
ex AS (SELECT c.channel, c.msg_id, unnest(local_types) AS event_type, text FROM classed c)
SELECT e.channel, e.msg_id, event_type, 'local' AS scope, territory_id, region_code, coalesce(level, 'unresolved') AS level, coalesce(confidence, 'none') AS confidence FROM ex e LEFT JOIN resolved r ON r.channel = e.channel AND r.msg_id = e.msg_id
UNION ALL SELECT channel, msg_id, unnest(national_types), 'national', NULL, NULL, 'national', 'high' FROM classed""")
def expanded_events(spark, sf):
    """Messages times types times places, unresolved and national rows."""
    out = news.expand_events(fx.phrases(spark, sf), resolved(spark, sf))
    return out.select("channel", "msg_id", "event_type", "scope", "territory_id", "region_code", "level", "confidence")


#: Texts are the documents; places are named by a word of a page's title, by turns as a region, a municipality and a settlement.
TITLED = """titled AS (SELECT page_id, lower(regexp_extract(regexp_extract(html, '<title>([^<]*)', 1), '[A-Za-z]{3,}', 0)) AS alias FROM pages),
places AS (SELECT alias, ['region', 'mo', 'settlement'][page_id % 3 + 1] AS level, CASE WHEN page_id % 3 > 0 THEN page_id END AS territory_id, (page_id % 40)::INT AS region_code, CASE WHEN page_id % 3 = 2 THEN page_id * 99991 % 300000 END AS population FROM titled WHERE alias <> '')"""
NAMES_OF_TEXTS = """tok AS (SELECT channel, msg_id, unnest(list_concat(list_filter(w, lambda x: regexp_matches(x, '^[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-][А-Яа-яЁёA-Za-z-]+$')),
  list_filter(list_transform(w[1:len(w) - 1], lambda x, i: CASE WHEN regexp_matches(x, '^[А-ЯЁA-Z][А-Яа-яЁёA-Za-z-][А-Яа-яЁёA-Za-z-]+$') AND regexp_matches(w[i + 1], '^[А-Яа-яЁёA-Za-z-]+$') THEN x || ' ' || w[i + 1] END), lambda x: x IS NOT NULL))) AS token FROM words),
"""
DOCUMENTS_RESOLVED = RESOLVED.replace(fx.PHRASED, "said AS (SELECT coalesce(source, '') AS channel, doc_id AS msg_id, text FROM documents WHERE text IS NOT NULL)").replace(fx.GAZETTEER, TITLED)
DOCUMENTS_RESOLVED = DOCUMENTS_RESOLVED[: DOCUMENTS_RESOLVED.index("cap AS")] + NAMES_OF_TEXTS + DOCUMENTS_RESOLVED[DOCUMENTS_RESOLVED.index("named AS") :]


def titled_places(spark, sf) -> DataFrame:
    k = F.col("page_id")
    alias = F.lower(F.regexp_extract(F.regexp_extract("html", "<title>([^<]*)", 1), "[A-Za-z]{3,}", 0))
    rows = table(spark, sf, "pages").select(
        alias.alias("alias"), F.element_at(F.array(*map(F.lit, ("region", "mo", "settlement"))), (k % 3 + 1).cast("int")).alias("level"), F.when(k % 3 > 0, k).alias("territory_id"),
        (k % 40).cast("int").alias("region_code"), F.lit(None).cast("string").alias("region_name"), F.when(k % 3 == 2, k * 99991 % 300000).alias("population"),
    )
    return rows.where("alias <> ''").withColumn("stem", texts.stemmed(F.col("alias")))


def document_messages(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("channel"), F.col("doc_id").alias("msg_id"), "text")


@register("WITH " + DOCUMENTS_RESOLVED + "SELECT channel, msg_id, territory_id, region_code, level, confidence, matched FROM resolved")
def document_places(spark, sf):
    """Places that the documents' whole texts name, of a gazetteer made of the pages' titles."""
    return news.resolve_places(news.name_tokens(document_messages(spark, sf)), titled_places(spark, sf))


RECOGNISED = DOCUMENTS_RESOLVED.replace("WHEN dom = territory_id THEN 'medium' END", f"WHEN dom IS NOT NULL THEN CASE WHEN dom = territory_id THEN 'medium' END WHEN NOT risky AND bool_or(level = 'mo') OVER (PARTITION BY channel, msg_id, stem) AND min(territory_id) OVER (PARTITION BY channel, msg_id, stem) = max(territory_id) OVER (PARTITION BY channel, msg_id, stem) THEN 'medium' END")


@register("WITH " + RECOGNISED + "SELECT channel, msg_id, territory_id, region_code, level, confidence, matched FROM resolved")
def recognised_places(spark, sf):
    """The same, with the names as a recogniser's, of which an unambiguous municipality counts by itself."""
    tokens = news.name_tokens(document_messages(spark, sf)).withColumn("kind", F.lit("ner"))
    return news.resolve_places(tokens, titled_places(spark, sf))


@register("SELECT doc_id, replace(substring(text, 1, 280), chr(10), ' ') AS snippet FROM documents")
def text_snippets(spark, sf):
    """The beginning of each document on one line."""
    return table(spark, sf, "documents").select("doc_id", texts.snippet(F.col("text")).alias("snippet"))


# Answers of a language model, as JSON


ANSWER_PLACES = (("", "", "", "оренбургская область"), ("орск", "", "", "оренбургская область"), ("", "", "москва", ""), ("", "район", "москва", ""), ("бугуруслан", "", "", "оренбургская область"), ("красногорск", "", "", ""), ("", "туапсинский район", "", "краснодарский край"), ("донецк", "", "", "ростовская область"))


def answers(spark, sf) -> DataFrame:
    """msg_id and a model's answer around JSON, with four places, of which three count."""
    k = F.col("event_id")
    one = lambda i: F.element_at(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("settlement", "district", "city", "region"), p, strict=True)]) for p in ANSWER_PLACES]), ((k + i) % len(ANSWER_PLACES) + 1).cast("int"))
    body = F.to_json(F.struct((k % 4 != 0).alias("is_incident"), F.lit("fire").alias("event_type"), (k % 5).cast("int").alias("severity"), F.lit(True).alias("in_russia"), F.array(*[one(i) for i in range(4)]).alias("places")))
    return table(spark, sf, "events").select(k.alias("msg_id"), F.when(k % 9 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("answer: "), body, F.lit(" ."))).alias("answer"))


def answered_places(spark, sf) -> DataFrame:
    a = answers(spark, sf).select("msg_id", texts.json_object(F.col("answer"), schemas.PLACES).alias("a")).where("a.is_incident and a.in_russia and a.event_type <> 'other'")
    each = a.select("msg_id", F.col("a.severity").alias("severity"), F.posexplode(F.slice("a.places", 1, 3)).alias("at", "place"))
    return each.withColumn("place_id", F.col("msg_id") * 10 + F.col("at"))


ANSWERED = "answer_place(i, settlement, district, city, region) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(map(fx.value, p)) + ")" for i, p in enumerate(ANSWER_PLACES)) + f"""),
asked AS (SELECT event_id AS msg_id, a.at, event_id * 10 + a.at AS place_id, p.*, CAST(event_id % 5 AS INT) AS severity FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS at) a JOIN answer_place p ON p.i = (event_id + a.at) % {len(ANSWER_PLACES)} WHERE event_id % 4 <> 0 AND event_id % 9 <> 0)
"""


@register("WITH " + ANSWERED + """SELECT place_id, severity, '{"settlement":"' || settlement || '","district":"' || district || '","city":"' || city || '","region":"' || region || '"}' AS matched FROM asked""")
def answered(spark, sf):
    """The first three places of each parsed answer, serialised again; answers that aren't JSON are dropped."""
    return answered_places(spark, sf).select("place_id", "severity", F.to_json("place").alias("matched"))


CODED = ANSWERED + ", " + fx.GAZETTEER + """,
keyed AS (SELECT *, nullif(settlement, '') AS s, nullif(district, '') AS d, nullif(city, '') AS c, nullif(region, '') AS r, coalesce(nullif(city, ''), nullif(settlement, '')) AS town FROM asked),
coded AS (SELECT k.*, CASE town WHEN 'москва' THEN 77 END AS federal, (SELECT min(region_code) FROM places p WHERE level = 'region' AND alias = k.r) AS by_name,
  (SELECT min(region_code) FROM places p WHERE level <> 'region' AND alias = k.town AND population >= 50000 HAVING count(DISTINCT region_code) = 1) AS by_city FROM keyed k),
region_coded AS (SELECT *, CASE WHEN federal IS NOT NULL AND d IS NULL THEN federal WHEN town IS NULL AND d IS NULL THEN by_name END AS alone FROM coded),
with_region AS (SELECT *, coalesce(alone, by_name, federal, by_city) AS region_code, alone IS NOT NULL AS region_only FROM region_coded),
fits AS (SELECT place_id, i, min(territory_id) AS t FROM (SELECT w.place_id, n.i, p.territory_id FROM with_region w, (SELECT unnest([1, 2, 3]) AS i) n, places p WHERE p.level <> 'region' AND p.region_code = w.region_code AND p.alias = CASE n.i WHEN 1 THEN w.s WHEN 2 THEN w.c ELSE w.d END) GROUP BY ALL HAVING count(DISTINCT territory_id) = 1),
exact AS (SELECT place_id, arg_min(t, i) AS exact FROM fits GROUP BY ALL)
"""


@register("WITH " + CODED + "SELECT place_id, region_code, region_only FROM with_region")
def place_regions(spark, sf):
    """Regions of answered places: federal cities, named regions, the region of a unique large city."""
    return news.with_regions(answered_places(spark, sf), fx.small_gazetteer(spark)).select("place_id", "region_code", "region_only")


@register("WITH " + CODED + "SELECT w.place_id, exact FROM with_region w LEFT JOIN exact e ON e.place_id = w.place_id WHERE NOT region_only")
def exact_places(spark, sf):
    """The one territory that a place's name fits exactly in its region."""
    coded = news.with_regions(answered_places(spark, sf), fx.small_gazetteer(spark)).where("not region_only")
    return news.exact_unique(coded, fx.small_gazetteer(spark)).select("place_id", "exact")


@register("WITH " + CODED + """SELECT place_id, CASE WHEN region_only THEN 'region' WHEN choice BETWEEN 1 AND 2 THEN 'mo' WHEN choice IN (0, -1) AND region_code IS NOT NULL THEN 'region' END AS scope FROM (SELECT *, place_id % 5 - 1 AS choice FROM with_region)
WHERE region_only OR choice BETWEEN 1 AND 2 OR (choice IN (0, -1) AND region_code IS NOT NULL)""")
def decided_places(spark, sf):
    """What becomes of a choice among two candidates; choices beyond them are dropped."""
    coded = news.with_regions(answered_places(spark, sf), fx.small_gazetteer(spark))
    scope = F.when(F.col("region_only"), "region").otherwise(news.decide(F.col("place_id") % 5 - 1, F.lit(2), F.col("region_code")))
    return coded.select("place_id", scope.alias("scope")).where("scope is not null")


# Incidents and features


@register("WITH " + fx.NEWS + f""",
placed AS (SELECT *, CASE WHEN territory_id IS NOT NULL THEN 'mo:' || territory_id ELSE 'reg:' || region_code END AS place FROM ev WHERE scope = 'local'),
g AS (SELECT *, lag(published) OVER (PARTITION BY place, event_type, territory_id, month ORDER BY published, channel, msg_id) AS before FROM placed),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR floor((floor(epoch(published)) - floor(epoch(before))) / 86400) > {SETTINGS['gap_days']} THEN 1 ELSE 0 END) OVER (PARTITION BY place, event_type, territory_id, month ORDER BY published, channel, msg_id) AS chain FROM g)
SELECT place, event_type, month, any_value(region_code) AS region_code, min(published) AS start, max(severity) AS severity, count(*) AS msgs, count(DISTINCT channel) AS channels FROM c GROUP BY place, event_type, territory_id, month, chain""")
def placed_incidents(spark, sf):
    """Chains of a place and type, broken after more than three days and at month ends."""
    return news.placed_incidents(fx.news_events(spark, sf).where("scope = 'local'"), SETTINGS["gap_days"]).drop("territory_id", "group")


def group_sql(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{t}' THEN '{g}'" for g, types in news.GROUPS.items() for t in types) + " END"


def counts_sql(prefix: str) -> str:
    return ", ".join(f"count(*) FILTER (grp = '{g}') AS {prefix}_{g}" for g in news.GROUPS) + f", count(*) AS {prefix}_all"


def filled(prefix: str, more: tuple = ()) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in (*[f"{prefix}_{g}" for g in (*news.GROUPS, "all")], *more))


def surge_sql(columns: list[str]) -> str:
    return ", ".join(f"round(CASE WHEN count(*) OVER w >= 3 THEN ln(1 + {c}) - ln(1 + avg({c}) OVER w) END, 6) + 0.0 AS {c}_surge" for c in columns)


SURGING = [f"news_{a}_{b}" for a in ("mo", "reg") for b in ("all", "security", "disaster")]
SURGING2 = ["news2_mo_all", "news2_mo_sev", "news2_mo_msgs", "news2_reg_all", "news2_reg_sev"]
BEFORE = "WINDOW w AS (PARTITION BY territory_id ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
FEATURES = fx.NEWS + f""",
loc AS (SELECT DISTINCT channel, msg_id, month, {group_sql('event_type')} AS grp, territory_id, region_code FROM ev WHERE scope = 'local' AND level <> 'unresolved'),
fm AS (SELECT territory_id, month, {counts_sql('news_mo')} FROM loc WHERE territory_id IS NOT NULL GROUP BY ALL),
fr AS (SELECT region_code, month, {counts_sql('news_reg')} FROM loc GROUP BY ALL),
fn AS (SELECT month, {", ".join(f"count(*) FILTER (event_type = '{t}') AS news_nat_{t}" for t in fx.NATIONAL)} FROM (SELECT DISTINCT channel, msg_id, event_type, month FROM ev WHERE scope = 'national') GROUP BY ALL),
f1 AS (SELECT g.territory_id, g.month, {filled('news_mo')}, {filled('news_reg')}, {", ".join(f"coalesce(news_nat_{t}, 0) AS news_nat_{t}" for t in fx.NATIONAL)} FROM news_grid g LEFT JOIN fm ON fm.territory_id = g.territory_id AND fm.month = g.month LEFT JOIN fr ON fr.region_code = g.region_code AND fr.month = g.month LEFT JOIN fn ON fn.month = g.month),
features AS (SELECT *, {surge_sql(SURGING)} FROM f1 {BEFORE})
"""


def features(spark, sf) -> DataFrame:
    out = news.monthly_features(fx.news_events(spark, sf), regions(spark, sf), fx.FIRST_NEWS, fx.LAST_NEWS, fx.NATIONAL)
    return rounded(out, 6, *[f"{c}_surge" for c in SURGING])


@register("WITH " + FEATURES + "SELECT * FROM features")
def news_features(spark, sf):
    """Counts by territory, region and country, and surges."""
    return features(spark, sf)


@register("WITH " + FEATURES + "SELECT c.month, " + ", ".join(f"coalesce(news_nat_{t}, 0) AS news_nat_{t}" for t in fx.NATIONAL) + " FROM news_calendar c LEFT JOIN fn ON fn.month = c.month")
def national_news(spark, sf):
    return news.national_counts(fx.news_events(spark, sf), fx.FIRST_NEWS, fx.LAST_NEWS, fx.NATIONAL)


INCIDENTS = f"""
pl AS (SELECT *, CASE WHEN territory_id IS NOT NULL THEN 'mo:' || territory_id ELSE 'reg:' || region_code END AS place FROM ev WHERE scope = 'local' AND level <> 'unresolved'),
pg AS (SELECT *, lag(published) OVER (PARTITION BY place, event_type, territory_id, month ORDER BY published, channel, msg_id) AS before FROM pl),
pc AS (SELECT *, sum(CASE WHEN before IS NULL OR floor((floor(epoch(published)) - floor(epoch(before))) / 86400) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY place, event_type, territory_id, month ORDER BY published, channel, msg_id) AS chain FROM pg),
inc AS (SELECT place, event_type, territory_id, month, any_value(region_code) AS region_code, max(severity) AS severity, count(*) AS msgs, {group_sql('event_type')} AS grp FROM pc GROUP BY place, event_type, territory_id, month, chain)
"""
FEATURES2 = INCIDENTS + f""",
gm2 AS (SELECT territory_id, month, {counts_sql('news2_mo')}, sum(severity) AS news2_mo_sev, max(severity) AS news2_mo_max_sev FROM inc WHERE territory_id IS NOT NULL GROUP BY ALL),
gh2 AS (SELECT territory_id, month, count(DISTINCT msg_id) AS news2_mo_msgs FROM pl WHERE territory_id IS NOT NULL GROUP BY ALL),
gr2 AS (SELECT region_code, month, {counts_sql('news2_reg')}, sum(severity) AS news2_reg_sev FROM inc GROUP BY ALL),
g2 AS (SELECT g.territory_id, g.month, {filled('news2_mo', ('news2_mo_sev', 'news2_mo_max_sev', 'news2_mo_msgs'))}, {filled('news2_reg', ('news2_reg_sev',))} FROM news_grid g LEFT JOIN gm2 ON gm2.territory_id = g.territory_id AND gm2.month = g.month
  LEFT JOIN gh2 ON gh2.territory_id = g.territory_id AND gh2.month = g.month LEFT JOIN gr2 ON gr2.region_code = g.region_code AND gr2.month = g.month),
features2 AS (SELECT *, {surge_sql(SURGING2)} FROM g2 {BEFORE})
"""


def features2(spark, sf) -> DataFrame:
    ev = fx.news_events(spark, sf).where("scope = 'local' and level <> 'unresolved'")
    out = news.incident_features(ev, regions(spark, sf), fx.FIRST_NEWS, fx.LAST_NEWS, SETTINGS["gap_days"])
    return rounded(out, 6, *[f"{c}_surge" for c in SURGING2])


@register("WITH " + fx.NEWS + ", " + FEATURES2 + "SELECT * FROM features2")
def incident_features(spark, sf):
    """Incidents, severity and messages by territory and region, and surges."""
    return features2(spark, sf)


@register("WITH " + FEATURES + ", " + FEATURES2 + "SELECT g.* FROM (SELECT territory_id, month FROM features) f LEFT JOIN features2 g ON g.territory_id = f.territory_id AND g.month = f.month")
def exogenous_second_version(spark, sf):
    """The feature table with its first news columns replaced by those of incidents."""
    base = without_prefix(features(spark, sf), "news_")
    return base.join(features2(spark, sf), ["territory_id", "month"], "left")


# Accuracy


@register("WITH " + fx.NEWS + """, once AS (SELECT * FROM ev WHERE scope = 'local' AND level <> 'unresolved' QUALIFY row_number() OVER (PARTITION BY channel, msg_id ORDER BY event_type, territory_id NULLS FIRST, region_code NULLS FIRST) = 1)
SELECT channel, msg_id, event_type, CASE WHEN territory_id IS NULL THEN 'whole region' ELSE n_name END AS place, r_name AS region FROM (SELECT * FROM once ORDER BY md5(concat_ws('|', '42', channel, CAST(msg_id AS VARCHAR))), channel, msg_id LIMIT 200)
LEFT JOIN nation ON n_nationkey = territory_id LEFT JOIN region ON r_regionkey = region_code""")
def validation_sample(spark, sf):
    """Located messages drawn for checking, with the names of their places."""
    drawn = news.validation_sample(fx.news_events(spark, sf), 200)
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_name"), table(spark, sf, "region")
    out = drawn.join(n, F.col("territory_id") == F.col("n_nationkey"), "left").join(r, F.col("region_code") == F.col("r_regionkey"), "left")
    return out.select("channel", "msg_id", "event_type", F.when(F.col("territory_id").isNull(), "whole region").otherwise(F.col("n_name")).alias("place"), F.col("r_name").alias("region"))


def judged(spark, sf) -> DataFrame:
    """Events of every third message against labels of an earlier run and manual ones."""
    ev = fx.news_events(spark, sf).where("scope = 'local' and level <> 'unresolved' and msg_id % 3 = 0").select("channel", "msg_id", "event_type", "level", "territory_id", "region_code").distinct()
    w = Window.partitionBy("channel", "msg_id").orderBy("event_type", "territory_id", "region_code")
    first = ev.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    k = F.col("msg_id")
    labelled = first.withColumns({"event_type": F.when(k % 2 == 0, F.col("event_type")).otherwise("fire"), "place_final": F.when(k % 5 != 0, (k % 4 != 1).cast("int")), "type_final": (k % 7 != 1).cast("int")})
    manual = first.select("channel", "msg_id", F.lit(0).alias("row"), F.when(k % 6 != 0, (k % 2).cast("int")).alias("place_ok"), (k % 2).cast("int").alias("type_ok"))
    return news.judged(ev, labelled, manual)


JUDGED = fx.NEWS + f""",
je AS (SELECT DISTINCT channel, msg_id, event_type, level, territory_id, region_code FROM ev WHERE scope = 'local' AND level <> 'unresolved' AND msg_id % 3 = 0),
jr AS (SELECT *, row_number() OVER (PARTITION BY channel, msg_id ORDER BY event_type, territory_id NULLS FIRST, region_code NULLS FIRST) - 1 AS row FROM je),
jl AS (SELECT channel, msg_id, CASE WHEN msg_id % 2 = 0 THEN event_type ELSE 'fire' END AS event_type, level, territory_id, region_code, CASE WHEN msg_id % 5 <> 0 THEN CAST(msg_id % 4 <> 1 AS INT) END AS place_final, CAST(msg_id % 7 <> 1 AS INT) AS type_final FROM jr WHERE row = 0),
jm AS (SELECT channel, msg_id, 0 AS row, CASE WHEN msg_id % 6 <> 0 THEN CAST(msg_id % 2 AS INT) END AS place_ok, CAST(msg_id % 2 AS INT) AS type_ok FROM jr WHERE row = 0),
jj AS (SELECT r.channel, r.msg_id, r.row, coalesce(CASE WHEN l.place_final = 1 AND l.level = r.level AND CASE WHEN r.level = 'region' THEN l.region_code = r.region_code ELSE l.territory_id = r.territory_id END THEN 1 END, m.place_ok) AS place_ok,
  coalesce(CASE WHEN l.type_final = 1 AND l.event_type = r.event_type THEN 1 END, m.type_ok) AS type_ok, coalesce(l.type_final = 1 AND {group_sql('l.event_type')} = {group_sql('r.event_type')}, false) AS near
  FROM jr r JOIN jl l ON l.channel = r.channel AND l.msg_id = r.msg_id LEFT JOIN jm m ON m.channel = r.channel AND m.msg_id = r.msg_id AND m.row = r.row),
judged AS (SELECT channel, msg_id, row, place_ok, type_ok, CASE WHEN type_ok = 0 THEN CAST(near AS INT) ELSE type_ok END AS group_ok FROM jj),
bym AS (SELECT channel, msg_id, {", ".join(f"CASE WHEN count({c}_ok) = count(*) THEN min({c}_ok) END AS {c}2" for c in ("place", "type", "group"))}, count(*) AS n_rows FROM judged GROUP BY ALL)
"""


@register("WITH " + JUDGED + "SELECT channel, msg_id, place2, type2, group2, n_rows FROM bym")
def message_marks(spark, sf):
    """Marks of messages: right only if every event of the message is."""
    return news.by_message(judged(spark, sf))


@register("WITH " + JUDGED + """, m AS (SELECT 'place' AS measure, place2 AS ok FROM bym UNION ALL SELECT 'type', type2 FROM bym UNION ALL SELECT 'group', group2 FROM bym UNION ALL SELECT 'both', CASE WHEN place2 IS NULL OR type2 IS NULL THEN 0 ELSE place2 * type2 END FROM bym),
c AS (SELECT measure, CAST(sum(ok) AS BIGINT) AS k, count(ok) AS n FROM m GROUP BY ALL)
SELECT measure, k, n, round(((k / n + 3.8416 / (2 * n)) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
round(((k / n + 3.8416 / (2 * n)) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM c""")
def news_accuracy(spark, sf):
    """Shares of right messages with Wilson intervals."""
    m = news.by_message(judged(spark, sf))
    both = F.when(F.col("place2").isNull() | F.col("type2").isNull(), 0).otherwise(F.col("place2") * F.col("type2"))
    rows = m.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), x.alias("ok")) for n, x in (("place", F.col("place2")), ("type", F.col("type2")), ("group", F.col("group2")), ("both", both))])))
    rows = rows.groupBy("measure").agg(F.sum("ok").cast("long").alias("k"), F.count("ok").alias("n"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return rows.select("measure", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
