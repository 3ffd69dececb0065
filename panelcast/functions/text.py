"""Text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of local and national event types, and of messages that are no event.
LOCAL_EVENTS = {
    "flood": r"паводк|наводнен|подтоплен|затоплен|прорыв\w* дамб|уровень воды",
    "wildfire": r"(лесн|природн|ландшафтн|степн)\w* пожар|пал\w* травы",
    "fire": r"пожар|возгоран",
    "emergency_regime": r"режим\w* (чс|чрезвычайн|повышенной готовности)|чрезвычайн\w* ситуац",
    "drone_attack": r"бпла|беспилотник|\bдрон",
    "shelling": r"обстрел|ракетн\w* удар|ракетн\w* опасност|авиационн\w* опасност",
    "evacuation": r"эвакуац|эвакуир",
    "utility_outage": r"без (электричества|света|тепла|газа|воды|отопления)|отключен\w* (электр|свет|тепл|газ|вод)|обесточ|блэкаут|аварийн\w* отключ|порыв\w* (теплотрасс|водопровод)",
    "industrial_accident": r"взрыв|выброс\w* (вредн|опасн|аммиак|хлор)|утечк\w* (газа|аммиака|хлора)|разлив\w* (нефт|мазут|топлив)|обрушен",
    "terror": r"теракт|контртеррористическ",
    "transport_disruption": r"аэропорт\w*.{0,60}(ограничен|закрыт|приостанов)|перекрыт\w* (движен|трасс|дорог)|ограничен\w* движен|движение.{0,30}(закрыт|приостановлен|перекрыт)",
    "weather_extreme": r"аномальн\w* (жар|холод|мороз|снег|тепл)|сильн\w* (снегопад|мороз|ветер|ливн|дожд|жар)|ураган|смерч|метел|гололед|ледян\w* дожд",
    "epidemic": r"карантин|вспышк\w* (инфекц|заболеван|кишечн|кори|гриппа)|массов\w* отравлен",
    "enterprise_shock": r"(закрыт|остановк|банкротств)\w*.{0,30}(завод|предприяти|комбинат|фабрик|шахт|разрез)|массов\w* (увольнен|сокращен)|простой.{0,20}(завод|предприяти)",
}
NATIONAL_EVENTS = {
    "key_rate": r"ключев\w* ставк",
    "fuel_prices": r"цен\w* (на )?(бензин|топлив|дизел)|стоимост\w* (бензин|топлив)",
    "ruble_fx": r"курс\w* (рубл|доллар|евро|юан)",
    "marketplaces": r"маркетплейс|wildberries|вайлдберриз|\bozon|озон",
    "social_payments": r"индексаци\w* (пенси|пособ|выплат|мрот)|мрот",
    "sanctions": r"санкци",
}
NO_EVENT = r"учени[яй]|тренировк|\bвикторин|прогноз\w* погоды на|что (случилось|произошло) (этой ночью|за день|за неделю)|главное (за|к) |итоги (дня|недели)"


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


def found_in(text: Column, pattern: str) -> Column:
    """text.rlike(pattern) for folded text; alternatives are plain searches, or are tried only where their longest literal is found."""
    alternatives = re.findall(r"(?:\([^()]*\)|[^|()])+", pattern)
    tokens = [re.findall(r"\\.[*+?]?|\([^()]*\)[*+?]?|\[[^\]]*\][*+?]?|\.(?:\{[^}]*\})?|[^\\()\[\].]+", a) for a in alternatives]
    found = []
    for whole, parts in zip(alternatives, tokens, strict=True):
        literal = max((x for x in parts if re.fullmatch(r"[\w -]+", x)), key=len, default="")
        fits = text.rlike(f"(?iuU){whole}")
        found.append(text.contains(literal) if literal == whole else text.contains(literal) & fits if literal else fits)
    return reduce(or_, found)


def types_of(text: Column, patterns: dict[str, str], excluded: str | None = None) -> Column:
    """Names of the patterns found, in order; none where excluded is found, and for a null text."""
    none = F.array().cast("array<string>")

    def of(t: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(found_in(t, p), F.lit(name)) for name, p in patterns.items()]))
        return F.when(found_in(t, excluded), none).otherwise(found) if excluded else found

    # bound to a name, so that the text is folded once
    return F.get(F.transform(F.array(folded(F.coalesce(text, F.lit("")))), of), F.lit(0))


def local_types(text: Column) -> Column:
    one = lambda found: F.when(F.array_contains(found, "wildfire"), F.array_remove(found, "fire")).otherwise(found)
    return F.get(F.transform(F.array(types_of(text, LOCAL_EVENTS, NO_EVENT)), one), F.lit(0))


def national_types(text: Column) -> Column:
    return types_of(text, NATIONAL_EVENTS, NO_EVENT)


def normal_name(text: Column) -> Column:
    """Folded, without quotes, with plain dashes and single spaces, trimmed of spaces, dots and commas."""
    t = F.translate(F.lower(text), "ё–—‑«»\"'„“”", "е---")
    return F.btrim(F.regexp_replace(t, r"\s{2,}|[\t\n\x0B\f\r]", " "), F.lit(" .,"))


#: Case endings of names and of the words that go with them, longest first.
ENDINGS = "(ого|его|ому|ему|ыми|ими|ами|ями|ой|ей|ом|ем|ах|ях|ов|ев|ую|юю|ый|ий|ая|яя|ое|ее|а|я|у|ю|ы|и|е|о|ь|й)"


def stemmed(name: Column) -> Column:
    """A normalised name with its words' case endings off, so that 'орска' and 'орск' are one; three letters stay at least."""
    return F.regexp_replace(name, "([а-яё]{3})" + ENDINGS + "( |$)", "$1$3")


def proper_names(text: Column) -> Column:
    """Capitalised words of a text, and pairs of one and the word after it, normalised and stemmed, each once in order."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^А-Яа-яЁёA-Za-z -]+", " ")
    one = F.regexp_extract_all(plain, F.lit("([А-ЯЁA-Z][А-Яа-яЁёA-Za-z-]{2,})"))
    two = F.regexp_extract_all(plain, F.lit("(?=(?<![А-Яа-яЁёA-Za-z-])([А-ЯЁA-Z][А-Яа-яЁёA-Za-z-]{2,} +[А-Яа-яЁёA-Za-z-]+))"))
    return F.array_distinct(F.transform(F.concat(one, two), lambda x: stemmed(normal_name(x))))


def tagged_place(territory: Column, region: Column) -> Column:
    """mo:id of a territory, else reg:code of its region."""
    return F.when(territory.isNotNull(), F.concat(F.lit("mo:"), territory.cast("string"))).otherwise(F.concat(F.lit("reg:"), region.cast("string")))


def severity(text: Column) -> Column:
    """A number from 0 to 3; 1 where the text is none."""
    return F.least(F.greatest(F.coalesce(text.try_cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(3.0))


def without_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    """text less the first listed prefix that it starts with."""
    return F.regexp_replace(text, "^(" + "|".join(prefixes) + r")\s+", "")


def area_code(text: Column) -> Column:
    """Digits only, padded to eight on the left and cut to eight."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.substring(F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits), 1, 8)


# Generic words before a place's name; the first that fits goes.
GENERIC = ("городской округ город-курорт", "городской округ город", "городской округ", "город-курорт", "город", "г.", "г", "поселок городского типа", "рабочий поселок", "поселок", "пгт", "село", "деревня", "станица", "хутор", "аул")


def bare_name(name: Column) -> Column:
    """A normalised name less the generic words before it."""
    return without_prefix(name, tuple(g.replace(".", r"\.") for g in GENERIC))


def snippet(text: Column, length: int = 280) -> Column:
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def json_object(text: Column, schema: str) -> Column:
    """The struct in the text from its first brace to its last; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
