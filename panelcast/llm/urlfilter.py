"""URL filters: dated list entries as validity intervals, matched as of each capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import attach, cut, fetch

#: date, list, operation, host suffix. The tables hold no list, so the query brings this small one.
LIST_ENTRIES = (
    ("2024-01-01", "block", "add", "ads-track.example.com"),
    ("2024-02-01", "block", "add", "example.net"),
    ("2024-03-01", "allow", "add", "tionsh.example.net"),
    ("2024-05-15", "block", "remove", "example.net"),
    ("2024-06-01", "block", "add", "blog.tionble.example.com"),
    ("2024-06-01", "allow", "add", "blog.tionble.example.com"),
    ("2024-07-01", "allow", "remove", "blog.tionble.example.com"),
    ("2024-08-01", "block", "add", "example.net"),
    ("2024-09-01", "allow", "remove", "tionsh.example.net"),
    ("2024-09-10", "block", "add", "example.org"),
    ("2024-09-20", "block", "add", "example.org"),
    ("2024-11-01", "block", "remove", "ads-track.example.com"),
)


def default_entries(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([*LIST_ENTRIES], "entry_date string, list string, operation string, suffix string")
    return rows.withColumn("entry_date", F.to_date("entry_date"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, and the fixed entries: a quarter of the hosts is blocked for a time, some are allowed.

    The tables hold no list. Digits of the MD5 of a host say whether and when it is added and removed.
    """
    hosts = pages.select(host_of("url").alias("suffix")).where("suffix is not null").distinct().withColumn("_d", F.md5("suffix"))
    digits = lambda at, n: F.conv(F.substring("_d", at, n), 16, 10).cast("int")
    first = F.date_add(F.to_date(F.lit("2024-01-01")), digits(2, 3) % 300)
    entry = lambda when, name, kind, day: F.when(when, F.struct(day.alias("entry_date"), F.lit(name).alias("list"), F.lit(kind).alias("operation")))
    blocked, ends, allowed = digits(1, 1) < 4, digits(5, 1) < 8, digits(6, 1) < 2
    made = F.array_compact(F.array(entry(blocked, "block", "add", first), entry(blocked & ends, "block", "remove", F.date_add(first, 60)), entry(allowed, "allow", "add", first)))
    return hosts.select("suffix", F.inline(made)).select("entry_date", "list", "operation", "suffix").unionByName(default_entries(pages.sparkSession))


def validity(entries: DataFrame) -> DataFrame:
    """list, suffix, since, until: the days, since included and until not, on which an entry is active.

    An entry holds from an add to the next dated change of the same list and suffix; of several changes
    on one day a removal wins. Entries with a null in any column are void.
    """
    last = entries.dropna().groupBy("list", F.lower("suffix").alias("suffix"), "entry_date").agg(F.max(F.col("operation") == "remove").alias("gone"))
    span = Window.partitionBy("list", "suffix").orderBy("entry_date")
    dated = last.withColumn("until", F.lead("entry_date").over(span))
    return dated.where("not gone").select("list", "suffix", F.col("entry_date").alias("since"), "until")


def host_of(url: str):
    """Lower-case host of an http or https URL, without user, port and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with host, verdict, suffix, since, active: an as-of join by url and fetch_date.

    Of the entries active on the fetch date whose suffix is the host or ends it at a dot, the longest
    decides, and allow before block on one suffix; without any the verdict is none. since is the
    deciding entry's, active the number of active entries. A null date or URL, or one without host,
    has verdict none. Every row of captures is returned once; an empty list leaves all at none. Columns
    of captures by the new names are replaced.
    """
    rows = captures.drop("host", "verdict", "suffix", "since", "active").withColumn("host", host_of("url"))
    asked = rows.where("host is not null and fetch_date is not null").groupBy("host", "fetch_date").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = cut(validity(entries))
    met = fetch(asked.select("host", "fetch_date", "n", F.explode(ends).alias("suffix")), known, ["suffix"])
    met = met.where((F.col("since") <= F.col("fetch_date")) & (F.col("until").isNull() | (F.col("fetch_date") < F.col("until"))))
    best = F.struct(F.length("suffix").alias("n"), (F.col("list") == "allow").alias("allows"), "list", "suffix", "since")
    judged = met.groupBy("host", "fetch_date", "n").agg(F.max(best).alias("best"), F.count("*").alias("active"))
    day = lambda: F.concat_ws("|", "host", F.col("fetch_date").cast("string"))
    judged = cut(judged.select(day().alias("_day"), "n", F.col("best.list").alias("verdict"), "best.suffix", "best.since", "active"))
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # what has no host or date meets nothing, and neither it nor a frequent host is gathered in a task
    some = rows.withColumn("_day", F.when(F.col("host").isNotNull() & F.col("fetch_date").isNotNull(), day()).otherwise(F.concat(F.lit("|"), F.xxhash64(*captures.columns).cast("string"))))
    out = attach(some, judged, "_day", total, F.xxhash64(*captures.columns)).drop("_day")
    return out.withColumns({"verdict": F.coalesce("verdict", F.lit("none")), "active": F.coalesce("active", F.lit(0)).cast("long")})


def page_verdicts(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """filter_captures for pages; they have no fetch time, so page_id spreads them over 2024."""
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    found = filter_captures(pages.select("page_id", "url", day.alias("fetch_date")), entries)
    return found.select("page_id", "host", F.col("fetch_date").cast("string").alias("fetch_date"), "verdict", "suffix", F.col("since").cast("string").alias("since"), "active")


PAGE_VERDICTS_SQL = f"""
WITH fixed(entry_date, list, operation, suffix) AS (VALUES {", ".join(f"(DATE '{a}', '{b}', '{c}', '{d}')" for a, b, c, d in LIST_ENTRIES)}),
hosts AS (SELECT DISTINCT nullif(regexp_replace(lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.+$', ''), '') AS suffix FROM pages),
digits AS (SELECT suffix, CAST('0x' || substr(md5(suffix), 1, 1) AS INT) AS a, CAST('0x' || substr(md5(suffix), 5, 1) AS INT) AS b, CAST('0x' || substr(md5(suffix), 6, 1) AS INT) AS c, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(suffix), 2, 3) AS INT) % 300 AS INT) AS first FROM hosts WHERE suffix IS NOT NULL),
entries AS (SELECT * FROM fixed UNION ALL SELECT first, 'block', 'add', suffix FROM digits WHERE a < 4 UNION ALL SELECT first + 60, 'block', 'remove', suffix FROM digits WHERE a < 4 AND b < 8 UNION ALL SELECT first, 'allow', 'add', suffix FROM digits WHERE c < 2),
changes AS (SELECT list, suffix, entry_date, bool_or(operation = 'remove') AS gone FROM entries GROUP BY ALL),
dated AS (SELECT *, lead(entry_date) OVER (PARTITION BY list, suffix ORDER BY entry_date) AS until FROM changes),
active AS (SELECT list, suffix, entry_date AS since, until FROM dated WHERE NOT gone),
rows AS (
  SELECT page_id, DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetch_date,
    nullif(regexp_replace(lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\\.+$', ''), '') AS host
  FROM pages),
met AS (
  SELECT page_id, list, a.suffix, since, row_number() OVER (PARTITION BY page_id ORDER BY length(a.suffix) DESC, list = 'allow' DESC, list DESC, since DESC) AS k,
    count(*) OVER (PARTITION BY page_id) AS active
  FROM rows JOIN active a ON (host = a.suffix OR ends_with(host, '.' || a.suffix)) AND since <= fetch_date AND (until IS NULL OR fetch_date < until))
SELECT r.page_id, host, CAST(fetch_date AS VARCHAR) AS fetch_date, coalesce(list, 'none') AS verdict, suffix, CAST(since AS VARCHAR) AS since, coalesce(active, 0) AS active
FROM rows r LEFT JOIN met m ON r.page_id = m.page_id AND k = 1
"""
