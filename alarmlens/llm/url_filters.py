"""URL filters as a temporal list join (operator 1), in DataFrame functions alone.

List entries carry a date and say that a domain or URL is added to a list or removed from it. They become validity
intervals, and each capture is held against the entries that were valid on the day it was fetched. Intervals are cut at
months, so that a capture meets those of its own month only: at most one for each list and day of it. Domains are looked up
once for each host and day, which is also what spreads a host with a third of all captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ENTRY_SCHEMA = "list string, verdict string, kind string, pattern string, effective_on date, action string"
#: The lists that the registered query uses: list, verdict, kind, pattern, day, action.
DEFAULT_ENTRIES = (
    ("adult", "block", "domain", "adult-x.example.com", "2024-01-01", "add"),
    ("adult", "block", "domain", "adult-x.example.net", "2024-02-10", "add"),
    ("adult", "block", "domain", "adult-x.example.org", "2024-03-05", "add"),
    ("adult", "block", "domain", "adult-x.example.net", "2024-09-20", "remove"),
    ("gambling", "block", "domain", "casino-win.example.com", "2024-01-15", "add"),
    ("gambling", "block", "domain", "casino-win.example.net", "2024-01-15", "add"),
    ("gambling", "block", "domain", "casino-win.example.org", "2024-04-01", "add"),
    ("gambling", "block", "domain", "casino-win.example.com", "2024-06-01", "remove"),
    ("gambling", "block", "domain", "casino-win.example.com", "2024-08-01", "add"),
    ("gambling", "block", "domain", "free-bets.example.com", "2024-02-01", "add"),
    ("gambling", "block", "domain", "free-bets.example.net", "2024-02-01", "add"),
    ("gambling", "block", "domain", "free-bets.example.org", "2024-02-01", "add"),
    ("spam", "block", "domain", "spam-farm.example.com", "2023-11-30", "add"),
    ("spam", "block", "domain", "spam-farm.example.net", "2024-05-12", "add"),
    ("spam", "block", "domain", "spam-farm.example.org", "2024-05-12", "add"),
    ("spam", "block", "domain", "spam-farm.example.org", "2024-10-31", "remove"),
    ("spam", "block", "domain", "tionsh.example.net", "2024-07-01", "add"),
    ("spam", "block", "domain", "tionsh.example.net", "2024-07-15", "remove"),
    ("trusted", "allow", "domain", "www.casino-win.example.org", "2024-07-01", "add"),
    ("trusted", "allow", "domain", "blog.tionsh.example.net", "2024-07-08", "add"),
    ("takedown", "block", "url", "ththon.example.com/en/25", "2024-03-01", "add"),
    ("takedown", "block", "url", "blog.tionsh.example.net/en/27", "2024-02-01", "add"),
)


def entries(spark: SparkSession, rows=DEFAULT_ENTRIES) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT list, verdict, kind, pattern, CAST(day AS DATE) AS effective_on, action FROM VALUES {values} AS t(list, verdict, kind, pattern, day, action)")


def _host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^@:]*)", 1))


def _page(url: Column) -> Column:
    """Host and path, as pages and url patterns are compared: the path keeps its case."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.concat(F.nullif(_host(url), F.lit("")), path)


def intervals(listed: DataFrame) -> DataFrame:
    """Each entry's time of validity: valid_from, and valid_to (exclusive; null: open). Of a day's entries an addition wins."""
    by = ("list", "verdict", "kind", "pattern")
    whole = F.when(F.col("pattern").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("pattern")).otherwise(F.concat(F.lit("http://"), "pattern"))
    days = (
        listed.where("list IS NOT NULL AND pattern IS NOT NULL AND effective_on IS NOT NULL")
        .withColumn("pattern", F.when(F.col("kind") == "url", _page(whole)).otherwise(F.lower("pattern")))
        .groupBy(*by, "effective_on")
        .agg(F.max(F.col("action") == "add").alias("on"))
    )
    return days.withColumn("valid_to", F.lead("effective_on").over(Window.partitionBy(*by).orderBy("effective_on"))).where("on").select(*by, F.col("effective_on").alias("valid_from"), "valid_to")


def addressed(captures: DataFrame) -> DataFrame:
    """Adds host (lower case, without user and port) and page (host and path, without query, fragment and end slash)."""
    return captures.withColumn("host", F.nullif(_host(F.col("url")), F.lit(""))).withColumn("page", _page(F.col("url")))


def _looked_up(keys: DataFrame, valid: DataFrame, by: str, first, last) -> DataFrame:
    """For each (by, fetched_on) with entries valid then: these, as an array. keys has also pattern and rank."""
    last_month = F.trunc(F.lit(last), "month")
    until = F.trunc(F.date_sub("valid_to", 1), "month")
    months = F.sequence(F.greatest(F.trunc("valid_from", "month"), F.trunc(F.lit(first), "month")), F.least(F.coalesce(until, last_month), last_month), F.expr("INTERVAL 1 MONTH"))
    cut = valid.where((F.col("valid_from") <= F.lit(last)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(first)))).withColumn("month", F.explode(months))
    met = keys.withColumn("month", F.trunc("fetched_on", "month")).join(cut, ["pattern", "month"]).where("fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)")
    return met.groupBy(by, "fetched_on").agg(F.collect_list(F.struct("rank", "verdict", "list")).alias(f"{by}_entries"))


#: Parts into which the captures of one host and day are dealt.
SALTS = 16


def filtered(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """captures with url and fetched_on, and for each row: host, page, verdict, n_active, lists.

    Active entries are those whose domain is the host or a parent of it, or whose URL is the page. The most specific decides
    (a URL over any domain, then the domain with more labels), at a tie one that allows. A null url or one without a host,
    and a null fetched_on, meets no entry: verdict `none`. Repeated rows and null ids stay; own columns named host, page,
    verdict, n_active or lists are replaced. An empty list blocks nothing.
    """
    rows = addressed(captures.drop("verdict", "n_active", "lists"))
    bounds = rows.agg(F.min("fetched_on").alias("a"), F.max("fetched_on").alias("b")).first()
    if bounds.a is None:
        none = F.array().cast("array<struct<rank:int,verdict:string,list:string>>")
        return _decided(rows.withColumn("host_entries", none).withColumn("page_entries", none))
    valid = intervals(listed)
    labels = F.split("host", r"\.")
    hosts = rows.where("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("rank")))
    by_host = _looked_up(hosts.select("host", "fetched_on", F.inline(suffixes)), valid.where("kind = 'domain'"), "host", bounds.a, bounds.b)
    pages = rows.where("page IS NOT NULL AND fetched_on IS NOT NULL").select("page", "fetched_on").distinct()
    by_page = _looked_up(pages.select("page", "fetched_on", F.col("page").alias("pattern"), F.lit(1000).alias("rank")), valid.where("kind = 'url'"), "page", bounds.a, bounds.b)
    # a day's captures of one host or page, or those without any, may be a large share of all: they are dealt over several keys
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    by_host, by_page = by_host.select("*", salts), by_page.select("*", salts)
    return _decided(salted.join(by_host, ["host", "fetched_on", "salt"], "left").join(by_page, ["page", "fetched_on", "salt"], "left").select(*rows.columns, "host_entries", "page_entries"))


def _decided(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<rank:int,verdict:string,list:string>>")
    rows = rows.withColumn("active", F.concat(F.coalesce("host_entries", none), F.coalesce("page_entries", none)))
    best = F.array_max(F.transform("active", lambda x: F.struct(x["rank"], (x["verdict"] == "allow").alias("allow"))))
    verdict = F.when(best.isNull(), "none").when(best["allow"], "allow").otherwise("block")
    return rows.select(
        *[c for c in rows.columns if c not in ("active", "host_entries", "page_entries")],
        verdict.alias("verdict"),
        F.size("active").cast("long").alias("n_active"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("active", lambda x: x["list"]))), ",").alias("lists"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time, so the query gives each page a day of 2024 by its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    captures = common.table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_on"))
    return filtered(captures, entries(spark)).select("page_id", "fetched_on", "host", "verdict", "n_active", "lists")


ORACLE = (
    "WITH listed AS (SELECT list, verdict, kind, pattern, CAST(day AS DATE) AS d, action FROM (VALUES "
    + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in DEFAULT_ENTRIES)
    + r""") AS t(list, verdict, kind, pattern, day, action)),
days AS (SELECT list, verdict, kind, pattern, d, max(action = 'add') AS is_on FROM listed GROUP BY ALL),
spans AS (SELECT *, lead(d) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY d) AS until FROM days),
captures AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(((page_id * 7919) % 366 + 366) % 366 AS INTEGER) AS DATE) AS fetched_on,
    nullif(lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:.*@)?([^@:]*)', 1)), '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    row_number() OVER () AS r
  FROM pages),
met AS (
  SELECT c.r, s.list, s.verdict, CASE WHEN s.kind = 'url' THEN 1000 ELSE len(string_split(s.pattern, '.')) END AS specific
  FROM captures c JOIN spans s ON s.is_on AND c.fetched_on >= s.d AND (s.until IS NULL OR c.fetched_on < s.until)
    AND ((s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern))) OR (s.kind = 'url' AND c.host || c.path = s.pattern))),
summed AS (
  SELECT r, count(*) AS n, max(specific * 2 + CAST(verdict = 'allow' AS INTEGER)) AS best, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM met GROUP BY r)
SELECT page_id, fetched_on, host, CASE WHEN n IS NULL THEN 'none' WHEN best % 2 = 1 THEN 'allow' ELSE 'block' END AS verdict,
  CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists
FROM captures LEFT JOIN summed USING (r)"""
)
