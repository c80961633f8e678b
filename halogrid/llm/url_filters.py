"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time.  DataFrame operations only.

A list is a log of dated entries: on a day, a key (a host or a domain) is added to or removed from a list.  Per list and
key the entries become half-open intervals in which it is active.  A capture asks for its host and every parent domain
at its fetch time.  Captures are first reduced to the different (host, day) pairs, so that a host with a third of all
captures is as many rows as it has days; the way back to the captures is an equi-join, whose hot pairs adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

#: Day 0 of the made list log and fetch days.
EPOCH = "2024-01-01"


def host_of(url) -> F.Column:
    """Lower-cased host of an http(s) URL, without user, port and a closing dot; null if there is none."""
    h = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, key, valid_from, valid_to (null: open), from entries (list_name, key, entry_date, action add or remove).

    Of several entries of one list and key on one day, remove wins.  Repeated adds continue an interval; a remove
    without an add does nothing.  Entries with a null, or another action, are left out.
    """
    e = entries.select("list_name", F.lower("key").alias("key"), F.col("entry_date").cast("date").alias("d"), F.lower("action").alias("action"))
    e = e.where("list_name is not null and key is not null and d is not null and action in ('add', 'remove')")
    e = e.groupBy("list_name", "key", "d").agg(F.min((F.col("action") == "add").cast("int")).alias("on"))
    w = W.partitionBy("list_name", "key").orderBy("d")  # the log of one key
    e = e.withColumn("was", F.lag("on", 1, 0).over(w)).where("on <> was")
    return e.withColumn("valid_to", F.lead("d").over(w)).where("on = 1").select("list_name", "key", F.col("d").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """captures (capture_id, url, fetch_date) with the lists that were active for them: one row per row of captures.

    capture_id, host, fetch_date, n_lists, lists (names, ascending, comma-joined), matched_key (longest), blocked (any list).
    A null or odd URL or a null date matches nothing.  Rows that repeat, and null ids, give a row each; other columns are ignored.
    """
    active = scratch.write(intervals(entries))
    c = captures.select("capture_id", host_of(F.col("url")).alias("host"), F.col("fetch_date").cast("date").alias("fetch_date"))
    pairs = c.where("host is not null and fetch_date is not null").select("host", "fetch_date").distinct()
    # A capture asks for its host and for every parent domain of two labels or more.
    asked = pairs.withColumn("key", F.explode(F.expr("transform(sequence(1, greatest(1, size(split(host, '[.]')) - 1)), i -> concat_ws('.', slice(split(host, '[.]'), i, 1000)))")))
    hits = asked.join(active, "key").where("valid_from <= fetch_date and (valid_to is null or fetch_date < valid_to)")
    found = hits.groupBy("host", "fetch_date").agg(
        F.array_sort(F.collect_set("list_name")).alias("names"),  # as many as there are lists
        F.max(F.struct(F.length("key").alias("n"), "key"))["key"].alias("matched_key"),
    )
    found = scratch.write(found)
    out = c.join(found, ["host", "fetch_date"], "left")
    return out.select(
        "capture_id", "host", "fetch_date",
        F.when(F.col("names").isNull(), F.lit(0)).otherwise(F.size("names")).cast("long").alias("n_lists"),
        F.coalesce(F.concat_ws(",", "names"), F.lit("")).alias("lists"), "matched_key", F.col("names").isNotNull().alias("blocked"),
    )


def dated_lists(pages: DataFrame) -> DataFrame:
    """A log of list entries about the hosts of pages, made by fixed rules, for want of a table of lists.

    By c, the first six hexadecimal digits of the md5 of a host or of its last two labels: 'malware' takes it in on day c % 200 and drops it 30 + c % 50 days
    later if c is even; 'adult' takes it in on day c % 150 if c % 3 = 0, and again 100 days later after a drop.
    """
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    keys = hosts.union(hosts.select(F.expr("concat_ws('.', slice(split(key, '[.]'), greatest(1, size(split(key, '[.]')) - 1), 2))"))).distinct().withColumn("c", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"))
    rules = (
        ("malware", "add", "c % 200", "true"), ("malware", "remove", "c % 200 + 30 + c % 50", "c % 2 = 0"),
        ("adult", "add", "c % 150", "c % 3 = 0"), ("adult", "remove", "c % 150 + 40", "c % 3 = 0"), ("adult", "add", "c % 150 + 100", "c % 3 = 0"),
    )
    e = F.explode(F.array(*(F.struct(F.lit(n).alias("list_name"), F.lit(a).alias("action"), F.expr(d).cast("int").alias("day"), F.expr(w).alias("ok")) for n, a, d, w in rules)))
    return keys.select("key", e.alias("e")).where("e.ok").select("e.list_name", "key", F.expr(f"date_add(date'{EPOCH}', e.day)").alias("entry_date"), "e.action")


def op5_url_filters(spark, sf_dir):
    """Every page, fetched on day page_id % 300, against the lists as they stood on that day."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.expr(f"date_add(date'{EPOCH}', cast(page_id % 300 as int))").alias("fetch_date"))
    out = evaluate(captures, dated_lists(pages), Scratch(spark))
    return out.select(F.col("capture_id").alias("page_id"), "host", F.datediff("fetch_date", F.lit(EPOCH).cast("date")).cast("long").alias("fetch_day"), "n_lists", "lists", "matched_key", "blocked")


ORACLE = r"""
WITH p AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '') AS host, page_id % 300 AS day FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
keys AS (SELECT host AS key FROM hosts UNION SELECT CASE WHEN len(string_split(host, '.')) > 2 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END FROM hosts),
c AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS c FROM keys),
log AS (
  SELECT 'malware' AS list_name, key, c % 200 AS d, 1 AS "on" FROM c
  UNION ALL SELECT 'malware', key, c % 200 + 30 + c % 50, 0 FROM c WHERE c % 2 = 0
  UNION ALL SELECT 'adult', key, c % 150, 1 FROM c WHERE c % 3 = 0
  UNION ALL SELECT 'adult', key, c % 150 + 40, 0 FROM c WHERE c % 3 = 0
  UNION ALL SELECT 'adult', key, c % 150 + 100, 1 FROM c WHERE c % 3 = 0),
iv AS (SELECT list_name, key, d AS f, lead(d) OVER (PARTITION BY list_name, key ORDER BY d) AS t, "on" FROM log),
hits AS (SELECT p.page_id, iv.list_name, iv.key FROM p JOIN iv ON iv."on" = 1 AND (p.host = iv.key OR ends_with(p.host, '.' || iv.key)) AND iv.f <= p.day AND (iv.t IS NULL OR p.day < iv.t)),
g AS (SELECT page_id, count(DISTINCT list_name) AS n, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, max_by(key, length(key)) AS k FROM hits GROUP BY page_id)
SELECT p.page_id, p.host, p.day::BIGINT AS fetch_day, coalesce(n, 0)::BIGINT AS n_lists, coalesce(lists, '') AS lists, k AS matched_key, n IS NOT NULL AS blocked
FROM p LEFT JOIN g USING (page_id)
"""
