"""URL filters: dated list entries as validity intervals, and an as-of join of every capture with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, others, tables

#: Parts over which the captures of one key are dealt when they meet the lists.
PARTS = 16
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]+(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def keys_of(url: Column) -> Column:
    """What a list entry may say to match a URL: its host, each parent domain of two labels or more, and its host with
    each leading run of path segments (``a.example.org/en``).  No keys if there is no host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    segments = F.filter(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), lambda s: s != "")
    m = F.size(segments)
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), m)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, entry, action, day)`` to ``(list, key, since, until)``: from an ``add`` to the day of the next
    change, ``until`` excluded, null if none follows.  Several changes of one day count as one, an ``add`` if there is
    any.  Rows with a null are left out.  A list and key has at most one row a day here, so no window is large."""
    days = entries.dropna(subset=["list", "entry", "action", "day"]).groupBy("list", F.lower("entry").alias("key"), "day").agg(F.max(F.col("action") == "add").alias("on"))
    after = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return days.withColumn("until", after).where("on").select("list", "key", F.col("day").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, per_salt: int = 4_000) -> DataFrame:
    """Evaluate every capture (``page_id, url, day``) against the entries active on its day.

    Returns ``page_id, host, day, n_active`` (active entries that match), ``lists`` (their lists, sorted, with commas),
    ``entry`` (the longest active entry, the first in order among equals), ``blocked`` and ``rest``.

    Rows are captures; equal rows have equal results.  A null or malformed URL has no host and matches nothing; a null
    day matches nothing.  Empty lists block nothing; an empty table gives no rows.

    The captures' keys are first joined with the distinct (list, key) pairs, which drops keys that no list has.  The
    as-of join is a union of captures and intervals in one window by (list, key) in order of days: the last interval
    begun is the only one that can hold the day.  A key with over ``per_salt`` captures is dealt over several windows,
    each with the key's intervals, so a host or domain that all captures share is spread.
    """
    base = captures.select("page_id", "url", F.col("day").cast("int").alias("day"), others(captures, "page_id", "url", "day").alias("rest"))
    valid = intervals(entries)
    # distinct (url, day): captures of one address on one day are evaluated once
    asked = base.select("url", "day").where("url IS NOT NULL AND day IS NOT NULL").distinct()
    keyed = asked.select("url", "day", F.explode(keys_of(F.col("url"))).alias("key"))
    # a key that all captures share would meet in one task, so the listed keys are repeated over a few parts
    keyed = keyed.withColumn("dealt", F.pmod(F.xxhash64("url", "day"), F.lit(PARTS)).cast("int"))
    listed = valid.select("key", "list").distinct().withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    keyed = keyed.join(listed, ["key", "dealt"]).drop("dealt")
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > per_salt).select("key", F.ceil(F.col("n") / per_salt).cast("int").alias("salts"))
    keyed = keyed.join(crowds, "key", "left").withColumn("salt", F.pmod(F.xxhash64("url", "day"), F.coalesce("salts", F.lit(1))).cast("int"))
    spread = valid.join(crowds, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    left = keyed.select("list", "key", "salt", F.col("day").alias("at"), F.lit(1).alias("asks"), "url", F.lit(None).cast("int").alias("since"), F.lit(None).cast("int").alias("until"))
    right = spread.select("list", "key", "salt", F.col("since").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("string").alias("url"), "since", F.coalesce("until", F.lit(2**31 - 1)).alias("until"))
    before = Window.partitionBy("list", "key", "salt").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    held = left.unionByName(right).withColumn("end", F.last("until", ignorenulls=True).over(before)).where((F.col("asks") == 1) & (F.col("at") < F.col("end")))
    found = held.groupBy("url", F.col("at").alias("day")).agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min(F.struct((-F.char_length("key")).alias("length"), "key"))["key"].alias("entry")
    )
    # written out: a join with an aggregate right below it can't have its skewed keys split
    found = cut(found.select(F.col("url").alias("u"), F.col("day").alias("d"), "n_active", "lists", "entry"))
    both = base.join(found, (F.col("url") == F.col("u")) & (F.col("day") == F.col("d")), "left")
    return both.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "day", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("entry", F.lit("")).alias("entry"), F.col("n_active").isNotNull().alias("blocked"), "rest")


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list history for tables that come without one, by rule from the first page of each host."""
    hosts = pages.where("url IS NOT NULL").groupBy(host_of(F.col("url")).alias("host")).agg(F.min("page_id").alias("k")).where("host <> ''")
    of = lambda name, entry, action, day: F.struct(F.lit(name).alias("list"), entry.alias("entry"), F.lit(action).alias("action"), day.cast("int").alias("day"))
    k, host = F.col("k"), F.col("host")
    domain = F.substring_index(host, ".", -2)
    changes = F.array(
        F.when(k % 3 == 0, of("ads", host, "add", k % 200)),
        F.when(k % 6 == 0, of("ads", host, "remove", k % 200 + 60)),
        F.when(k % 12 == 0, of("ads", host, "add", k % 200 + 100)),
        F.when(k % 7 == 0, of("paths", F.concat(host, F.lit("/en")), "add", k % 150)),
        F.when(k % 40 == 0, of("outage", domain, "add", k * 11 % 360)),
        F.when(k % 40 == 0, of("outage", domain, "remove", k * 11 % 360 + 2)),
    )
    return hosts.select(F.explode(F.array_compact(changes)).alias("c")).select("c.*")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") * 37 % 366).cast("int"))
    return url_filter(captures, demo_entries(pages)).select("page_id", "host", "day", "n_active", "lists", "entry", "blocked")


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(page_id * 37 % 366 AS INTEGER) AS day, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
                  coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]+(/[^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, min(page_id) AS k FROM p WHERE host <> '' GROUP BY host),
e AS (SELECT 'ads' AS list, host AS entry, 1 AS on_, k % 200 AS day FROM h WHERE k % 3 = 0
 UNION ALL SELECT 'ads', host, 0, k % 200 + 60 FROM h WHERE k % 6 = 0
 UNION ALL SELECT 'ads', host, 1, k % 200 + 100 FROM h WHERE k % 12 = 0
 UNION ALL SELECT 'paths', host || '/en', 1, k % 150 FROM h WHERE k % 7 = 0
 UNION ALL SELECT 'outage', array_to_string(string_split(host, '.')[-2:], '.'), 1, k * 11 % 360 FROM h WHERE k % 40 = 0
 UNION ALL SELECT 'outage', array_to_string(string_split(host, '.')[-2:], '.'), 0, k * 11 % 360 + 2 FROM h WHERE k % 40 = 0),
d AS (SELECT list, entry, day, max(on_) AS on_ FROM e GROUP BY list, entry, day),
v AS (SELECT list, entry, on_, day AS since, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS until FROM d),
a AS (SELECT p.page_id, v.list, v.entry FROM p JOIN (SELECT * FROM v WHERE on_ = 1) v
      ON p.day >= v.since AND (v.until IS NULL OR p.day < v.until)
     AND (p.host = v.entry OR ends_with(p.host, '.' || v.entry) OR (contains(v.entry, '/') AND starts_with(p.host || regexp_replace(p.path, '/+', '/', 'g') || '/', v.entry || '/')))),
g AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM a GROUP BY page_id),
b AS (SELECT page_id, entry FROM (SELECT page_id, entry, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry) AS r FROM a) WHERE r = 1)
SELECT p.page_id, p.host, p.day, coalesce(g.n_active, 0) AS n_active, coalesce(g.lists, '') AS lists, coalesce(b.entry, '') AS entry, g.n_active IS NOT NULL AS blocked
FROM p LEFT JOIN g ON g.page_id = p.page_id LEFT JOIN b ON b.page_id = p.page_id
"""
