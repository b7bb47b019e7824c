"""URL filters by a temporal list join.

A list is a table of dated entries ``(pattern, day, action)``; a pattern is a
host or a parent domain of hosts, either alone or with the first segment of the
path (``example.org`` or ``example.org/shop``). An entry holds from its day until
the pattern's next entry, so the entries of a pattern become validity intervals.
Every capture is then evaluated against the intervals active on its day: an
as-of join.

Captures of one site (host and first segment) see the same patterns. So the
intervals of a site are gathered once per distinct site, and captures join them
on the site: one row for each capture, however many entries there are. Sites are
counted first: one that holds more than a thousandth of all captures is dealt to
as many parts as it holds thousandths, each with its copy of the site's intervals;
all other sites have one copy.

Edge cases: a null or malformed URL has no host and is not blocked; user names and ports
are no part of a host, nor is a dot at its end, and addresses have no parents; URLs of any
length are looked at as wholes; a null day
is evaluated as not blocked; of several entries of a pattern on one day a
removal wins; entries with a null pattern or day take no part; of several active
patterns the longest is named, then the first in code-point order; repeated rows
are independent; an empty list blocks nothing; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise

#: A site that holds more than this share of all captures (1 / SHARES) is dealt to parts of that size.
SHARES = 1000

#: The host is what follows the last @, up to a port; an IPv6 address stands in brackets.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
_ADDRESS = r"^\[|^[0-9]+(\.[0-9]+){3}$"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host without the root's dot at its end, null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """First segment of the path, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))


def patterns_of(host: Column, segment: Column) -> Column:
    """All patterns that can match: the host and its parents (an address has none), with and without the segment."""
    labels = F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    with_segment = F.transform(domains, lambda d: F.concat(d, F.lit("/"), segment))
    return F.when(segment == "", domains).otherwise(F.concat(domains, with_segment))


def intervals(entries: DataFrame) -> DataFrame:
    """``(pattern, since, until)``: when each pattern is listed; ``until`` is exclusive, null if open."""
    day = (
        entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull())
        .groupBy("pattern", "day")
        .agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    )
    order = Window.partitionBy("pattern").orderBy("day")
    return (
        day.withColumn("until", F.lead("day").over(order))
        .where("removed = 0")
        .select("pattern", F.col("day").alias("since"), "until")
    )


def filter_urls(
    captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "day"
) -> DataFrame:
    """``(key, host, day, blocked, pattern, since)`` for every row of captures."""
    seen = captures.select(
        column(key).alias("key"), column(day).alias("day"), host_of(column(url)).alias("host"),
        segment_of(column(url)).alias("seg"),
    )
    sites = materialise(seen.where(F.col("host").isNotNull()).groupBy("host", "seg").agg(F.count("*").alias("n")))
    total = sites.agg(F.sum("n").alias("total"))  # one row
    hot = sites.join(F.broadcast(total)).where(F.col("n") * SHARES > F.col("total"))
    # Fewer than SHARES rows, since each stands for more than such a share.
    hot = F.broadcast(hot.select("host", "seg", F.ceil(F.col("n") * SHARES / F.col("total")).cast("int").alias("parts")))
    rules = (
        sites.withColumn("pattern", F.explode(patterns_of(F.col("host"), F.col("seg"))))
        .join(intervals(entries), "pattern")
        .groupBy("host", "seg")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.length("pattern")).alias("n"), "pattern", "since", "until"))
            ).alias("rules")
        )
    )
    active = F.get(
        F.filter(
            "rules",
            lambda r: (r["since"] <= F.col("day")) & (r["until"].isNull() | (F.col("day") < r["until"])),
        ),
        F.lit(0),
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = seen.join(hot, ["host", "seg"], "left").withColumn("salt", F.pmod(F.xxhash64("key", "day"), parts).cast("int"))
    copies = rules.join(hot, ["host", "seg"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    copies = copies.drop("parts")
    return dealt.join(copies, ["host", "seg", "salt"], "left").withColumn("hit", active).select(
        F.col("key").alias(key),
        "host",
        "day",
        F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.pattern").alias("pattern"),
        F.col("hit.since").alias("since"),
    )


# --- the list and the fetch days of the registered query -----------------------------------


def _draw(text: Column) -> Column:
    """A number from 0 to 2**24 - 1 that a text determines."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def fetch_days(pages: DataFrame) -> DataFrame:
    """pages with a fetch day in 2024 that page_id determines (the table has none)."""
    turn = F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")
    return pages.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), turn))


def listed_patterns(pages: DataFrame) -> DataFrame:
    """Dated entries that patterns of the pages' own sites determine.

    A third of the patterns is added on some day of the year, removed 20 to 119
    days later, and half of those are added again 30 days after that.
    """
    host, segment = host_of(F.col("url")), segment_of(F.col("url"))
    sites = pages.select(host.alias("host"), segment.alias("seg")).where("host is not null").distinct()
    every = sites.select(F.explode(patterns_of(F.col("host"), F.col("seg"))).alias("pattern")).distinct()
    drawn = every.withColumn("x", _draw(F.col("pattern"))).where("x % 3 = 0")
    first = F.expr("date_add(date'2024-01-01', int((x div 3) % 300))")
    gone = F.date_add(first, F.expr("int(20 + (x div 900) % 100)"))
    back = F.when(F.col("x") % 2 == 0, F.date_add(gone, 30))
    rows = F.array(
        F.struct(first.alias("day"), F.lit("add").alias("action")),
        F.struct(gone.alias("day"), F.lit("remove").alias("action")),
        F.struct(back.alias("day"), F.lit("add").alias("action")),
    )
    return drawn.select("pattern", F.inline(rows)).where("day is not null")


ORACLE = r"""
WITH seen AS (
  SELECT page_id, (DATE '2024-01-01' + ((page_id * 37) % 366)::INT)::DATE AS day,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') AS host,
         coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS seg
  FROM pages
), site AS (SELECT DISTINCT host, seg FROM seen WHERE host IS NOT NULL),
domain AS (
  SELECT host, seg, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)),
         lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS d
  FROM site
), candidate AS (
  SELECT host, seg, d AS pattern FROM domain
  UNION ALL SELECT host, seg, d || '/' || seg FROM domain WHERE seg <> ''
), drawn AS (
  SELECT pattern, ('0x' || md5(pattern)[1:6])::INT AS x FROM (SELECT DISTINCT pattern FROM candidate)
), listed AS (
  SELECT pattern, x, (DATE '2024-01-01' + ((x // 3) % 300))::DATE AS first,
         (DATE '2024-01-01' + ((x // 3) % 300) + (20 + (x // 900) % 100))::DATE AS gone
  FROM drawn WHERE x % 3 = 0
), span AS (
  SELECT pattern, first AS since, gone AS until FROM listed
  UNION ALL SELECT pattern, (gone + 30)::DATE, NULL FROM listed WHERE x % 2 = 0
), hit AS (
  SELECT page_id, s.day, c.pattern, p.since,
         row_number() OVER (PARTITION BY page_id ORDER BY length(c.pattern) DESC, c.pattern, p.since) AS r
  FROM seen s JOIN candidate c ON s.host = c.host AND s.seg = c.seg
  JOIN span p ON p.pattern = c.pattern AND p.since <= s.day AND (p.until IS NULL OR s.day < p.until)
)
SELECT page_id, host, seen.day, hit.pattern IS NOT NULL AS blocked, hit.pattern, since
FROM seen LEFT JOIN (SELECT * FROM hit WHERE r = 1) hit USING (page_id)
"""
