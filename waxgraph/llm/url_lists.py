"""Temporal list join: captures against dated URL list entries as they stood at fetch time.

The entries of a pattern become validity intervals, each from its day to the day of the
next entry. A capture looks up the patterns its URL can match, and the one interval that
holds its fetch day says whether it was listed. Intervals are laid out in periods of
fixed length, so that the join is an equality on pattern and period, with the interval
test on the few rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph.llm.common import prepare

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
# Days in a period.
PERIOD = 32


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where the text is no URL."""
    return F.lower(F.regexp_extract(url, SCHEME + "([^/?#:]*)", 1))


def patterns_of(url: Column) -> Column:
    """What a list may name to match a URL: host, its parent domains of two labels or more, host and first path part."""
    host = host_of(url)
    labels = F.split(host, "[.]")
    first = F.regexp_extract(url, SCHEME + "[^/?#]*/([^/?#]+)", 1)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    with_path = F.when(first != "", F.array(F.concat(host, F.lit("/"), first, F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, with_path)))


def validity(entries: DataFrame) -> DataFrame:
    """``pattern, since, until`` while listed, from ``pattern, dated, listed``; an open end is null.

    Of a day's entries for one pattern, one that lists it wins. Entries without a
    pattern, day or flag say nothing.
    """
    daily = (
        entries.where("pattern is not null and dated is not null and listed is not null")
        .groupBy("pattern", "dated").agg(F.bool_or("listed").alias("listed"))
    )
    order = Window.partitionBy("pattern").orderBy("dated")
    return (
        daily.select("pattern", F.col("dated").alias("since"), F.lead("dated").over(order).alias("until"), "listed")
        .where("listed").drop("listed")
    )


def _period(day: Column) -> Column:
    return F.floor(F.unix_date(day) / PERIOD)


def evaluate(
    captures: DataFrame, entries: DataFrame, id_column: str = "id", url_column: str = "url", day_column: str = "fetched"
) -> DataFrame:
    """``id, host, listed, pattern, since`` for every capture.

    ``pattern`` is the longest that listed the URL on its day, ties by alphabet, and
    ``since`` the day it was last put on the list. Without a URL, a host or a day nothing
    matches. Repeated captures stay rows; further columns are not looked at. With no
    entries no capture is listed; with no captures the result is empty.
    """
    prepare(captures.sparkSession)
    seen = (
        captures.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(day_column).cast("date").alias("fetched"))
        .groupBy("id", "url", "fetched").agg(F.count("*").alias("n"))
    )
    last = seen.agg(F.max("fetched")).first()[0]
    end = F.lit(last).cast("date")
    intervals = validity(entries).where(F.col("since") <= end).select(
        "pattern", "since", "until",
        F.explode(F.sequence(_period(F.col("since")), _period(F.least(F.coalesce("until", end), end)))).alias("period"),
    )
    keys = seen.select(
        "id", "url", "fetched", "n",
        F.explode_outer(patterns_of(F.coalesce("url", F.lit("")))).alias("pattern"),
        _period(F.col("fetched")).alias("period"),
    )
    inside = (keys.fetched >= intervals.since) & (intervals.until.isNull() | (keys.fetched < intervals.until))
    met = keys.join(
        intervals, (keys.pattern == intervals.pattern) & (keys.period == intervals.period) & inside, "left"
    ).select("id", "url", "fetched", "n", intervals.pattern.alias("pattern"), "since")
    best = F.struct(F.length("pattern").alias("length"), "pattern", "since")
    found = met.groupBy("id", "url", "fetched", "n").agg(F.max(F.when(F.col("pattern").isNotNull(), best)).alias("best"))
    return found.select(
        "id",
        host_of(F.coalesce("url", F.lit(""))).alias("host"),
        F.col("best").isNotNull().alias("listed"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.since").alias("since"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
