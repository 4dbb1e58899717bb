"""URL filter with dated lists (operator 7): built-in functions only.

List events become validity intervals; every capture is judged by the entries
in force when it was fetched, for its host and each parent domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of one time bucket of the as-of join.
BUCKET_DAYS = 64
#: Longest valid host name; longer ones are looked up as they are, without parents.
HOST_CHARS = 253


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without port, user and last dot; null if there is none. IPv6 hosts keep their brackets."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/:?#]+)", 1)
    plain = F.regexp_replace(found, r"\.$", "")
    return F.when(plain != "", plain)


def lookup_keys(name: Column) -> Column:
    """A host and its parent domains of two labels at least; an IPv6 host has none."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(parts, i, n), "."))
    return F.when((F.length(name) <= HOST_CHARS) & (n > 1) & ~name.startswith("["), parents).otherwise(F.array(name))


def intervals(events: DataFrame) -> DataFrame:
    """Validity intervals (key, category, valid_from, valid_to) of dated events (key, category, action, day).

    An ``add`` holds from its day until the entry's next event (open without
    one); of events on one day the last by (action, which puts add before
    remove) counts. Events without key or day are void.
    """
    order = Window.partitionBy("key", "category").orderBy("day", "action")
    known = events.where(F.col("key").isNotNull() & F.col("day").isNotNull()).select("key", "category", "action", "day").distinct()
    return known.withColumn("valid_to", F.lead("day").over(order)).where("action = 'add'") \
        .where("valid_to is null or valid_to > day").select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """page_id, url, fetched, host, n_active, blocked, entry and category of every capture.

    ``n_active`` entries held on the day of the fetch; ``entry`` is the most
    specific of them (the longest key, then the first category). Captures
    without a host or a fetch day are not blocked. Exactly repeated captures
    count once; null ids are kept; an empty list blocks nothing; other columns
    are ignored.

    The as-of join is an equi-join on key and time bucket with the interval as
    a condition: an interval goes to each bucket between the first and the
    last fetch that it touches, so an entry with a long history meets a
    capture only with its bucket's part. A hot host is split by Spark's skew
    join; the list is broadcast only if Spark finds it small.
    """
    known = captures.select("page_id", "url", "fetched").distinct().withColumn("host", host(F.col("url")))
    first, last = known.agg(F.min("fetched"), F.max("fetched")).first()
    bucket = lambda c: F.floor(F.unix_date(c) / bucket_days)
    span = intervals(events)
    if last is not None:
        begin = F.greatest(F.col("valid_from"), F.lit(first))
        end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
        span = span.where(begin <= end).withColumn("bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    else:
        span = span.withColumn("bucket", F.lit(0).cast("long")).where("false")
    span = span.select(F.col("key").alias("k"), "category", "valid_from", "valid_to", F.col("bucket").alias("b"))
    asked = known.withColumn("key", F.explode_outer(F.when(F.col("host").isNotNull(), lookup_keys(F.col("host"))))) \
        .withColumn("bucket", bucket(F.col("fetched")))
    holds = (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")) & (F.col("fetched") >= F.col("valid_from")) \
        & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    best = F.min(F.when(F.col("k").isNotNull(), F.struct(-F.length("k"), F.col("category"), F.col("k").alias("k"))))
    out = asked.join(span, holds, "left").groupBy("page_id", "url", "fetched", "host").agg(
        F.count("k").alias("n_active"), best.alias("best"))
    return out.select("page_id", "url", "fetched", "host", "n_active", (F.col("n_active") > 0).alias("blocked"),
                      F.col("best.k").alias("entry"), F.col("best.category").alias("category"))
