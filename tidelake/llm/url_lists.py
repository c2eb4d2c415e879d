"""Temporal list join, in DataFrame operations only: dated list entries against the fetch times of captures.

Entries of one pattern become validity intervals (from an entry's date to the next one's). A capture matches a
pattern that is its URL, its host, or a domain above its host, so it has a few keys. The as-of join lays the
intervals' beginnings and the captures of a pattern in one order of time; each capture sees the last beginning
before it, so an entry that was toggled any number of times costs each capture one look. A pattern with more than a
thousandth of all capture keys is split: its captures are dealt over parts by hash, and each part gets a copy of the
pattern's intervals; there are at most a thousand such patterns, with two thousand parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import checked, staged

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Hosts that are addresses, which have no domains above them.
ADDRESS = r"^(\d+\.\d+\.\d+\.\d+|\[.*)$"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without a final dot; "" if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, valid_from, valid_to) from entries (pattern, category, listed_at, action).

    Patterns are compared in lower case, those that are hosts without a final dot. action is "add" or "remove"; an
    entry is in force from listed_at until the next entry of its pattern, or without end (null). Of entries of one
    pattern and time the last by action, then category, counts. Entries with a null pattern or time are void.
    """
    pattern = F.regexp_replace(F.lower("pattern"), r"^([^/]*)\.$", "$1")
    valid = entries.where("pattern is not null and listed_at is not null").withColumn("pattern", pattern)
    same_time = valid.groupBy("pattern", "listed_at").agg(F.max(F.struct(F.coalesce("action", F.lit("")).alias("action"), F.coalesce("category", F.lit("")).alias("category"))).alias("e"))
    ends = same_time.withColumn("valid_to", F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at")))
    return ends.where("e.action = 'add'").select("pattern", F.col("e.category").alias("category"), F.col("listed_at").alias("valid_from"), "valid_to")


def keys_of(url: Column) -> Column:
    """The patterns that cover a URL: the URL itself, its host, and every domain above with at least two labels. An IPv4
    or IPv6 address has no domain above it."""
    whole = host(url)
    labels = F.split(whole, r"\.")
    depth = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, depth), "."))
    domains = F.when(whole.rlike(ADDRESS), F.array(whole)).otherwise(domains)
    return F.array_distinct(F.array_append(F.filter(domains, lambda d: d != ""), F.lower(url)))


def as_of(keys: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """(_url, _time, pattern, category, valid_from) of the keys (_url, _time, pattern) that an interval covers. Patterns
    with more than `least` keys are split into parts of about so many."""
    parts = F.ceil(F.col("count") / least).cast("int")
    hot = staged(keys.groupBy("pattern").count().where(F.col("count") > least).select("pattern", parts.alias("parts")), "hot-patterns")
    count = F.coalesce("parts", F.lit(1))
    dealt = keys.join(F.broadcast(hot), "pattern", "left").withColumn("part", F.pmod(F.xxhash64("_url", "_time"), count.cast("long")).cast("int"))
    starts = lists.join(F.broadcast(hot), "pattern", "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    nothing = F.lit(None)
    entry = F.struct("category", "valid_from", "valid_to")
    url, time = keys.schema["_url"].dataType, keys.schema["_time"].dataType
    kind = starts.select(entry.alias("e")).schema["e"].dataType
    line = starts.select("pattern", "part", F.col("valid_from").cast(time).alias("_time"), nothing.cast(url).alias("_url"), entry.alias("e"))
    line = line.unionByName(dealt.select("pattern", "part", "_time", "_url", nothing.cast(kind).alias("e")))
    before = Window.partitionBy("pattern", "part").orderBy("_time", F.col("_url").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("e", F.last("e", ignorenulls=True).over(before)).where("_url is not null and e is not null")
    return seen.where(F.col("e.valid_to").isNull() | (F.col("_time") < F.col("e.valid_to"))).select("_url", "_time", "pattern", "e.category", "e.valid_from")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with `blocked` (boolean), `matched_pattern`, `matched_category`, `listed_at`: the longest pattern in
    force at the capture's time, then the first in order.

    Hostless URLs match by the whole URL alone, null URLs and null times nothing. Rows that repeat in URL and time get
    equal results. Columns of captures with one of the new names are replaced.
    """
    lists = staged(intervals(entries), "intervals")
    rows = captures.drop("blocked", "matched_pattern", "matched_category", "listed_at")
    able = F.col(url_col).isNotNull() & F.col(time_col).isNotNull()
    wanted = rows.where(able).groupBy(F.col(url_col).alias("_url"), F.col(time_col).alias("_time")).agg(F.count("*").alias("_n"))
    keys = wanted.withColumn("pattern", F.explode(keys_of(F.col("_url"))))
    named = staged(keys.join(checked(staged(lists.select("pattern").distinct(), "patterns")), "pattern", "left_semi"), "capture-keys")
    hits = as_of(named.select("_url", "_time", "pattern"), lists, max(100, named.count() // 1000))
    best = hits.groupBy("_url", "_time").agg(F.min(F.struct((-F.length("pattern")).alias("n"), "pattern", "category", "valid_from")).alias("m"))
    best = staged(best.join(named.select("_url", "_time", "_n").distinct(), ["_url", "_time"]), "matches")
    # a URL and time that a thousandth of all captures repeat is one of a thousand; rows without either meet nothing
    often = F.col("_n") >= max(1000, rows.where(able).count() // 1000)
    same = lambda b: (F.col(url_col) == b["_url"]) & (F.col(time_col) == b["_time"])
    match = F.col("_m")
    heavy, light = best.where(often), best.where(~often)
    heavy = heavy.select("_url", "_time", F.col("m").alias("_h"))
    light = light.select("_url", "_time", F.col("m").alias("_m"))
    joined = rows.where(able).join(F.broadcast(heavy), same(heavy), "left").drop("_url", "_time")
    done = joined.where("_h is not null").withColumnRenamed("_h", "_m")
    rest = joined.where("_h is null").drop("_h").join(light, same(light), "left").drop("_url", "_time")
    other = rows.where(~able).withColumn("_m", F.lit(None).cast(best.schema["m"].dataType))
    columns = [*rows.columns, "_m"]
    found = rest.select(columns).unionByName(done.select(columns)).unionByName(other.select(columns))
    return found.select(*rows.columns, match.isNotNull().alias("blocked"), match["pattern"].alias("matched_pattern"), match["category"].alias("matched_category"), match["valid_from"].alias("listed_at"))
