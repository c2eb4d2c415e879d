"""What operations came to: counters, duration histograms, capped labels, rewrite summaries, row contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVER_CAP = "<over-cardinality-cap>"


def capped_names(rows: DataFrame, name: str, at: str, cap: int) -> DataFrame:
    """rows with `label`: the first `cap` names ever seen keep theirs, all later ones share one label."""
    first = rows.groupBy(name).agg(F.min(at).alias("_first"))
    kept = first.orderBy("_first", name).limit(cap).select(F.col(name).alias("_kept"))
    return rows.join(F.broadcast(kept), F.col(name) == F.col("_kept"), "left").withColumn("label", F.when(F.col("_kept").isNotNull(), F.col(name).cast("string")).otherwise(OVER_CAP)).drop("_kept")


def histogram(rows: DataFrame, value: str, buckets: int = 12) -> DataFrame:
    """Cumulative counts below 1, 2, 4, ... and for all: (bound, count); an infinite bound is null. Rows are counted
    once by their own bucket; only the few counts are added up."""
    bound = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(value), F.lit(1e-9))))).cast("int")
    own = rows.where(F.col(value).isNotNull()).groupBy(F.least(bound, F.lit(buckets)).alias("i")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("i"))
    summed = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(F.broadcast(own), "i", "left").select(F.when(F.col("i") < buckets, F.pow(F.lit(2.0), F.col("i"))).alias("bound"), summed.cast("bigint").alias("count"))


def rewrite_counts(entries: DataFrame) -> DataFrame:
    """entries (gone, content, file_size, record_count): files, bytes and rows removed and surviving, by content."""
    out = []
    for gone, word in ((True, "removed"), (False, "surviving")):
        for content in ("data", "position", "equality"):
            hit = (F.col("gone") == gone) & (F.col("content") == content)
            out += [F.count_if(hit).alias(f"{word}_{content}_files"), F.coalesce(F.sum(F.when(hit, F.col("file_size"))), F.lit(0)).cast("bigint").alias(f"{word}_{content}_bytes"), F.coalesce(F.sum(F.when(hit, F.col("record_count"))), F.lit(0)).cast("bigint").alias(f"{word}_{content}_rows")]
    return entries.agg(*out)


def row_contract(files: DataFrame, *keys: str) -> DataFrame:
    """files (record_count, n_deletes) by keys: the most and the fewest rows a rewrite may give; null if a file does not
    say how many it has."""
    unknown = F.bool_or(F.col("record_count").isNull())
    ceiling, floor = F.sum("record_count"), F.sum(F.when(F.col("n_deletes") == 0, F.col("record_count")).otherwise(0))
    return files.groupBy(*keys).agg(F.when(~unknown, ceiling).cast("bigint").alias("ceiling"), F.when(~unknown, floor).cast("bigint").alias("floor"))


def violation(produced: Column, persisted: Column, floor: Column, ceiling: Column) -> Column:
    return F.when(produced > ceiling, "more rows than the inputs hold").when(produced < floor, "fewer rows than the inputs must keep").when(persisted != produced, "written rows differ from produced rows")
