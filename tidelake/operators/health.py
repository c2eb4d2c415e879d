"""Health of a table from its metadata relations: one aggregation each, nothing opened but metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def partition_health(files: DataFrame, deletes: DataFrame, small: int, large: int) -> DataFrame:
    """One row per (spec_id, part_key): counts, bytes, rows, deletes, newest file, ratios. Files and delete files are
    added up in one pass over their union, so a partition with deletes alone has a row too."""
    data = files.select("spec_id", "part_key", F.lit("data").alias("content"), "file_size", "record_count", "newest_ms")
    gone = deletes.select("spec_id", "part_key", "content", F.lit(None).cast("bigint").alias("file_size"), "record_count", F.lit(None).cast("bigint").alias("newest_ms"))
    is_data = F.col("content") == "data"
    is_large, is_small = is_data & (F.col("file_size") > large), is_data & (F.col("file_size") < small) & ~(F.col("file_size") > large)
    rows = data.unionByName(gone).groupBy("spec_id", "part_key").agg(
        F.count_if(is_data).alias("data_files"), total("file_size").alias("data_bytes"), total(F.when(is_data, F.col("record_count"))).alias("data_rows"),
        F.count_if(F.col("content") == "position").alias("position_deletes"), F.count_if(F.col("content") == "equality").alias("equality_deletes"),
        total(F.when(~is_data, F.col("record_count"))).alias("delete_rows"), F.max("newest_ms").alias("newest_ms"),
        F.count_if(is_small).alias("small_files"), F.count_if(is_large).alias("large_files"), total(F.when(is_small | is_large, F.col("file_size"))).alias("eligible_bytes"),
    )
    return rows.withColumns({
        "delete_ratio": F.when(F.col("data_rows") > 0, F.col("delete_rows") / F.col("data_rows").cast("double")).otherwise(0.0),
        "small_ratio": F.when(F.col("data_files") > 0, F.col("small_files") / F.col("data_files").cast("double")).otherwise(0.0),
    })


def nearest_ranks(sizes: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): the value at rank round(share * (n - 1)) of the ascending column, exactly.

    Values are first counted in buckets of a sixteenth of an octave (some hundreds, whatever the data), which tells
    the bucket of each rank; only these buckets are then sorted.
    """
    value = F.col(column)
    bucketed = sizes.select(value.alias("v"), F.when(value > 0, F.floor(F.log2(value) * 16)).otherwise(-1).alias("b"))
    counts = bucketed.groupBy("b").agg(F.count("*").alias("n"))
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(Window.partitionBy())})
    asked = placed.withColumn("share", F.explode(F.array(*[F.lit(float(min(max(p, 0.0), 1.0))) for p in shares]))).withColumn("rank", F.round(F.col("share") * (F.col("all") - 1)).cast("bigint"))
    asked = asked.where("rank >= upto - n and rank < upto").select("b", "share", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("inner_rank"))
    ordered = bucketed.join(F.broadcast(asked), "b").withColumn("at", F.row_number().over(Window.partitionBy("share", "b").orderBy("v")) - 1)
    return ordered.where("at = inner_rank").select("share", F.col("v").alias("value"))


def output_estimate(size: Column, delete_ratio: Column, target: int) -> Column:
    """How many files a rewrite of so many bytes gives."""
    left = F.floor(size * F.greatest(F.lit(0.0), 1 - delete_ratio))
    return F.when(size <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(left / F.lit(float(target))))).cast("bigint")


def is_settled(newest_ms: Column, now_ms: int, min_age_ms: int) -> Column:
    """A partition without a dated file is settled."""
    return F.coalesce(F.lit(now_ms) - newest_ms >= min_age_ms, F.lit(True))


def fragmentation(small_files: Column, small_ratio: Column) -> Column:
    return small_files * small_ratio


def snapshot_health(snapshots: DataFrame, now_ms: int) -> DataFrame:
    """Count, current and oldest snapshot; an oldest snapshot in the future has no age."""
    one = snapshots.agg(F.count("*").alias("snapshots"), F.max_by("snapshot_id", "timestamp_ms").alias("current_id"), F.min("timestamp_ms").alias("oldest_ms"))
    return one.select("snapshots", "current_id", F.when(F.col("oldest_ms") <= now_ms, F.lit(now_ms) - F.col("oldest_ms")).alias("oldest_age_ms"))


def manifest_health(manifests: DataFrame, target: int) -> DataFrame:
    return manifests.agg(F.count("*").alias("manifests"), total("length").alias("bytes"), F.count_if(F.col("length") < target).alias("undersized"), F.count_if(F.col("content") == "deletes").alias("delete_manifests"))


def live_and_dated(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """entries (status, snapshot_id, ...) without the deleted ones (status 2), with `dated_ms`, the time of the snapshot
    that added them; null if that snapshot is gone or unknown."""
    times = snapshots.select("snapshot_id", F.col("timestamp_ms").alias("dated_ms"))
    return entries.where("status <> 2").join(F.broadcast(times), "snapshot_id", "left")  # a row per snapshot of the table
