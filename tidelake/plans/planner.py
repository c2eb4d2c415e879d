"""Decisions over health relations: what to maintain, and why. Pure functions of relations, policy and clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.operators.health import is_settled, output_estimate


def compaction(health: DataFrame, *, now_ms: int, min_age_ms: int, small_ratio: float, min_inputs: int, delete_ratio: float, target: int, current_spec: int) -> DataFrame:
    """health with the triggers of each partition, what would be read and written, and the decision.

    In this order: unsettled partitions are left; small files, oversized files and deletes trigger; with a delete file
    every file is read, else those outside the size band; a rewrite for small files alone must lower the number of
    files; a superseded partition spec is counted, not rewritten.
    """
    with_deletes = (F.col("position_deletes") + F.col("equality_deletes")) > 0
    in_band = F.col("small_files") + F.col("large_files")
    by_small = (F.col("small_ratio") >= small_ratio) & (in_band >= min_inputs)
    by_large = F.col("large_files") > 0
    by_deletes = with_deletes & (F.col("delete_ratio") >= delete_ratio)
    found = health.where("data_files > 0").withColumns({
        "settled": is_settled(F.col("newest_ms"), now_ms, min_age_ms), "by_small": by_small, "by_oversized": by_large, "by_deletes": by_deletes,
        "inputs": F.when(with_deletes, F.col("data_files")).otherwise(in_band), "input_bytes": F.when(with_deletes, F.col("data_bytes")).otherwise(F.col("eligible_bytes")),
    })
    found = found.withColumn("outputs", output_estimate(F.col("input_bytes"), F.col("delete_ratio"), target))
    triggered = F.col("by_small") | F.col("by_oversized") | F.col("by_deletes")
    decision = (
        F.when(~F.col("settled"), "unsettled").when(~triggered, "healthy")
        .when(~(F.col("by_deletes") | F.col("by_oversized")) & (F.col("outputs") >= F.col("inputs")), "no gain")
        .when(F.col("spec_id") != current_spec, "superseded spec").otherwise("compact")
    )
    reason = F.when(F.col("by_deletes"), "deletes").when(F.col("by_small"), "small files").when(F.col("by_oversized"), "oversized files")
    return found.withColumns({"decision": decision, "reason": F.when(decision == "compact", reason)})


def rewrite_manifests(undersized: Column, size: Column, min_count: int, target: int) -> Column:
    """The number of manifests after a rewrite; null if none is due."""
    return F.when(undersized >= min_count, F.greatest(F.lit(1), F.ceil(size / F.lit(float(target)))).cast("bigint"))


def expire(snapshots: Column, oldest_age_ms: Column, keep: int, max_age_ms: int) -> Column:
    """How many snapshots may go; null if none is due."""
    return F.when((snapshots > keep) & (oldest_age_ms > max_age_ms), snapshots - keep)


def scan_orphans(enabled: Column, last_scan_ms: Column, now_ms: int, interval_ms: int) -> Column:
    return enabled & F.coalesce(F.lit(now_ms) - last_scan_ms >= interval_ms, F.lit(True))
