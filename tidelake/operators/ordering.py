"""One order over all rows without one task that holds them: ranges, and offsets of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.sources.storage import shared_path

RANGE, PLACE = "_range", "_place"


def placed(rows: DataFrame, *order: Column, label: str = "ordered") -> DataFrame:
    """rows with RANGE and PLACE: by these two they are in order. A range exchange and sorts within, written once, so
    that the places stay what they are; there are as many ranges as shuffle partitions."""
    spark = rows.sparkSession
    path = shared_path(spark, label)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.select("*", F.col("_metadata.file_name").alias(RANGE), F.col("_metadata.row_index").alias(PLACE))


def before(found: DataFrame, amount: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """placed rows with `name`: the sum of amount over all rows (of the same `by`) before this one. A window within each
    range, and one over a row per range."""
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy(*by, RANGE).agg(F.sum(amount).alias("_sum"))
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier(*by).orderBy(RANGE)), F.lit(0))).drop("_sum")
    within = F.coalesce(F.sum(amount).over(earlier(*by, RANGE).orderBy(PLACE)), F.lit(0))
    return found.withColumn("_within", within).join(F.broadcast(sums), [*by, RANGE]).withColumn(name, (F.col("_within") + F.col("_offset")).cast("bigint")).drop("_within", "_offset", RANGE, PLACE)
