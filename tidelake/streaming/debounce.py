"""Debounced change notifications: a window opens at the first event, closes after a fixed time, and then names every
table that changed. Later events do not extend it, so it is neither a session window nor a fixed grid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _kept(df: DataFrame) -> DataFrame:
    """df, computed once: into the checkpoint folder where one is set, else (one process) with the executors."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.localCheckpoint()


def windows(events: DataFrame, key: str, at: str, length: int) -> DataFrame:
    """Batch form: (key, opened_at, events). Times are whole numbers; an event at exactly the close opens the next
    window. Null times do not count, a null key is a key.

    No task holds a key: the distinct times, and for each the probe `length` later, are sorted into ranges, and what a
    range's neighbours know is carried over its bounds. A probe finds the event that opens the next window if its own
    event opened one. A time at least `length` after the one before always opens one; from these the jumps are followed
    by pointer doubling, in rounds that grow with the logarithm of the longest run of windows without such a gap.
    """
    times = events.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("k"), F.col(at).cast("bigint").alias("t")).agg(F.count("*").alias("n"))
    probes = times.select("k", (F.col("t") + length).alias("t"), F.lit(None).cast("bigint").alias("n"))
    placed = _kept(times.unionByName(probes).repartitionByRange("k", "t").withColumn("p", F.spark_partition_id()))
    found = F.when(F.col("n").isNotNull(), F.col("t"))
    within = Window.partitionBy("p", "k")
    ranges = Window.partitionBy("k").orderBy("p")
    earlier, later = ranges.rowsBetween(Window.unboundedPreceding, -1), ranges.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("k", "p").agg(F.min(found).alias("low"), F.max(found).alias("high"))
    ends = ends.select(F.col("k").alias("_k"), F.col("p").alias("_p"), F.max("high").over(earlier).alias("before"), F.min("low").over(later).alias("after"))
    carried = lambda rows, ends: rows.join(ends, F.col("k").eqNullSafe(F.col("_k")) & (F.col("p") == F.col("_p"))).drop("_k", "_p")
    aimed = placed.withColumn("to", F.min(found).over(within.orderBy(F.desc("t")))).withColumn("last", F.max(found).over(within.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)))
    aimed = _kept(carried(aimed, ends).select("k", "t", "n", F.coalesce("to", "after").alias("to"), F.coalesce("last", "before").alias("last")))

    opened = _kept(aimed.where(F.col("n").isNotNull() & (F.col("last").isNull() | (F.col("t") - F.col("last") >= length))).select("k", "t"))
    at_of = lambda rows, t: (rows.select(F.col("k").alias("_k"), F.col("t").alias("_t")), F.col("k").eqNullSafe(F.col("_k")) & (F.col(t) == F.col("_t")))
    jumps = aimed.where(F.col("n").isNull() & F.col("to").isNotNull()).select("k", (F.col("t") - length).alias("t"), "to")
    jumps = _kept(jumps.join(*at_of(opened, "to"), "left_anti"))
    starts = opened.unionAll(jumps.select("k", "to")).distinct()
    jumps = _kept(jumps.join(*at_of(starts, "t"), "left_semi"))
    while not jumps.isEmpty():
        on = jumps.select(F.col("k").alias("_k"), F.col("t").alias("_t"), F.col("to").alias("_to"))
        opened, jumps = (
            _kept(opened.unionAll(opened.join(on, F.col("k").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t"))).select("k", "_to")).distinct()),
            _kept(jumps.join(on, F.col("k").eqNullSafe(F.col("_k")) & (F.col("to") == F.col("_t"))).select("k", "t", F.col("_to").alias("to"))),
        )

    flagged = placed.where(F.col("n").isNotNull()).join(*at_of(opened, "t"), "left").select("k", "t", "n", "p", F.col("_t").alias("o"))
    ends = flagged.groupBy("k", "p").agg(F.max("o").alias("high")).select(F.col("k").alias("_k"), F.col("p").alias("_p"), F.max("high").over(earlier).alias("before"))
    of = carried(flagged.withColumn("o", F.max("o").over(within.orderBy("t"))), ends).select("k", F.coalesce("o", "before").alias("o"), "n")
    return of.groupBy("k", "o").agg(F.sum("n").alias("events")).select(F.col("k").alias(key), F.col("o").alias("opened_at"), "events")


class Debounce(StatefulProcessor):
    """Online form, for transformWithStateInPandas keyed by scope: rows (scope, table_name)."""

    def __init__(self, length_ms: int):
        self.length_ms = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "table_name string", "n long")
        self.closes = handle.getValueState("closes", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for name, n in batch.groupby("table_name").size().items():
                before = self.pending.getValue((name,))[0] if self.pending.containsKey((name,)) else 0
                self.pending.updateValue((name,), (before + int(n),))
        if not self.closes.exists():
            closes = timerValues.getCurrentProcessingTimeInMs() + self.length_ms
            self.closes.update((closes,))
            self.handle.registerTimer(closes)
        yield pd.DataFrame({"scope": [], "tables": [], "events": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((k[0], v[0]) for k, v in self.pending.iterator())
        self.pending.clear()
        self.closes.clear()
        yield pd.DataFrame({"scope": [key[0]], "tables": [",".join(n for n, _ in found)], "events": [sum(v for _, v in found)]})

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, length_ms: int) -> DataFrame:
    """A stream (scope, tables, events) from a stream of changes (scope, table_name). Needs the RocksDB state store."""
    return changes.groupBy("scope").transformWithStateInPandas(
        statefulProcessor=Debounce(length_ms), outputStructType="scope string, tables string, events long", outputMode="Append", timeMode="ProcessingTime"
    )
