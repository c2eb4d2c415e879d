"""Exact dedup with a heavy-hitter split.

Every task summarises its digests by Misra-Gries; the summaries are added up in a shuffle of at most
(tasks x counters) rows. A digest that holds at least the share `phi` of all rows has a summed counter of at
least (phi - 1 / (counters + 1)) of all rows, so at most 1 / (phi - 1 / (counters + 1)) digests come into
question: that is the proven bound of what is broadcast. Their exact sizes and winners are then aggregated with
map-side combination (verification), and their rows are decided where they are read. All other digests, each
below the share, go through an ordinary shuffle and window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import checked, free_name, staged

#: The characters that do not count, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
#: A digest of this share of the rows is heavy; the summary has so many counters a task.
PHI, COUNTERS = 1 / 1000, 2000


def misra_gries(keys: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The mergeable-summaries step: with more keys than counters, the (counters + 1)-th largest count is taken
    from all, and what is left above nought stays."""
    if len(keys) <= counters:
        return keys, counts
    cut = np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
    stays = counts > cut
    return keys[stays], counts[stays] - cut


def _summary(counters: int):
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, n = np.unique(batch["h"].to_numpy(), return_counts=True)
            merged, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            keys, counts = misra_gries(merged, np.bincount(at, np.concatenate([counts, n])).astype(np.int64), counters)
        yield pd.DataFrame({"h": keys, "n": counts})

    return summarise


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float = PHI, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id_col, digest (binary SHA-256 of the text without blanks), code_points, keep_id,
    group_size, kept.

    Of equal texts the row with the most code points stays, then the smallest id; a null id loses against any
    other. A null text counts as empty, and all empty texts are equal. Of repeated rows that would all win,
    exactly one has kept = true. An empty table gives an empty result; other columns of docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = staged(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"), F.char_length(text).cast("long").alias("code_points")),
        "digests",
    )
    rows = digests.count()
    least = max(2, int((phi - 1 / (counters + 1)) * rows))
    parts = digests.select(F.xxhash64("digest").alias("h")).mapInPandas(_summary(counters), "h long, n long")
    candidates = parts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")
    order = F.struct((-F.col("code_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"))
    heavy = (
        digests.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi")
        .groupBy("digest")
        .agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= least)
        .select("digest", F.col("best.c").alias("keep_id"), (-F.col("best.a")).alias("most"), "group_size")
    )
    heavy = staged(heavy, "heavy")  # the verified winners: at most rows / least
    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("code_points") == F.col("most"))
    hot = digests.join(F.broadcast(heavy), "digest").withColumn("wins", wins)
    columns = ["id", "digest", "code_points", "keep_id", "group_size", "kept"]
    of_hot = hot.where(~F.col("wins")).withColumn("kept", F.lit(False)).select(columns)
    # repeated rows that would all win are counted where they are read; one of the first place that has any is kept
    won = staged(hot.where("wins").groupBy(*columns[:-1], F.spark_partition_id().alias("place")).agg(F.count("*").cast("int").alias("n")), "winners")
    firsts = won.groupBy("digest").agg(F.min("place").alias("first"))
    won = won.join(F.broadcast(firsts), "digest").withColumn("nth", F.explode(F.sequence(F.lit(1), "n")))
    hot_winners = won.withColumn("kept", (F.col("nth") == 1) & (F.col("place") == F.col("first"))).select(columns)
    group = Window.partitionBy("digest")
    best = group.orderBy(F.col("code_points").desc(), F.col("id").asc_nulls_last())
    rest = (
        digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("keep_id", F.first("id").over(best))
        .withColumn("kept", F.row_number().over(best) == 1)
        .withColumn("group_size", F.count("*").over(group))
        .select(columns)
    )
    return rest.unionAll(of_hot).unionAll(hot_winners).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phi: float = PHI, counters: int = COUNTERS) -> DataFrame:
    """docs without the rows that decide() drops; columns as in docs. Of rows that repeat in id and text, the one
    whose columns hash smallest stays."""
    made, digest, key = (free_name(docs, x) for x in ("dedup_rows", "dedup_digest", "dedup_id"))
    by = decide(docs, id_col, text_col, phi, counters).groupBy(F.col(id_col).alias(key), F.col("digest").alias(digest))
    keys = by.agg(F.count_if("kept").alias("n_kept"), F.count("*").alias(made))
    gone = keys.where("n_kept = 0").select(key, digest)
    repeated = keys.where(f"n_kept > 0 and {made} > 1").select(key, digest)
    hashed = F.unhex(F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), BLANKS, ""), 256))
    changed = staged(gone.withColumn(made, F.lit(False)).unionAll(repeated.withColumn(made, F.lit(True))), "dedup-keys")
    rows = docs.withColumn(digest, hashed)
    on = lambda other: F.col(id_col).eqNullSafe(F.col(key)) & (rows[digest] == other[digest])
    losers = checked(changed)
    plain = rows.join(losers, on(changed), "left_anti").select(docs.columns)
    again = changed.where(made)
    if again.isEmpty():
        return plain
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.join(checked(again), on(again), "left_semi").groupBy(digest, id_col).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("r"))
    return plain.unionAll(one.select("r.*"))
