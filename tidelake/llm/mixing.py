"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are first added up to cells (one per combination of source, language and topic, with its tokens), by an
aggregation that combines before it shuffles. Raking then runs on the cells alone: each sweep scales the cells'
weights so that the weights of every source, then language, then topic sum to their targets. A document's
probability is its cell's weight over its tokens, either scaled so that the largest is 1, or, with a stated share of
all tokens to keep, scaled to that share and cut at 1, so that a tiny cell never decides how much of the rest stays.
The document stays if a uniform number made from its id lies below. All of this is deterministic, so lost tasks can
run again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import free_name, staged

#: Sweeps over all marginals, and how many of them one job does. After 20 sweeps marginals that overlap fully agree
#: to many digits.
SWEEPS, SWEEPS_A_JOB = 20, 5


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 52 bits of an MD5 digest; null keys count as the text 'null'."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def tempered(cells: DataFrame, column: str, power: float) -> DataFrame:
    """(column, target): each value's share of the tokens, to a power, made to sum to 1. Power 1 keeps the shares, 0
    gives every value the same."""
    sums = cells.groupBy(column).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.withColumn("p", F.pow(F.col("t").cast("double"), power))
    return raised.select(column, (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (the columns of targets, tokens) with `weight`, raked to targets: for each column a table (column,
    target). A value without a target keeps none of the weight; cells without tokens have weight 0.

    The number of cells is that of the combinations of values, whatever the number of documents.
    """
    weighed = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for column, target in targets.items():
        goal = target.select(F.col(column).alias("_value"), F.col("target").alias(f"_target_{column}"))
        weighed = weighed.join(goal, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value").fillna({f"_target_{column}": 0.0})
    weighed = staged(weighed, "cells")
    for first in range(0, sweeps, SWEEPS_A_JOB):
        for _ in range(first, min(sweeps, first + SWEEPS_A_JOB)):
            for column in targets:
                total = F.sum("weight").over(Window.partitionBy(column))
                weighed = weighed.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"_target_{column}") / total).otherwise(0.0))
        weighed = staged(weighed, "cells")
    return weighed.drop(*[f"_target_{c}" for c in targets])


def scaled(raked: DataFrame, share: float) -> DataFrame:
    """raked (tokens, weight) with `probability`: least(1, c * weight / tokens), with c such that the expected tokens are
    `share` of all, or all that have weight if these are fewer.

    From the largest ratio down, c is solved with the cells before each one kept whole; the first cell that its own c
    does not lift above 1 has the right one. Cells without weight get 0, cells that c lifts above 1 are kept whole.
    """
    order = Window.orderBy(F.desc("_ratio"))
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cells = raked.withColumn("_ratio", F.coalesce(F.col("weight") / F.col("tokens"), F.lit(0.0)))
    # equal ratios are one step, so that the order among them does not count
    steps = cells.groupBy("_ratio").agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    steps = steps.select("_ratio", "w", (F.sum("t").over(before) - F.col("t")).alias("whole"), F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left"), (F.sum("t").over(Window.partitionBy()) * share).alias("goal"))
    right = steps.where("_ratio > 0").withColumn("c", F.greatest(F.lit(0.0), F.col("goal") - F.col("whole")) / F.col("left")).where("c * _ratio <= 1")
    c = right.agg(F.max_by("c", "_ratio").alias("_c"))
    chance = F.when(F.col("_ratio") <= 0, 0.0).when(F.col("_c").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("_c") * F.col("_ratio")))
    return cells.crossJoin(F.broadcast(c)).withColumn("probability", chance).drop("_ratio", "_c")


def calibrated(docs: DataFrame, columns: Mapping[str, Column], tokens: Column, powers: Mapping[str, float], sweeps: int = SWEEPS, share: float | None = None) -> DataFrame:
    """docs with `mix_cell_weight`, `mix_probability`, or, where docs has these, names with underscores before them.

    columns names the marginals; powers temper their present shares to targets. Null values of a marginal are a
    value of their own. Documents without tokens get probability 0. An empty table stays empty. With a share, the
    probabilities add up to that share of all tokens; without, the largest is 1.
    """
    own = {c: free_name(docs, f"mix_{c}") for c in columns}
    counted, weight, probability = (free_name(docs, f"mix_{x}") for x in ("tokens", "cell_weight", "probability"))
    rows = docs.withColumns({own[c]: F.coalesce(e.cast("string"), F.lit("")) for c, e in columns.items()} | {counted: F.greatest(F.coalesce(tokens, F.lit(0)).cast("long"), F.lit(0))})
    keys = list(own.values())
    cells = staged(rows.groupBy(*keys).agg(F.sum(counted).alias("tokens")), "cells")
    raked = rake(cells, {own[c]: tempered(cells, own[c], powers[c]) for c in columns}, sweeps)
    ratio = F.col("weight") / F.col("tokens")
    chances = raked.withColumn("probability", ratio / F.max(ratio).over(Window.partitionBy())) if share is None else scaled(raked, share)
    plan = chances.select(*keys, F.col("weight").alias(weight), F.col("probability").alias(probability))
    joined = rows.join(staged(plan, "mix-plan"), keys, "left").fillna({weight: 0.0, probability: 0.0})
    return joined.select(*docs.columns, weight, F.when(F.col(counted) > 0, F.col(probability)).otherwise(0.0).alias(probability))


def sample(docs: DataFrame, columns: Mapping[str, Column], tokens: Column, powers: Mapping[str, float], key: Column, sweeps: int = SWEEPS, share: float | None = None) -> DataFrame:
    """The documents that the calibrated probabilities keep; columns as in docs. Rows with the same key stay or go
    together."""
    probability = free_name(docs, "mix_probability")
    return calibrated(docs, columns, tokens, powers, sweeps, share).where(uniform(key) < F.col(probability)).select(docs.columns)
