"""Connected components of a link table, by hooking and pointer jumping over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import discard, join_groups, staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the smallest node of its component.

    Each round gives a node the smallest label among its own and its neighbours', hooks the old label to it, and
    follows labels once more; rounds grow with the logarithm of the longest path. Every round is a written table,
    and only a few counts a round come to the driver. A node with a thousandth of all links, and a label of a
    thousandth of all nodes, is joined by broadcast, so that neither a hub nor a giant component is one task's work.
    Links to itself are harmless; nulls make no link.
    """
    pairs = links.where("a is not null and b is not null").select("a", "b")
    both = staged(pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n_links = both.count()
    degrees = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"), F.min("b").alias("least"))
    labels = staged(degrees.select(F.col("b").alias("node"), F.least("b", "least").alias("label"), "degree"), "labels")
    n_nodes = labels.count()
    kept = lambda df, label: staged(df, label) if n_nodes >= 1000 else df  # noqa: E731  small ones are computed again
    while n_nodes:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"), "degree")
        lowest = join_groups(both, of_b, "b", "degree", n_links).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = kept(labels.join(lowest, "node").withColumn("low", F.least("label", "near")), "hooked")
        # what an old label learns from any of its nodes reaches all of them by way of the label's own row
        learnt = hooked.groupBy("label").agg(F.min("low").alias("told"), F.count("*").alias("held"))
        learnt = kept(learnt, "learnt")
        new = join_groups(hooked.select("node", "degree", "label", "low"), learnt, "label", "held", n_nodes)
        new = kept(new.select("node", "degree", F.col("label").alias("was"), F.least("low", "told").alias("mid")), "told")
        jump = learnt.select(F.col("label").alias("mid"), F.col("told").alias("far"))
        jump = jump.join(new.groupBy("mid").agg(F.count("*").alias("held")), "mid", "right")
        jumped = join_groups(new, jump, "mid", "held", n_nodes)
        after = staged(jumped.select("node", "degree", "was", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        changed = after.where("was <> label").count()
        discard(labels, hooked, learnt, new)
        if not changed:
            discard(both)
            return after.select("node", "label")
        labels = after
    return labels.select("node", "label")
