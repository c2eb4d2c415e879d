"""Delete files: which data files they apply to, how their rows are taken away, and when they are done with."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def applies(content: Column, delete_seq: Column, data_seq: Column) -> Column:
    """An equality delete applies to older data only, a position delete to data of the same sequence too."""
    return F.when(content == "equality", delete_seq > data_seq).otherwise(delete_seq >= data_seq)


def applicable(files: DataFrame, deletes: DataFrame, data_columns: Sequence[str] = ("path", "spec_id", "part_key", "seq")) -> DataFrame:
    """Every pair of a data file and a delete file that applies to it: data columns, delete_path, content, delete_seq.

    Deletes of a partition meet its files by (spec, partition) and a condition on sequence numbers. Equality deletes
    of an unpartitioned spec (null partition) are global: a data file meets those that are newer. Data sequence numbers
    are numbered in order; a delete is listed under each number below its own, and files meet it by equality. There are
    as many rows as pairs; where counts are enough, delete_counts lists none.
    """
    marks = deletes.select(F.col("path").alias("delete_path"), "content", F.col("spec_id").alias("d_spec"), F.col("part_key").alias("d_part"), F.col("seq").alias("delete_seq"))
    columns = [*data_columns, "delete_path", "content", "delete_seq"]
    local = marks.where("d_part is not null")
    scoped = files.join(local, (files["spec_id"] == local["d_spec"]) & (files["part_key"] == local["d_part"])).where(applies(F.col("content"), F.col("delete_seq"), F.col("seq"))).select(columns)
    everywhere = marks.where("d_part is null and content = 'equality'")
    numbers = files.where("seq is not null").select("seq").distinct().withColumn("number", F.row_number().over(Window.orderBy("seq")))
    # a delete comes before the data of its own sequence number, so that it sees the last smaller one
    line = numbers.select("seq", "number").unionByName(everywhere.select(F.col("delete_seq").alias("seq"), "delete_path").distinct(), allowMissingColumns=True)
    upto = F.max("number").over(Window.orderBy("seq", F.col("delete_path").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = line.withColumn("upto", upto).where("delete_path is not null and upto is not null").select("delete_path", F.col("seq").alias("delete_seq"), F.explode(F.sequence(F.lit(1), "upto")).alias("number"))
    world = files.join(numbers, "seq").join(reach, "number").withColumn("content", F.lit("equality")).select(columns)
    return scoped.unionByName(world)


def delete_counts(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """files with `equality` and `position`, the numbers of delete files that apply, and `newest`, the largest sequence
    number among them (null if there is none). No pair of a data file and a delete file is made: per partition, and
    once for the global deletes, running counts over the distinct sequence numbers say how many are newer."""
    scope = ["spec_id", "part_key"]

    def newer(marks: DataFrame, seqs: DataFrame, by: list[str], name: str) -> DataFrame:
        rows = marks.groupBy(*by, "seq").agg(F.count_if(F.col("content") == "equality").alias("e"), F.count_if(F.col("content") == "position").alias("p"))
        rows = seqs.join(rows, [*by, "seq"], "full").fillna(0, ["e", "p"])
        down = Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        above = Window.partitionBy(*by).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
        newest = F.greatest(F.max(F.when(F.col("e") > 0, F.col("seq"))).over(above), F.max(F.when(F.col("p") > 0, F.col("seq"))).over(down))
        return rows.select(*by, "seq", F.coalesce(F.sum("e").over(above), F.lit(0)).alias(f"{name}_e"), F.sum("p").over(down).alias(f"{name}_p"), newest.alias(f"{name}_newest"))

    local = newer(deletes.where("part_key is not null and seq is not null"), files.select(*scope, "seq").where("part_key is not null and seq is not null").distinct(), scope, "local")
    world = newer(deletes.where("part_key is null and content = 'equality' and seq is not null"), files.select("seq").where("seq is not null").distinct(), [], "world")
    rows = files.join(local, [*scope, "seq"], "left").join(world, "seq", "left")
    total = lambda c: F.coalesce(F.col(f"local_{c}"), F.lit(0)) + F.coalesce(F.col(f"world_{c}"), F.lit(0))
    return rows.select(*files.columns, total("e").cast("bigint").alias("equality"), F.coalesce("local_p", F.lit(0)).cast("bigint").alias("position"), F.greatest("local_newest", "world_newest").alias("newest"))


def without_keys(rows: DataFrame, deleted: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """rows whose key columns equal no row of deleted, nulls being equal. Equalities stay top-level conjuncts, so that
    the join is by hash or sort, never nested loops."""
    marks = deleted.select(*[F.col(d).alias(f"_d{i}") for i, (_, d) in enumerate(keys)]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(r).eqNullSafe(F.col(f"_d{i}")) for i, (r, _) in enumerate(keys)])
    return rows.join(marks, on, "left_anti")


def without_newer_keys(rows: DataFrame, deleted: DataFrame, keys: Sequence[tuple[str, str]], row_seq: str, delete_seq: str) -> DataFrame:
    """As without_keys, but only deletes newer than a row count: per key the newest one decides, in one join."""
    marks = deleted.groupBy(*[F.col(d).alias(f"_d{i}") for i, (_, d) in enumerate(keys)]).agg(F.max(delete_seq).alias("_seq"))
    on = reduce(lambda a, b: a & b, [F.col(r).eqNullSafe(F.col(f"_d{i}")) for i, (r, _) in enumerate(keys)])
    return rows.join(marks, on & (F.col(row_seq) < F.col("_seq")), "left_anti")


def without_positions(rows: DataFrame, positions: DataFrame, file_col: str, position_col: str) -> DataFrame:
    """rows without those that positions (file, pos) names."""
    marks = positions.select(F.col("file").alias("_file"), F.col("pos").alias("_pos")).distinct()
    return rows.join(marks, (F.col(file_col) == F.col("_file")) & (F.col(position_col) == F.col("_pos")), "left_anti")


def delete_sets(pairs: DataFrame) -> DataFrame:
    """Per data file its equality deletes as one sorted text; files with the same text are rewritten together."""
    return pairs.where("content = 'equality'").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("delete_path")), ",").alias("delete_set"), F.countDistinct("delete_path").alias("n_deletes"))


def retirable(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """Delete files (delete_path, content_offset) used in a group and nowhere else; an offset may be null."""
    a, b = inside.select("delete_path", "content_offset").distinct(), outside.select(F.col("delete_path").alias("_p"), F.col("content_offset").alias("_o")).distinct()
    return a.join(b, F.col("delete_path").eqNullSafe(F.col("_p")) & F.col("content_offset").eqNullSafe(F.col("_o")), "left_anti")


def dead_by_sequence(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """deletes with `dead`: no live data file is old enough for them. Global equality deletes are measured against
    the whole table, others against their partition; without data they are dead, without a sequence number alive."""
    floors = files.where("seq is not null").groupBy("spec_id", "part_key").agg(F.min("seq").alias("floor"))
    lowest = floors.agg(F.min("floor").alias("lowest"))
    rows = deletes.join(floors, ["spec_id", "part_key"], "left").join(F.broadcast(lowest))
    is_global = (F.col("content") == "equality") & F.col("part_key").isNull()
    floor = F.when(is_global, F.col("lowest")).otherwise(F.col("floor"))
    dead = F.when(F.col("seq").isNull(), False).when(floor.isNull(), True).when(F.col("content") == "equality", F.col("seq") <= floor).otherwise(F.col("seq") < floor)
    return rows.select(*deletes.columns, dead.alias("dead"))


def dangling(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """Delete files that no data file needs: not applicable to any, and dead by sequence, both."""
    used = applicable(files, deletes).select(F.col("delete_path").alias("path")).distinct()
    return dead_by_sequence(files, deletes).where("dead").drop("dead").join(used, "path", "left_anti")
