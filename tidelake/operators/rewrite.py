"""Rewriting a group of data files: their live rows, in the table's order, in files of about the target size.

The group's files are read as one scan, so filters on nothing and columns of the table alone reach Parquet. Position
deletes meet rows by file and row number, equality deletes by the columns of their key, one null-safe anti-join for
each set of key columns; all buckets of the group are one plan, sorted and written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.paths import normalize
from tidelake.operators.deletes import without_newer_keys
from tidelake.operators.outcomes import violation
from tidelake.sources.storage import shared

#: Names of the columns that a scan adds to those of the table.
FILE, POSITION, SEQ, FIRST = "_data_file", "_row_number", "_data_seq", "_first_row_id"
#: Row lineage columns of format version 3.
ROW_ID, UPDATED = "_row_id", "_last_updated_sequence_number"
#: Table properties of the writer, and what Spark's Parquet writer calls them.
CODEC, CODECS = "write.parquet.compression-codec", {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4", "brotli": "brotli", "none": "none", "uncompressed": "none"}
SIZES = {
    "write.parquet.row-group-size-bytes": "parquet.block.size",
    "write.parquet.page-size-bytes": "parquet.page.size",
    "write.parquet.dict-size-bytes": "parquet.dictionary.page.size",
    "write.parquet.page-row-limit": "parquet.page.row.count.limit",
}
BLOOM, RATE = "write.parquet.bloom-filter-enabled.column.", "write.parquet.bloom-filter-fpp.column."


def writer_options(properties: Mapping[str, str]) -> dict[str, str]:
    """Options of Spark's Parquet writer from table properties; unknown, malformed and not positive values are left out."""
    options = {"compression": CODECS.get(properties.get(CODEC, "zstd").strip().lower(), "zstd")}
    for name, option in SIZES.items():
        value = properties.get(name, "").strip()
        if value.isascii() and value.isdigit() and int(value) > 0:
            options[option] = str(int(value))
    for name, value in properties.items():
        if name.startswith(BLOOM) and value.strip().lower() == "true":
            column = name.removeprefix(BLOOM)
            options[f"parquet.bloom.filter.enabled#{column}"] = "true"
            try:
                share = float(properties.get(f"{RATE}{column}", ""))
            except ValueError:
                continue
            if 0 < share < 1:
                options[f"parquet.bloom.filter.fpp#{column}"] = str(share)
    return options


def check_sort_columns(schema: T.StructType, columns: Iterable[str]) -> None:
    """Raises before anything is read if the order names a column that the table lacks or that has no order."""
    known = {f.name: f.dataType for f in schema.fields}
    for column in columns:
        if column not in known:
            raise ValueError(f"sort column {column} is not a column of the table")
        if isinstance(known[column], (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
            raise ValueError(f"sort column {column} has type {known[column].simpleString()}, which has no order")


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows cast to the declared schema, by position; another number of columns is an error."""
    if len(rows.columns) != len(schema.fields):
        raise ValueError(f"{len(rows.columns)} columns where the table declares {len(schema.fields)}")
    return rows.toDF(*schema.fieldNames()).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])


def scan(spark: SparkSession, tasks: DataFrame, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The rows of the data files at paths, which tasks (path, seq, first_row_id) describe, with FILE, POSITION, SEQ and
    FIRST. The driver holds the group's paths alone; a group has a bounded number of files."""
    rows = spark.read.schema(schema).parquet(*paths)
    # written, so that a path is normalised once per file: a filter on it would else be pushed below distinct, to the rows
    spelled = shared(rows.select(F.col("_metadata.file_path").alias("_spelled")).distinct(), "spelled-files").withColumn(FILE, normalize(F.col("_spelled")))
    of = spelled.join(F.broadcast(tasks.select(normalize(F.col("path")).alias(FILE), F.col("seq").alias(SEQ), F.col("first_row_id").alias(FIRST))), FILE)
    return rows.select("*", F.col("_metadata.file_path").alias("_spelled"), F.col("_metadata.row_index").alias(POSITION)).join(F.broadcast(of), "_spelled").drop("_spelled")


def live(rows: DataFrame, positions: DataFrame, keyed: Mapping[tuple[str, ...], DataFrame]) -> DataFrame:
    """rows of a scan without those that delete files take away: positions (file, pos, seq) of data files of the same
    or an older sequence number, and for each set of key columns a table of these and seq, which count for older rows."""
    marks = positions.groupBy(normalize(F.col("file")).alias("_file"), F.col("pos").alias("_pos")).agg(F.max("seq").alias("_seq"))
    rows = rows.join(marks, (F.col(FILE) == F.col("_file")) & (F.col(POSITION) == F.col("_pos")) & (F.col(SEQ) <= F.col("_seq")), "left_anti")
    for columns in sorted(keyed):
        rows = without_newer_keys(rows, keyed[columns], [(c, c) for c in columns], SEQ, "seq")
    return rows


def with_lineage(rows: DataFrame) -> DataFrame:
    """rows of a scan with ROW_ID and UPDATED: as written if they are there and not null, else inherited from the file
    (its first row id and the row's number; its sequence number)."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("bigint")
    return rows.withColumns({ROW_ID: F.coalesce(have(ROW_ID), F.col(FIRST) + F.col(POSITION)), UPDATED: F.coalesce(have(UPDATED), F.col(SEQ))})


def write_sorted(rows: DataFrame, path: str, order: Sequence[Column], files: int, options: Mapping[str, str]) -> None:
    """Writes rows into about `files` files, in one order over all of them; without an order, dealt evenly."""
    dealt = rows.repartitionByRange(max(1, files), *order).sortWithinPartitions(*order) if order else rows.repartition(max(1, files))
    dealt.write.options(**options).parquet(path)


def in_order(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of files that write_sorted wrote, with `ordinal`, their place in the order from 1 on."""
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias(FILE), F.col("_metadata.row_index").alias(POSITION))
    before = Window.orderBy(FILE).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = rows.groupBy(FILE).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.join(F.broadcast(offsets), FILE).withColumn("ordinal", (F.col("offset") + F.col(POSITION) + 1).cast("bigint")).drop(FILE, POSITION, "offset")


def outcome(produced: int, persisted: DataFrame, floor: int, ceiling: int) -> DataFrame:
    """One row: rows produced and written, the bounds that the inputs set, and what is violated (null: nothing)."""
    one = persisted.agg(F.count("*").alias("persisted")).select(F.lit(produced).cast("bigint").alias("produced"), "persisted", F.lit(floor).cast("bigint").alias("floor"), F.lit(ceiling).cast("bigint").alias("ceiling"))
    return one.withColumn("violation", violation(F.col("produced"), F.col("persisted"), F.col("floor"), F.col("ceiling")))


def staged_live(rows: DataFrame, positions: DataFrame, keyed: Mapping[tuple[str, ...], DataFrame]) -> DataFrame:
    """live() with its lineage and without the columns of the scan, written once: it is counted, and then sorted by
    ranges, which reads it twice."""
    return shared(with_lineage(live(rows, positions, keyed)).drop(FILE, POSITION, SEQ, FIRST), "live-rows")
