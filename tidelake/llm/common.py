"""What the operators share: written intermediate tables, size-checked joins, batch sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of keys is broadcast up to this many rows (about 16 MB of longs); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where spark.checkpoint.dir is unset, a temporary folder is made
    and set if the session is local (tests in one process); on a cluster no executor would see another's, so it is an
    error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidelake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def drop_staged() -> None:
    """Removes every intermediate table of this process whose session still runs."""
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/tidelake/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and written as Parquet into the shared folder. Lost executors lose nothing of it."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    _path_of[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing which is still to be computed reads."""
    for df in tables:
        path = _path_of.pop(df, None)
        if path is None:
            continue  # never written
        _written.remove((df.sparkSession, path))
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's collector finds their handles unused; this
    runs it, so that a long chain of jobs does not hold the disk of all of them."""
    spark.sparkContext._jvm.java.lang.System.gc()


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows here hold whole texts, so that batches for Python workers are cut at few rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checked(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """keys, to be broadcast if a count shows at most so many rows; else as it is, and the join shuffles."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = f"_{wish}"
    return wish


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with groups, which has one row per key; `size` is the number of rows that the key has.

    Keys of a thousandth of `total` rows or more number at most a thousand, as sizes add up to `total` at most: their
    side is broadcast and their rows stay where they are. The other keys are each below that share, and they alone
    shuffle.
    """
    if total < 1000:  # no key can have so many rows
        return rows.join(groups, key)
    least = max(1000, total // 1000)
    heavy, light = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(others.join(light, key))


def join_salted(rows: DataFrame, wide: DataFrame, key: str, salt: str, most: int = 2000) -> DataFrame:
    """rows joined with wide, which has one row per key, too wide to broadcast: a key with more than `most` rows gets
    a copy of its wide row for each `most` of them, among which the hash of column `salt` deals the rows."""
    copies = checked(staged(rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_copies")), "copies"))
    dealt = rows.join(copies, key).withColumn("_part", F.pmod(F.xxhash64(salt), F.col("_copies").cast("long")).cast("int")).drop("_copies")
    spread = wide.join(copies, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return dealt.join(spread, [key, "_part"]).drop("_part")


def join_split(few: DataFrame, many: DataFrame, key: str, most: int) -> DataFrame:
    """few joined with many, either with any number of rows per key. A key that more than `most` rows of many hold is
    split: these are dealt over parts of about so many, and each part gets a copy of the key's rows of few."""
    hot = staged(many.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts")).where("_parts > 1"), "split-keys")
    hot = checked(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), parts.cast("long")).cast("int")).drop("_parts")
    spread = few.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return spread.join(dealt, [key, "_part"]).drop("_part")
