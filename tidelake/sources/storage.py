"""Tables written into the folder that driver and executors share, to cut lineage or to be rewritten."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a temporary folder is made and set if the session is
    local; on a cluster executors would not see each other's, so that it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidelake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tidelake-tables/{label}-{uuid.uuid4().hex}"


def shared(df: DataFrame, label: str) -> DataFrame:
    """df, computed once, written into the shared folder and read again."""
    path, schema = shared_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
