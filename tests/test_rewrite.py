"""Group rewrites: writer options, sort columns, schemas, lineage, deletes on nulls and ties, and the row contract."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.twins import TESTDATA, differences
from tidelake.operators import rewrite as W
from tidelake.operators.outcomes import violation
from tidelake.plans import catalogue
from tidelake.plans.catalogue import QUERIES


def test_writer_options():
    assert W.writer_options({}) == {"compression": "zstd"}
    found = W.writer_options({W.CODEC: " GZIP ", "write.parquet.page-size-bytes": "4096", "write.parquet.dict-size-bytes": "-1", "write.parquet.row-group-size-bytes": "x", f"{W.BLOOM}a": "TRUE", f"{W.RATE}a": "0.05", f"{W.BLOOM}b": "no"})
    assert found == {"compression": "gzip", "parquet.page.size": "4096", "parquet.bloom.filter.enabled#a": "true", "parquet.bloom.filter.fpp#a": "0.05"}
    assert W.writer_options({W.CODEC: "rle", f"{W.BLOOM}c": "true", f"{W.RATE}c": "2"}) == {"compression": "zstd", "parquet.bloom.filter.enabled#c": "true"}


def test_sort_columns_and_schemas_are_checked_first(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    W.check_sort_columns(schema, ["a"])
    for wrong in ("b", "m"):
        with pytest.raises(ValueError, match=wrong):
            W.check_sort_columns(schema, [wrong])
    rows = spark.createDataFrame([("1", 2)], "x string, y int")
    assert W.conform(rows, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])).collect() == [(1, 2.0)]
    with pytest.raises(ValueError, match="2 columns"):
        W.conform(rows, T.StructType([T.StructField("a", T.LongType())]))


def test_deletes_lineage_and_order(spark, tmp_path):
    """Two files with nulls and equal rows; a position delete, a null-safe key delete, and deletes that are too old."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    old, new = [(1, "a"), (None, "b"), (2, "a"), (2, "a")], [(1, "c"), (None, None)]
    for name, rows in (("old", old), ("new", new)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    paths = {n: next((tmp_path / n).glob("part-*")).as_uri() for n in ("old", "new")}
    tasks = spark.createDataFrame([(paths["old"], 1, 100), (paths["new"], 5, 200)], "path string, seq long, first_row_id long")
    positions = spark.createDataFrame([(paths["old"], 2, 3), (paths["old"], 2, 1), (paths["new"], 0, 4)], "file string, pos long, seq long")
    keyed = {("k",): spark.createDataFrame([(None, 3), (1, 1)], "k long, seq long")}
    rows = W.with_lineage(W.live(W.scan(spark, tasks, schema, list(paths.values())), positions, keyed))
    found = {(r.k, r.v, r[W.ROW_ID], r[W.UPDATED]) for r in rows.collect()}
    assert found == {(1, "a", 100, 1), (2, "a", 103, 1), (1, "c", 200, 5), (None, None, 201, 5)}
    written = rows.withColumn(W.ROW_ID, F.when(F.col("v") == "c", F.lit(7)).cast("long"))
    assert {r[W.ROW_ID] for r in W.with_lineage(written).collect()} == {100, 103, 7, 201}
    out = rows.select("k", "v")
    W.write_sorted(out, f"file://{tmp_path}/out", [F.col("k").asc_nulls_first(), F.col("v").desc()], 3, W.writer_options({}))
    back = W.in_order(spark, f"file://{tmp_path}/out", schema).orderBy("ordinal").collect()
    assert [(r.k, r.v, r.ordinal) for r in back] == [(None, None, 1), (1, "c", 2), (1, "a", 3), (2, "a", 4)]
    W.write_sorted(out.limit(0), f"file://{tmp_path}/none", [], 0, W.writer_options({}))
    assert W.in_order(spark, f"file://{tmp_path}/none", schema).count() == 0


def test_violations(spark):
    rows = spark.createDataFrame([(5, 5, 1, 9), (10, 10, 1, 9), (0, 0, 1, 9), (5, 4, 1, 9)], "p long, q long, f long, c long")
    found = [r[0] for r in rows.select(violation(F.col("p"), F.col("q"), F.col("f"), F.col("c"))).collect()]
    assert found == [None, "more rows than the inputs hold", "fewer rows than the inputs must keep", "written rows differ from produced rows"]


def test_paths_are_normalised_per_file_not_per_row(spark, tmp_path):
    spark.range(9).write.parquet(f"file://{tmp_path}/data")
    schema, paths = T.StructType([T.StructField("id", T.LongType())]), [p.as_uri() for p in (tmp_path / "data").glob("part-*")]
    tasks = spark.createDataFrame([(p.replace("file:///", "file:/") + "/", 3, 10 * i) for i, p in enumerate(paths)], "path string, seq long, first_row_id long")
    rows = W.scan(spark, tasks, schema, paths)
    assert sorted(r.id for r in rows.where(f"{W.SEQ} = 3").collect()) == list(range(9))
    assert not re.search(r"regexp_replace\([^,]*file_path", rows._jdf.queryExecution().optimizedPlan().toString())


def test_a_group_has_more_files_where_it_has_more_lines(spark, monkeypatch):
    """Files of bounded length, with position deletes on both sides of where they are cut."""
    sf = str(TESTDATA / "sf0.001")
    monkeypatch.setattr(catalogue, "FILE_LINES", 200)
    _, found = catalogue._group(spark, sf)
    assert len(found) >= 30 and max(r.record_count for r in found) < 600
    assert differences(QUERIES["rewrite_group"](spark, sf), catalogue.ORACLES["rewrite_group"], sf) == ""


def test_position_deletes_take_one_scan(spark, tmp_path):
    """What sequence number a file has is known to each of its rows; no second scan collects it."""
    spark.range(9).coalesce(1).write.parquet(f"file://{tmp_path}/data")
    schema, paths = T.StructType([T.StructField("id", T.LongType())]), [p.as_uri() for p in (tmp_path / "data").glob("part-*")]
    tasks = spark.createDataFrame([(paths[0], 3, 0)], "path string, seq long, first_row_id long")
    positions = spark.createDataFrame([(paths[0], 1, 3), (paths[0], 2, 2), (paths[0], 2, None), (paths[0], 4, 9), (paths[0], 4, 1), ("file:/other", 5, 9)], "file string, pos long, seq long")
    rows = W.live(W.scan(spark, tasks, schema, paths), positions, {})
    assert sorted(r.id for r in rows.collect()) == [0, 2, 3, 5, 6, 7, 8]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [id#") == 1
