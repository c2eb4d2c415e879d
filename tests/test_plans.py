"""Shapes of plans, and operators whose rule no table of the catalogue exercises."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.twins import TESTDATA
from tidelake.functions import values
from tidelake.functions.paths import is_inside, normalize
from tidelake.operators import grouping, policy
from tidelake.operators.deletes import applicable, applies, delete_counts
from tidelake.operators.grouping import clustered, ranked
from tidelake.operators.reachability import ancestry, lineage, retained_by_refs
from tidelake.plans.catalogue import QUERIES, _with_counts

SF = str(TESTDATA / "sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["delete_applicability", "eqdel_single_key", "eqdel_null_safe", "eqdel_chained_keys", "eqdel_sequence_aware", "posdel_row_selection", "bucket_by_delete_set", "rewrite_group"])
def test_no_nested_loops(spark, name):
    assert "BroadcastNestedLoopJoin" not in plan(QUERIES[name](spark, SF)) and "CartesianProduct" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["orphan_candidates", "expire_cleanup"])
def test_paths_are_normalised_in_one_expression_each(spark, name):
    """Each path costs one replacement; nested references would multiply them."""
    assert plan(QUERIES[name](spark, SF)).count("regexp_replace") <= 40


def test_files_are_aggregated_once_for_their_delete_counts(spark):
    assert "l_suppkey" not in plan(_with_counts(spark, SF))


@pytest.mark.parametrize("name", ["orphan_overlap", "expire_cleanup", "reachable_set"])
def test_what_a_table_reaches_reads_lines_once(spark, name):
    assert "l_shipdate" not in plan(QUERIES[name](spark, SF))


def test_applicable_deletes_against_all_pairs(spark):
    deal = random.Random(3)
    files = [(f"f{i}", deal.randrange(2), deal.choice([1, 2, None]), deal.choice([None, *range(6)])) for i in range(40)]
    gone = [(f"d{i}", deal.choice(["equality", "position"]), deal.randrange(2), deal.choice([1, 2, None]), deal.choice([None, *range(6)])) for i in range(30)]
    f = spark.createDataFrame(files, "path string, spec_id int, part_key int, seq long")
    d = spark.createDataFrame(gone, "path string, content string, spec_id int, part_key int, seq long")
    want = set()
    for path, spec, part, seq in files:
        for name, content, d_spec, d_part, d_seq in gone:
            if seq is None or d_seq is None or (d_part is None and content != "equality") or (d_part is not None and (spec, part) != (d_spec, d_part)):
                continue
            if d_seq > seq or (content == "position" and d_seq == seq):
                want.add((path, name, content, d_seq))
    found = [(r.path, r.delete_path, r.content, r.delete_seq) for r in applicable(f, d).collect()]
    assert set(found) == want and len(found) == len(want)
    for r in delete_counts(f, d).collect():
        own = [w for w in want if w[0] == r.path]
        assert (r.equality, r.position, r.newest) == (sum(w[2] == "equality" for w in own), sum(w[2] == "position" for w in own), max((w[3] for w in own), default=None))
    assert delete_counts(f.limit(0), d).count() == applicable(f, d.limit(0)).count() == 0
    assert spark.range(1).select(applies(F.lit("equality"), F.lit(2), F.lit(2)), applies(F.lit("position"), F.lit(2), F.lit(2))).first() == (False, True)


def test_retention_by_refs(spark):
    """A main branch of ten, a branch off its fifth, a tag, an expired tag, and snapshots that nothing reaches."""
    hour = 3_600_000
    chain = [(i, i - 1 if i > 1 else None, i * hour) for i in range(1, 11)]
    rows = [*chain, (20, 5, 6 * hour), (21, 20, 7 * hour), (30, None, 2 * hour), (31, 30, 10 * hour)]
    snapshots = spark.createDataFrame(rows, "snapshot_id long, parent_id long, timestamp_ms long")
    refs = [("main", "branch", 10, 1, None, 2), ("side", "branch", 21, None, 4 * hour, 1), ("kept", "tag", 3, None, None, None), ("gone", "tag", 2, hour, None, None)]
    named = spark.createDataFrame(refs, "name string, kind string, snapshot_id long, max_ref_age_ms long, max_snapshot_age_ms long, min_to_keep int")
    kept = {r.snapshot_id for r in retained_by_refs(snapshots, named, 10 * hour, hour, 1).where("kept").collect()}
    assert kept == {10, 9, 21, 20, 3, 31}
    deep = spark.range(1, 301).select(F.col("id").alias("snapshot_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"))
    assert ancestry(deep, deep.where("snapshot_id = 300")).agg(F.count("*"), F.max("depth")).first() == (300, 299)
    assert ancestry(deep, deep.limit(0)).count() == 0


def test_paths(spark):
    cases = {"S3A://b//x/": "s3://b/x", "file:/a/b": "file:///a/b", "file:///a//b/": "file:///a/b", "/a//b/": "/a/b", "gcs://b": "gs://b", "": "", "no/scheme": "no/scheme", None: None, "s3://B/a:/b": "s3://B/a:/b"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in rows.select("p", normalize(F.col("p"))).collect()} == cases
    inside = rows.select(is_inside(F.lit("s3n://b/"), F.lit("s3://b/x")), is_inside(F.lit("s3://b"), F.lit("s3://bb/x")), is_inside(F.lit("s3://b"), F.lit("s3://b/")))
    assert inside.first() == (True, False, False)


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(values.is_true(F.lit(" TRUE")), values.is_true(F.lit("yes")), values.is_true(F.lit(None).cast("string"))).first() == (True, False, False)
    assert one.select(values.scheme(F.lit("S3://b/x")), values.scheme(F.lit("/x"))).first() == ("s3", "file")
    assert one.select(values.millis(F.lit(" 0 ")), values.millis(F.lit("-1")), values.millis(F.lit("x"))).first() == (0, None, None)
    assert one.select(values.days_to_seconds(F.lit("1.5")), values.days_to_seconds(F.lit(2)), values.days_to_seconds(F.lit("d"))).first() == (129_600, 172_800, None)
    assert one.select(values.cutoff_millis(F.lit(10), F.lit(3)), values.cutoff_millis(F.lit(10), F.lit(30))).first() == (7, 0)
    assert policy.shadowed(["a.*", "b.**", "a.*", "b.c", "c.d"]) == [(2, 0), (3, 1)]


def test_orders_against_plain_ones(spark):
    """Running sums and ranks over ranges, with ties, nulls and an empty table."""
    deal = random.Random(9)
    rows = [(i, deal.choice([None, *range(50)])) for i in range(500)]
    found = lineage(spark.createDataFrame(rows, "commit_pos long, record_count long"), 7).collect()
    total = 7
    for r, (_, n) in zip(sorted(found, key=lambda r: r.commit_pos), rows, strict=True):
        assert r.first_row_id == total
        total += n or 0
    groups = [(1, i % 3, i, deal.choice([1, 2, 3, 2**40]), deal.choice([0, 1, 3, 2**60, 2**60 + 1])) for i in range(60)]
    want = sorted(groups, key=lambda g: (-Fraction(g[3], max(1, g[4])), *g[:3]))
    got = ranked(spark.createDataFrame(groups, "spec_id int, part_key int, group_index long, benefit long, bytes long")).orderBy("rank").collect()
    assert [(r.spec_id, r.part_key, r.group_index, r.benefit, r.bytes) for r in got] == want and [r["rank"] for r in got] == list(range(1, 61))
    entries = [(s, p, m, e) for s in (0, 1) for p in range(5) for m in range(3) for e in range(4)]
    deal.shuffle(entries)
    placed = clustered(spark.createDataFrame(entries, "spec_id int, part_key int, manifest_pos int, entry_pos int"), 7).collect()
    for s in (0, 1):
        own = sorted((r for r in placed if r.spec_id == s), key=lambda r: r.position)
        assert [(r.part_key, r.manifest_pos, r.entry_pos) for r in own] == sorted(e[1:] for e in entries if e[0] == s)
        assert [r.position for r in own] == list(range(60)) and all(r.manifest_no == r.position // 7 for r in own)
    assert ranked(spark.createDataFrame([], "spec_id int, part_key int, group_index long, benefit long, bytes long")).count() == 0


def test_next_fit_against_a_plain_loop(spark, monkeypatch):
    """Partitions of many pieces and pieces of many partitions, nulls, equal and empty sizes, files above the bound; and
    no partition's files in one row."""
    deal = random.Random(4)
    rows = [(s, p, f"f{i}", deal.choice([0, 1, 2, 3, 7, 20, 31])) for i, (s, p) in enumerate(deal.choices([(1, 1), (1, 1), (1, 2), (0, 3), (1, None), (2, 5)], k=900))]
    rows += [(3, p, f"g{p}", 2) for p in range(60)] + [(4, 1, f"h{i:03}", 1) for i in range(400)]
    files = spark.createDataFrame(rows, "spec_id int, part_key int, path string, file_size long").withColumn("more", F.lower("path"))
    for piece, share, max_bytes, max_files in ((7, 1, 20, 4), (5, 1, 25, 9), (1, 1, 10**6, 3), (50_000, 16, 20, 4), (20, 1, 5, 1), (30, 1, 10**6, 1000)):
        monkeypatch.setattr(grouping, "PIECE", piece)
        monkeypatch.setattr(grouping, "GROUPS_A_PIECE", share)
        want, at = set(), None
        for s, p, path, size in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[3], r[2])):
            if at != (s, p):
                at, total, held, group = (s, p), 0, 0, 0
            elif total + size > max_bytes or held >= max_files:
                total, held, group = 0, 0, group + 1
            total, held = total + size, held + 1
            want.add((s, p, path, size, path, group))
        found = grouping.next_fit(files, max_bytes, max_files)
        got = [tuple(r) for r in found.select("spec_id", "part_key", "path", "file_size", "more", "group_no").collect()]
        assert len(got) == len(rows) and set(got) == want
        assert "collect_list" not in found._jdf.queryExecution().toString()
    assert grouping.next_fit(files.limit(0), 20, 4).count() == 0
