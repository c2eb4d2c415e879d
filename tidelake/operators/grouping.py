"""Files into groups of bounded size, groups and tables into an order, budgets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.operators.ordering import PLACE, RANGE, before, placed


#: Files of an order that one task folds at once; more where groups hold more files, so that what a piece says stays small.
PIECE, GROUPS_A_PIECE = 50_000, 16


def _jumps(files: pa.Table, max_bytes: int, max_files: int):
    """A piece of the order, its rows sorted: (places before sorting, running bytes, first row of each partition, for
    each row that opens a group the row after that group). A size above max_bytes counts as the next larger number."""
    places = np.argsort(files[PLACE].to_numpy())
    files = files.select(["spec_id", "part_key", "file_size"]).take(places).combine_chunks()
    n = files.num_rows
    code = lambda c: np.asarray(files[c].combine_chunks().dictionary_encode("encode").indices)
    same = (np.diff(code("spec_id")) == 0) & (np.diff(code("part_key")) == 0)
    opens = np.concatenate([[0], np.flatnonzero(~same) + 1])
    ends = np.repeat(np.append(opens[1:], n), np.diff(np.append(opens, n)))
    summed = np.concatenate([[0], np.cumsum(np.minimum(files["file_size"].fill_null(0).to_numpy(), max_bytes + 1))])
    at = np.arange(n)
    fit = np.searchsorted(summed, summed[:-1] + max_bytes, side="right") - 1
    return places, summed, opens, np.maximum(at + 1, np.minimum(np.minimum(fit, at + max_files), ends))


def _joined(heads, size: int, held: int, max_bytes: int, max_files: int) -> int:
    """How many of the next files, whose running bytes are heads, an open group of so many bytes and files takes."""
    return min(int(np.searchsorted(heads, max_bytes - size, side="right")), max_files - held, len(heads)) if held else 0


EDGE = "spec_id {spec}, part_key {part}, _range string, _piece long, leads boolean, files long, heads array<long>, open_bytes array<long>, open_files array<long>, opened array<long>"


def _edges(max_bytes: int, max_files: int) -> Callable[[pa.Table], pa.Table]:
    """What the first and the last partition of a piece say: running bytes of the first files, and for each file that
    may be the first to open a group, what is open at the end and how many groups were opened."""

    def edges(files: pa.Table) -> pa.Table:
        places, summed, opens, jumps = _jumps(files, max_bytes, max_files)
        jumps, rows = jumps.tolist(), []
        for low in sorted({0, int(opens[-1])}):
            high = int(opens[1]) if low == 0 and len(opens) > 1 else len(jumps)
            last, opened = [0] * (high - low), [1] * (high - low)
            for i in range(high - 1, low - 1, -1):
                to = jumps[i]
                last[i - low] = i if to >= high else last[to - low]
                opened[i - low] = 1 if to >= high else opened[to - low] + 1
            some = min(max_files, high - low)
            ends = np.array(last[:some])
            rows.append((int(places[low]), low == 0, high - low, (summed[low + 1 : low + some + 1] - summed[low]).tolist(), (summed[high] - summed[ends]).tolist(), (high - ends).tolist(), opened[:some]))
        found = files.select(["spec_id", "part_key", RANGE, "_piece"]).take([r[0] for r in rows])
        for i, name in enumerate(("leads", "files", "heads", "open_bytes", "open_files", "opened"), 1):
            kind = pa.bool_() if i == 1 else pa.int64() if i == 2 else pa.list_(pa.int64())
            found = found.append_column(name, pa.array([r[i] for r in rows], kind))
        return found

    return edges


ENTRY = "_range string, _piece long, _bytes long, _files long, _group long"


def _entries(max_bytes: int, max_files: int) -> Callable[[pa.Table], pa.Table]:
    """From the edges of one partition the group that is open where each piece of it begins: bytes, files, number."""

    def entries(edges: pa.Table) -> pa.Table:
        size, held, group, out = 0, 0, -1, []
        for e in sorted(edges.to_pylist(), key=lambda e: (e[RANGE], e["_piece"])):
            if e["leads"]:
                out.append((e[RANGE], e["_piece"], size, held, group))
            took = _joined(e["heads"], size, held, max_bytes, max_files)
            if took == e["files"]:
                size, held = size + e["heads"][-1], held + took
            else:
                size, held, group = e["open_bytes"][took], e["open_files"][took], group + e["opened"][took]
        kinds = [pa.string(), *[pa.int64()] * 4]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(zip((RANGE, "_piece", "_bytes", "_files", "_group"), kinds, strict=True))})

    return entries


def _numbered(max_bytes: int, max_files: int, columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """A piece's files with group_no, from the group that is open where it begins."""

    def numbered(files: pa.Table) -> pa.Table:
        places, summed, opens, jumps = _jumps(files, max_bytes, max_files)
        n, size, held, group = len(jumps), *(files[c][0].as_py() for c in ("_bytes", "_files", "_group"))
        at = _joined(summed[1 : (int(opens[1]) if len(opens) > 1 else n) + 1], size, held, max_bytes, max_files)
        opening, jumps = np.zeros(n, "int64"), jumps.tolist()
        while at < n:
            opening[at] = 1
            at = jumps[at]
        count = np.cumsum(opening)
        before_first = np.append(-group, count[opens[1:]])
        numbers = np.empty(n, "int64")
        numbers[places] = count - np.repeat(before_first, np.diff(np.append(opens, n)))
        return files.select(columns).append_column("group_no", pa.array(numbers))

    return numbered


def next_fit(files: DataFrame, max_bytes: int, max_files: int) -> DataFrame:
    """files (spec_id, part_key, path, file_size and others) with `group_no`: smallest first, a group is closed when the
    next file would take it over max_bytes or it holds max_files files. A single larger file is a group of its own.

    Order decides, but no task holds a partition: the order over all files is cut into pieces of bounded length. How a
    piece ends depends on which of its first max_files files opens a group, so each says that for all of these; the
    pieces of a partition are chained by what they say, and then each numbers its files from the group it finds open.
    """
    order = [F.col(c).asc() for c in ("spec_id", "part_key", "file_size", "path")]
    length = max(PIECE, GROUPS_A_PIECE * max_files)
    found = placed(files, *order, label="packing").withColumn("_piece", F.floor(F.col(PLACE) / length).cast("bigint"))
    kinds = dict(files.dtypes)
    edges = found.select("spec_id", "part_key", "file_size", RANGE, PLACE, "_piece").groupBy(RANGE, "_piece").applyInArrow(_edges(max_bytes, max_files), EDGE.format(spec=kinds["spec_id"], part=kinds["part_key"]))
    entries = edges.groupBy("spec_id", "part_key").applyInArrow(_entries(max_bytes, max_files), ENTRY)  # a row per piece
    back = found.join(F.broadcast(entries), [RANGE, "_piece"])
    schema = T.StructType([*files.schema.fields, T.StructField("group_no", T.LongType())])
    return back.groupBy(RANGE, "_piece").applyInArrow(_numbered(max_bytes, max_files, files.columns), schema)


def worthwhile(groups: DataFrame, target: int, large: int) -> DataFrame:
    """Groups (spec_id, part_key, group_no) with files, bytes, deletes and benefit, without those that a rewrite would
    leave as they are; those that stay are numbered anew. files rows: file_size, n_deletes."""
    found = groups.groupBy("spec_id", "part_key", "group_no").agg(F.count("*").alias("files"), F.sum("file_size").cast("bigint").alias("bytes"), F.sum("n_deletes").cast("bigint").alias("deletes"), F.max("file_size").alias("largest"))
    kept = found.where((F.col("files") > 1) | (F.col("deletes") > 0) | (F.col("largest") > large))
    outputs = F.ceil(F.col("bytes") / F.lit(float(target))).cast("bigint")
    benefit = F.greatest(F.lit(1), F.abs(F.col("files") - outputs) + F.col("deletes")).cast("bigint")
    index = F.row_number().over(Window.partitionBy("spec_id", "part_key").orderBy("group_no")) - 1
    return kept.select("spec_id", "part_key", index.cast("bigint").alias("group_index"), "files", "bytes", "deletes", benefit.alias("benefit"))


def ranked(groups: DataFrame) -> DataFrame:
    """groups with `rank`: most benefit per byte first, compared exactly, ties by partition and index."""
    size = F.greatest(F.col("bytes"), F.lit(1)).cast("decimal(19,0)")
    digits, rest = [F.expr("benefit div greatest(bytes, 1)")], (F.col("benefit").cast("decimal(19,0)") % size).cast("decimal(19,0)")
    found = groups.withColumns({"_digits": digits[0], "_rest": rest, "_size": size})
    for i in range(3):  # fractions of 63-bit numbers that differ do so within 38 decimals
        found = found.withColumn(f"_d{i}", F.expr("CAST(_rest * CAST(1000000000000000000 AS decimal(19,0)) AS decimal(38,0)) div _size"))
        found = found.withColumn("_rest", F.expr("CAST(CAST(_rest * CAST(1000000000000000000 AS decimal(19,0)) AS decimal(38,0)) % _size AS decimal(19,0))"))
    order = [F.col(c).desc() for c in ("_digits", "_d0", "_d1", "_d2")] + [F.col(c).asc() for c in ("spec_id", "part_key", "group_index")]
    ordered = before(placed(found, *order, label="groups"), F.lit(1), "rank")
    return ordered.select(*groups.columns, (F.col("rank") + 1).cast("bigint").alias("rank"))


def within_budget(plans: DataFrame, budget: int) -> DataFrame:
    """plans (name, score, cost) with `kept`: by falling score, then name, a plan is kept if its cost still fits; later
    and cheaper ones may fit again. Plans without cost always stay. One row per table or partition plan, folded."""
    step = f"""aggregate(
      array_sort(collect_list(struct(-score AS s, name, cost))),
      CAST(named_struct('spent', 0, 'out', array()) AS struct<spent: bigint, out: array<struct<name: string, kept: boolean>>>),
      (acc, x) -> named_struct(
        'spent', IF(acc.spent + x.cost <= {budget}, acc.spent + x.cost, acc.spent),
        'out', array_append(acc.out, named_struct('name', x.name, 'kept', x.cost = 0 OR acc.spent + x.cost <= {budget}))),
      acc -> acc.out)"""
    decided = plans.agg(F.expr(step).alias("d")).select(F.explode("d").alias("d")).select(F.col("d.name").alias("name"), F.col("d.kept").alias("kept"))
    return plans.join(decided, "name")


def clustered(entries: DataFrame, per_manifest: int) -> DataFrame:
    """entries (spec_id, part_key, manifest_pos, entry_pos) with `position` and `manifest_no` within their spec: in
    partition order, ties in commit order, cut into manifests of so many entries. Ranges share a spec's entries."""
    found = placed(entries, F.col("spec_id").asc(), F.col("part_key").asc(), F.col("manifest_pos").asc(), F.col("entry_pos").asc(), label="entries")
    return before(found, F.lit(1), "position", ("spec_id",)).withColumn("manifest_no", F.floor(F.col("position") / per_manifest).cast("bigint"))
