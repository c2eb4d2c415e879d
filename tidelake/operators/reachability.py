"""What a table reaches, what it may drop, and what lies in its folder without belonging to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions.paths import below, nested_root, normalize
from tidelake.operators.ordering import before, placed
from tidelake.sources.storage import shared


def reachable(data: DataFrame, manifests: DataFrame, manifest_lists: DataFrame, statistics: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, norm_path), each once; every argument has a column `path`. Deleted entries belong to data."""
    kinds = [("data", data), ("metadata", manifests), ("metadata", manifest_lists), ("statistics", statistics), ("metadata_json", documents)]
    parts = [df.select(F.lit(kind).alias("kind"), normalize(F.col("path")).alias("norm_path")) for kind, df in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def now_unreachable(before: DataFrame, after: DataFrame, location: str) -> DataFrame:
    """What an expiration leaves behind: reachable before, not after, inside the location, never a table document."""
    gone = before.where("kind <> 'metadata_json'").select("norm_path").subtract(after.select("norm_path"))
    return gone.where(below(normalize(F.lit(location)), F.col("norm_path")))


def retained(snapshots: DataFrame, now_ms: int, max_age_ms: int, keep: int) -> DataFrame:
    """snapshots (snapshot_id, parent_id, timestamp_ms, head) with `kept` and `depth` in the ancestry of its head.

    From each branch head (rows where head is true) the ancestry is walked by joins, one round per doubling of the
    distance, with one pointer per snapshot; the newest `keep` snapshots of a branch and those younger than the age
    stay, and so does a head. A parent that is not there ends the walk; ids do not repeat.
    """
    depth = ancestry(snapshots, snapshots.where("head").select("snapshot_id")).groupBy("snapshot_id").agg(F.min("depth").alias("depth"))
    rows = snapshots.join(depth, "snapshot_id", "left")
    kept = F.coalesce(F.col("depth") < keep, F.lit(False)) | F.coalesce(F.col("depth").isNotNull() & (F.lit(now_ms) - F.col("timestamp_ms") <= max_age_ms), F.lit(False)) | F.col("head")
    return rows.withColumn("kept", kept)


def ancestry(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, snapshot_id, depth): every head with itself (0), its parent (1) and so on. A round doubles the distance
    that a snapshot's one pointer spans and follows it from all that is marked, so rounds grow with its logarithm."""
    ids = snapshots.select(F.col("snapshot_id").alias("to"))
    pointer = shared(snapshots.where("parent_id is not null and parent_id <> snapshot_id").select("snapshot_id", F.col("parent_id").alias("to")).join(ids, "to", "left_semi"), "pointers")
    marked = shared(heads.select(F.col("snapshot_id").alias("head"), "snapshot_id", F.lit(0).alias("depth")), "ancestry")
    span, most = 1, snapshots.count()
    while span <= most and not pointer.isEmpty():
        far = marked.join(pointer, "snapshot_id").select("head", F.col("to").alias("snapshot_id"), (F.col("depth") + span).alias("depth"))
        marked = shared(marked.unionByName(far), "ancestry")
        onward = pointer.select(F.col("snapshot_id").alias("to"), F.col("to").alias("next"))
        pointer = shared(pointer.join(onward, "to").select("snapshot_id", F.col("next").alias("to")), "pointers")
        span *= 2
    return marked


def retained_by_refs(snapshots: DataFrame, refs: DataFrame, now_ms: int, max_age_ms: int, keep: int) -> DataFrame:
    """snapshots (snapshot_id, parent_id, timestamp_ms) with `kept`, under refs (name, kind, snapshot_id, max_ref_age_ms,
    max_snapshot_age_ms, min_to_keep; kind is branch or tag, the last three may be null and then fall back to no age,
    max_age_ms, keep).

    A ref other than main goes when its snapshot is older than its own age. Of each branch that stays, the newest
    snapshots up to its number and those younger than its age are kept; of each tag its snapshot; and of snapshots
    that no branch or tag reaches those younger than max_age_ms.
    """
    age = lambda c: F.lit(now_ms) - F.col(c)
    at = refs.join(snapshots.select("snapshot_id", "timestamp_ms"), "snapshot_id")
    live = at.where((F.col("name") == "main") | F.col("max_ref_age_ms").isNull() | (age("timestamp_ms") <= F.col("max_ref_age_ms")))
    live = shared(live.select("kind", "snapshot_id", F.coalesce("max_snapshot_age_ms", F.lit(max_age_ms)).alias("age"), F.coalesce("min_to_keep", F.lit(keep)).alias("keep")), "refs")
    branches = live.where("kind = 'branch'")
    reached = ancestry(snapshots, branches.select("snapshot_id").distinct())
    times = snapshots.select("snapshot_id", "timestamp_ms")
    of_branch = reached.join(branches.select(F.col("snapshot_id").alias("head"), "age", "keep"), "head").join(times, "snapshot_id")
    held = of_branch.where((F.col("depth") < F.col("keep")) | (age("timestamp_ms") <= F.col("age"))).select("snapshot_id")
    held = held.unionAll(live.where("kind = 'tag'").select("snapshot_id")).distinct().withColumn("held", F.lit(True))
    known = reached.select("snapshot_id").unionAll(live.select("snapshot_id")).distinct().withColumn("known", F.lit(True))
    rows = snapshots.join(held, "snapshot_id", "left").join(known, "snapshot_id", "left")
    kept = F.col("held").isNotNull() | (F.col("known").isNull() & (age("timestamp_ms") <= max_age_ms))
    return rows.select(*snapshots.columns, kept.alias("kept"))


def orphans(listing: DataFrame, reached: DataFrame, location: str, cutoff_ms: int) -> DataFrame:
    """listing (path, modified_ms) with `status`: reachable, outside, undated, young or orphan, asked in this order."""
    rows = listing.withColumn("norm_path", normalize(F.col("path")))
    flags = reached.select("norm_path").distinct().withColumn("reachable", F.lit(True))
    status = (
        F.when(F.col("reachable"), "reachable").when(~below(normalize(F.lit(location)), F.col("norm_path")), "outside")
        .when(F.col("modified_ms").isNull(), "undated").when(F.col("modified_ms") > cutoff_ms, "young").otherwise("orphan")
    )
    return rows.join(flags, "norm_path", "left").select("path", "norm_path", "size", "modified_ms", status.alias("status"))


def refusal(classified: DataFrame, has_snapshot: bool) -> DataFrame:
    """One row: scanned and observed counts, and whether removal is refused, as nothing listed is known to the table."""
    one = classified.agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "reachable").alias("observed"))
    return one.withColumn("refused", (F.col("scanned") > 0) & (F.col("observed") == 0) & F.lit(has_snapshot))


def below_ceiling(candidates: DataFrame, ceiling: int, column: str = "norm_path") -> DataFrame:
    """The first `ceiling` candidates in order: the most that one run deletes."""
    return candidates.orderBy(column).limit(ceiling)


def foreign_roots(listing: DataFrame, location: str) -> DataFrame:
    """Roots of other tables that lie inside the location, with how many documents name them."""
    found = listing.select(nested_root(F.lit(location), F.col("path")).alias("root")).where("root is not null")
    return found.groupBy("root").agg(F.count("*").alias("documents"))


def nested_siblings(tables: DataFrame) -> DataFrame:
    """(location, inside): for each of tables (location) the others that lie strictly below it. Every location meets the
    folders above it by equality, so many tables cost no pairs. Spellings are normalised; nulls have none."""
    own = tables.select(normalize(F.col("location")).alias("location")).where("location is not null").distinct()
    parts = F.split("location", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return own.select(F.col("location").alias("inside"), F.explode(F.array_distinct(above)).alias("location")).where("inside <> location").join(own, "location").select("location", "inside")


def newest_per_key(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key, by an aggregation that combines before it shuffles."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct(at, tie)).alias("r")).select("r.*")


def lineage(files: DataFrame, first: int = 0) -> DataFrame:
    """files (commit_pos, record_count) with `first_row_id`: the running sum of the records before, by ranges."""
    found = before(placed(files, F.col("commit_pos").asc(), label="files"), F.coalesce("record_count", F.lit(0)), "first_row_id")
    return found.withColumn("first_row_id", (F.lit(first) + F.col("first_row_id")).cast("bigint"))
