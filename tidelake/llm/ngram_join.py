"""N-gram Jaccard self-join by token-combination prefixes.

A document is its set of distinct word shingles, as 64-bit hashes; equal sets are one node. With a threshold t, a
set of n shingles lacks at most m = n - ceil(t n) shingles of any partner, so partners share one of the first
m + 1 shingles of a common order. The order is: rare shingles by hash, then frequent ones by hash. The frequent ones
are a table of bounded size (`TABLE`): shingles that more than `frequent` sets hold in their window (the part of the
set with the smallest hashes, a quarter of a large one), or hold at all, among sets whose window is mostly frequent;
if the table would be too large, that bound rises. Which shingles it lists decides what is done, not what is found.

Rare shingles are indexed singly. Most sets have m + 1 of them in their window. The others are read whole; where even
the whole set has not enough rare ones, its prefix is extended into the frequent ones, which fall into G classes by
hash: two shared shingles of one class are then enough, and pairs of prefix shingles of a class are indexed. A prefix
with r rare and p_g frequent shingles of class g is long enough when r + sum(max(0, p_g - 1)) > m: however m of them
are lost, a single or a pair survives. G depends on the size class only, and partners' size classes differ by one at
most, so a set is indexed under its own and the next.

Buckets of the index name candidates without all their pairs: first every member meets its bucket's pivot (the one
with the smallest part of rare shingles), links give components, and then only members of different components
meet, if their sizes and their numbers of rare shingles allow it. Candidates are pruned by the part of the hash
order that both windows cover (an exact bound) and then verified on whole sets. No link between different texts is
lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import checked, discard, join_groups, join_salted, release, small_batches, staged
from tidelake.llm.components import components
from tidelake.llm.fasthash import mix, segment_hashes, shingle_hashes

#: Windows that hold a shingle beyond which it counts as frequent; frequent shingles at most; least threshold in percent.
FREQUENT, TABLE, LEAST_PERCENT = 32, 1_000_000, 62
#: Members of a bucket, of one size class and in different components, that one task compares with the others.
SPLIT = 500
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted hashes (signed) of its distinct k-word shingles; with fewer words, of all its words
    as one; none for a null or blank text. A-Z are lower-cased, words are parted by [\\x20\\x09-\\x0D]."""
    data = [(t or "").encode().lower() for t in texts]
    joined = np.frombuffer(b"\n".join([b"", *data, b""]), np.uint8)
    word = _WORD[joined]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = segment_hashes(joined, starts, ends)
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)
    grams, sets = shingle_hashes(hashes, k), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = grams[a : b - k + 1] if b - a >= k else mix(shingle_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else hashes[:0]
        sets.append(np.unique(own.view(np.int64)))
    return sets


def spare(n: int, percent: int) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-percent * n // 100)


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        yield batch.column(0), shingle_sets(batch.column(1).to_pylist(), k)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)]).astype(np.int64)))


def size_class(n: int, percent: int) -> int:
    """Classes are so wide that sizes of partners lie in one class or in neighbours."""
    return math.floor(math.log(n) / math.log(100 / (percent - 0.1)))


def pair_classes(c: int, percent: int) -> int:
    """How many classes the frequent shingles of a size class fall into."""
    return max(1, math.floor((100 / (percent - 0.1)) ** c * (100 - percent) / 100))


def window(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set, enough for m + 1 rare ones in most cases; none for a set so small that it has
    no partner but its equals."""
    n = len(shingles)
    need = spare(n, percent) + 1
    alone = 100 * n < percent * (n + 1) and 100 * (n - 1) < percent * n
    return shingles[: 0 if alone else need + need // 2 + 8]


def _sketch(k: int, percent: int):
    def sketch(batches):
        for ids, sets in _batches(batches, k):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists([window(s, percent) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "prefix"])

    return sketch


def _counted(k: int, most: int = 1_000_000):
    """How many sets hold each shingle, added up within a task as far as `most` shingles allow."""

    def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        return distinct, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    def count(batches):
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, sets in _batches(batches, k):
            keys, counts = merge([keys, *sets], [counts, *(np.ones(len(s), np.int64) for s in sets)])
            if len(keys) > most:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "count"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "count"])

    return count


def _sets(k: int):
    def sets(batches):
        for ids, found in _batches(batches, k):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in found], pa.int64()), _lists(found)], ["id", "n", "shingles"])

    return sets


def combination_keys(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The single and the paired index keys of a whole set, given the sorted table of frequent shingles, and how many of
    its shingles are rare."""
    n = len(shingles)
    common = np.zeros(n, bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    rare, need = shingles[~common], spare(n, percent) + 1
    if len(rare) >= need:
        return rare[:need], rare[:0], len(rare)
    pairs, paired = [rare[:0]], shingles[common]
    own = size_class(n, percent)
    for c in (own, own + 1):
        of = mix(paired.view(np.uint64) + np.uint64(c)) % np.uint64(pair_classes(c, percent))
        later = np.ones(len(paired), bool)
        later[np.unique(of, return_index=True)[1]] = False  # the first of a class alone saves nothing
        end = int(np.searchsorted(np.cumsum(later), need - len(rare))) + 1
        order = np.argsort(of[:end], kind="stable")
        taken, of = paired[:end][order].view(np.uint64), of[:end][order]
        for gap in range(1, len(taken)):
            pair = of[gap:] == of[:-gap]
            if not pair.any():
                break
            pairs.append(mix(mix(taken[:-gap][pair] + np.uint64(2 * c + 1)) ^ taken[gap:][pair]).view(np.int64))
    return rare, np.concatenate(pairs), len(rare)


def _keys(k: int, percent: int, frequent):
    def keys(batches):
        for ids, sets in _batches(batches, k):
            made = [combination_keys(s, frequent.value, percent) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), _lists([m[0] for m in made]), _lists([m[1] for m in made]), pa.array([m[2] for m in made], pa.int64())], ["id", "n", "singles", "pairs", "rare"])

    return keys


def _least(a: str, b: str, percent: int):
    """The smallest intersection of two linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.col(a) > 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id, the smallest id that links reach from here.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets. Null and blank texts
    have no shingles and no link. Rows with the same id are one document, of which the row with the most shingles
    counts. A row with a null id links with nothing and has a null component_id. Other columns are not read.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is from {LEAST_PERCENT} to 100")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    sketches = staged(texts.mapInArrow(_sketch(k, percent), f"id {id_type}, n long, digest binary, prefix array<long>"), "sketches")
    linkable = sketches.where("n > 0 and id is not null")
    repeats = not linkable.groupBy("id").count().where("count > 1").isEmpty()
    if repeats:
        whole_row = F.struct("n", "digest", "prefix")
        linkable = staged(linkable.groupBy("id").agg(F.max_by(whole_row, F.struct("n", "digest")).alias("s")).select("id", "s.*"), "sketches")
    total = linkable.count()

    # equal sets are one node, their smallest id
    equal = staged(linkable.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size")).where("size > 1"), "equal")
    copies = staged(join_groups(linkable.select("id", "digest"), equal, "digest", "size", total).where("id <> node").select("id", "node"), "copies")
    need = F.expr(f"(n - ({percent} * n + 99) div 100 + 1)").cast("int")
    nodes = linkable.join(checked(copies.select("id")), "id", "left_anti").select("id", "n", "prefix", need.alias("need"))
    postings = nodes.select("id", F.explode("prefix").alias("key"))

    def bounded(counts: DataFrame) -> DataFrame:
        """Keys and counts of the frequent ones, in a staged table of TABLE rows at most."""
        counts, least = staged(counts.where(F.col("count") > frequent), "often"), frequent
        while counts.where(F.col("count") > least).limit(TABLE + 1).count() > TABLE:
            least *= 2
        return counts.where(F.col("count") > least)

    def common_of(often: DataFrame) -> DataFrame:
        return postings.join(F.broadcast(often.select("key")), "key").groupBy("id")

    def too_few(often: DataFrame) -> DataFrame:
        """The ids of nodes whose window holds too few rare shingles."""
        sizes = nodes.select("id", "need", F.size("prefix").alias("size"))
        return staged(sizes.join(common_of(often).agg(F.count("*").alias("common")), "id").where("size - common < need").select("id"), "ids")

    def rows_of(ids: DataFrame) -> DataFrame:
        """The texts of nodes; of rows that share an id, all are counted and one decides."""
        return texts.join(checked(ids), "id", "left_semi")

    often = bounded(postings.groupBy("key").count())
    short = too_few(often)
    if not short.isEmpty():
        deep = rows_of(short).mapInArrow(_counted(k), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
        often = bounded(often.unionAll(deep).groupBy("key").agg(F.max("count").alias("count")))
        discard(short)
        short = too_few(often)
    theirs = common_of(often).agg(F.collect_list("key").alias("common"))  # parts of a window
    left = staged(nodes.join(theirs, "id").select("id", "n", "need", F.array_except("prefix", "common").alias("left")), "left")
    release(spark)
    table = spark.sparkContext.broadcast(np.sort(often.select("key").toArrow()["key"].to_numpy()))
    combined = rows_of(short).mapInArrow(_keys(k, percent, table), f"id {id_type}, n long, singles array<long>, pairs array<long>, rare long")
    combined = staged(combined.groupBy("id").agg(F.max_by(F.struct("n", "singles", "pairs", "rare"), "n").alias("r")).select("id", "r.*") if repeats else combined, "keys")

    def singly(rows: DataFrame, shingles: str) -> DataFrame:
        return rows.select("id", "n", F.col("n").alias("rare"), F.lit(1.0).alias("part"), F.lit(False).alias("paired"), F.explode(F.slice(shingles, F.lit(1), F.col("need"))).alias("key"))

    part = (F.col("rare") / F.col("n")).alias("part")
    index = (
        singly(nodes.join(checked(left.select("id")), "id", "left_anti"), "prefix")
        .unionByName(singly(left.where(F.size("left") >= F.col("need")), "left"))
        .unionByName(combined.select("id", "n", "rare", part, F.lit(False).alias("paired"), F.explode("singles").alias("key")))
        .unionByName(combined.select("id", "n", "rare", part, F.lit(True).alias("paired"), F.explode("pairs").alias("key")))
    )

    buckets = index.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("part", "id", "n", "rare")).alias("p")).where("size > 1")
    buckets = staged(buckets.select("key", "size", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.rare").alias("pivot_rare")), "buckets")
    indexed = buckets.agg(F.sum("size")).first()[0] or 0
    members = staged(join_groups(index.select("key", "id", "n", "rare", "paired"), buckets, "key", "size", indexed), "members")
    discard(buckets, left, combined)
    release(spark)
    table.destroy()

    def able(a: str, b: str):
        """Whether members of one bucket may link. Sets that are indexed by pairs have all their rare shingles in the
        index: if they share one they meet there, and if they share none, all of these are missing."""
        least = lambda n, m: F.col(n) - _least("a_n", "b_n", percent) >= F.col(m)
        return _fits("a_n", "b_n", percent) & (~F.col("paired") | (least("a_n", a) & least("b_n", b)))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b, a_n, b_n), each once."""
        pairs = staged(pairs, "pairs")
        ends = lambda c, side: nodes.select(F.col("id").alias(side), F.col("prefix").alias(c))
        seen = join_salted(join_salted(pairs, ends("pa", "a"), "a", "b"), ends("pb", "b"), "b", "a")
        last = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
        upto = lambda c: F.size(F.filter(c, lambda x: x <= last))
        shared = F.size(F.array_intersect("pa", "pb"))
        least = _least("a_n", "b_n", percent)
        close = (upto("pa") - shared <= F.col("a_n") - least) & (upto("pb") - shared <= F.col("b_n") - least)
        able_pairs = staged(seen.where(close).select("a", "b"), "able")
        discard(pairs)
        release(spark)
        ids = able_pairs.select(F.col("a").alias("id")).unionAll(able_pairs.select("b")).distinct()
        found = texts.join(checked(staged(ids, "ids")), "id", "left_semi").mapInArrow(_sets(k), f"id {id_type}, n long, shingles array<long>")
        full = staged(found.groupBy("id").agg(F.max_by("shingles", "n").alias("shingles")) if repeats else found.select("id", "shingles"), "sets")
        sets = lambda c, side: full.select(F.col("id").alias(side), F.col("shingles").alias(c))
        both = join_salted(join_salted(able_pairs, sets("sa", "a"), "a", "b"), sets("sb", "b"), "b", "a")
        inter = F.size(F.array_intersect("sa", "sb"))
        links = staged(both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b"), "links")
        discard(full, able_pairs)
        release(spark)
        return links

    to_pivots = members.where(F.col("id") != F.col("pivot")).select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("rare").alias("ra"), F.col("pivot").alias("b"), F.col("pivot_n").alias("b_n"), F.col("pivot_rare").alias("rb"), "paired")
    first = verified(to_pivots.where(able("ra", "rb")).select("a", "b", "a_n", "b_n").distinct())
    labels = components(first)

    # members of one bucket that are still in different components
    parts = members.where("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = parts.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("count")).where("low <> high").select("key", "count")
    base = math.log(100 / (percent - 0.1))
    loose = staged(join_groups(parts, split, "key", "count", indexed).where("id <> pivot").select("key", "id", "n", "rare", "paired", "label", F.floor(F.log("n") / base).cast("int").alias("c")), "loose")
    discard(members)
    left = loose.select("key", F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("label").alias("la"), F.col("rare").alias("ra"), "paired", "c")
    right = loose.select("key", F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("label").alias("lb"), F.col("rare").alias("rb"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    # a bucket with many loose members is split: each part has some of the left ones, and all of the right ones
    big = loose.groupBy("key", "c").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).where("parts > 1")
    big = checked(staged(big, "split"))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(big, ["key", "c"], "left").withColumn("part", F.pmod(F.xxhash64("a"), parts.cast("long")).cast("int")).drop("parts")
    right = right.join(big, ["key", "c"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    rest = left.join(right, ["key", "c", "part"]).where((F.col("la") < F.col("lb")) & able("ra", "rb"))
    second = verified(rest.select("a", "b", "a_n", "b_n").distinct())
    discard(loose)
    label_of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    bridges = second.join(label_of("a"), "a", "left").join(label_of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined = components(bridges)

    nodes_of = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("component_id"))
    alone = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("label").alias("component_id"))
    top = staged(nodes_of.unionAll(alone), "components")
    # copies point to their node, everything else to itself
    of_copies = copies.join(top, "node", "left").select("id", F.coalesce("component_id", "node").alias("component_id"))
    placed = of_copies.unionAll(top.select(F.col("node").alias("id"), "component_id"))
    return sketches.select("id", "n").join(placed, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay. Columns as in docs."""
    found = near_duplicates(docs, id_col, text_col, k, percent)
    gone = staged(found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col)).distinct(), "near-copies")
    return docs.join(checked(gone), id_col, "left_anti").select(docs.columns)
