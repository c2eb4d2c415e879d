"""Chroma audio fingerprints, and the alignment of recordings by offset histograms and bit errors.

A recording's samples become frames of twelve pitch-class energies. Sixteen filters, each a difference of two
rectangles over 16 frames, are read off an integral image of the frames and give two bits each: one packed 32-bit
integer per frame. Two successive integers are a landmark.

search() aligns a stated set of recordings against all of them. Its landmarks are two integers so far apart that their
filters share no frame, which makes chance matches rare. All recordings are indexed by theirs; the queries look up
theirs with every choice of their least certain bits flipped, so that recordings meet whose bits differ. The offsets of
a pair's matches form a histogram, and its fullest offset is checked by the share of differing bits over the whole
overlap. Recordings with equal integers are one node; a landmark that many hold is split among tasks.

align() joins all recordings with each other by landmarks of two successive integers. A landmark's recordings first
meet its pivot, the one with the smallest id. Then those meet each other that these links leave in different components,
or of which the larger has no smaller partner yet: linear where recordings agree, and n * n / 2 pairs for a landmark of
n recordings that do not. Offsets are checked as above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import checked, join_groups, join_salted, join_split, small_batches, staged
from tidelake.llm.components import components

#: Samples of a frame, and from one frame to the next, at 4,096 samples a second (other rates: in proportion, so that
#: frames part semitones and follow each other alike at any rate); lowest and highest frequency that counts; samples
#: transformed at once.
FRAME, HOP, LOWEST, HIGHEST, AT_ONCE = 1024, 256, 60.0, 1800.0, 2**21
#: Frames under a filter, filters, log ratio at which a filter's outer bits change.
WIDTH, FILTERS, STEP = 16, 16, 0.15
#: Largest share of differing bits of recordings that align, and fewest frames of their overlap.
MOST_ERRORS, LEAST_OVERLAP = 0.2, 16
#: Of a search: frames between the integers of a landmark, their uncertain bits that are flipped (of each integer), and
#: every how many frames a query is looked up.
GAP, WEAK, STRIDE = WIDTH, 3, 2


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of each filter, by rule: four kinds over four bands."""
    return [(i % 4, 3 * (i // 4), 3 if i % 4 == 3 else 6 if i // 4 < 2 else 3, (16, 8, 12, 4)[i % 4]) for i in range(FILTERS)]


def frame_of(rate: int) -> int:
    """Samples of a frame at this rate."""
    return max(4, round(FRAME * rate / 4096))


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame scaled to sum to 1 (silence: to nought). Spectra are made for a
    bounded number of frames at a time, however long the recording is."""
    frame = frame_of(rate)
    hop = max(1, round(HOP * rate / 4096))
    n = (len(samples) - frame) // hop + 1
    if n < 1:
        return np.zeros((0, 12))
    pitches = np.fft.rfftfreq(frame, 1 / rate)
    heard = (pitches >= LOWEST) & (pitches <= HIGHEST)
    classes = np.eye(12)[np.round(12 * np.log2(pitches[heard] / 440)).astype(int) % 12]
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop][:n]
    energy = np.empty((n, 12))
    for at in range(0, n, block := max(1, AT_ONCE // frame)):
        power = np.abs(np.fft.rfft(views[at : at + block] * np.hanning(frame))) ** 2
        energy[at : at + block] = power[:, heard] @ classes
    total = energy.sum(axis=1, keepdims=True)
    return np.divide(energy, total, out=np.zeros_like(energy), where=total > 1e-9)


def codes(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each run of WIDTH frames."""
    return codes_and_weak(frames)[0]


def codes_and_weak(frames: np.ndarray, weak: int = WEAK) -> tuple[np.ndarray, np.ndarray]:
    """codes, and of each the `weak` bits whose filters lie nearest to where the bit changes, five binary digits for
    each bit's place."""
    n = len(frames) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)

    def area(t: int, w: int, p: int, h: int) -> np.ndarray:
        """Sum over w frames from t on and h pitch classes from p on, for every position."""
        a, b = slice(t, t + n), slice(t + w, t + w + n)
        return image[b, p + h] - image[a, p + h] - image[b, p] + image[a, p]

    out, margins = np.zeros(n, np.int64), []
    for kind, p, h, w in filters():
        if kind == 0:  # the whole band against the rest
            x, y = area(0, w, p, h), area(0, w, 0, 12) - area(0, w, p, h)
        elif kind == 1:  # earlier against later
            x, y = area(0, w, p, h), area(WIDTH - w, w, p, h)
        elif kind == 2:  # lower against upper half of the band
            x, y = area(0, w, p, h // 2), area(0, w, p + h // 2, h - h // 2)
        else:  # the middle in time against both sides
            m = (WIDTH - w) // 2
            x, y = area(m, w, p, h) * 2, area(0, m, p, h) + area(WIDTH - m, m, p, h)
        ratio = np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(y, 0))
        level = (ratio > -STEP).astype(np.int64) + (ratio > 0) + (ratio > STEP)
        out = (out << 2) | (level ^ (level >> 1))  # Gray code: neighbouring levels differ in one bit
        margins += [np.abs(ratio), np.abs(np.abs(ratio) - STEP)]
    places = 31 - np.argsort(np.array(margins), axis=0, kind="stable")[:weak]
    return out, np.bitwise_or.reduce(places.astype(np.int64) << (5 * np.arange(weak))[:, None], axis=0)


def fingerprints(media: DataFrame, id_col: str, samples_col: str, rate: int) -> DataFrame:
    """(id_col, codes array<long>, weak array<long>) from samples (array of numbers). Null and short recordings have no
    codes, silent ones equal codes; nulls among samples count as nought. weak: as codes_and_weak gives it."""
    small_batches(media.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            heard = (v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0) for v in batch.column(1))
            found = [codes_and_weak(chroma(np.nan_to_num(v.astype(float)), rate)) for v in heard]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i].tolist() for f in found], lists) for i in (0, 1))], [id_col, "codes", "weak"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, samples_col).mapInArrow(compute, f"`{id_col}` {kind}, codes array<long>, weak array<long>")


def landmarks_of(codes: np.ndarray, gap: int) -> np.ndarray:
    """One 64-bit integer for each pair of codes that are gap frames apart."""
    wide = codes.view(np.uint64)
    return ((wide[:-gap] << np.uint64(32)) | wide[gap:]).view(np.int64) if len(codes) > gap else codes[:0]


def probes_of(codes: np.ndarray, weak: np.ndarray, gap: int, stride: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, landmarks) of a query: every stride-th landmark with each choice of both codes' weak bits flipped."""
    base = landmarks_of(codes, gap)[::stride].view(np.uint64)
    at = np.arange(0, max(0, len(codes) - gap), stride)
    for of, shift in ((weak[at], 32), (weak[at + gap], 0)):
        for i in range(bits):
            flip = np.uint64(1) << (((of >> (5 * i)) & 31) + shift).astype(np.uint64)
            tiled = len(base) // max(1, len(at))
            base = np.concatenate([base, base ^ np.tile(flip, tiled)])
    return np.tile(at, len(base) // max(1, len(at))), base.view(np.int64)


def _indexed(gap: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [landmarks_of(c, gap) for c in batch.column(1).to_numpy(zero_copy_only=False)]
            new = [np.flatnonzero(np.r_[True, m[1:] != m[:-1]]) if len(m) else m for m in marks]  # of a run, the first
            rows = np.repeat(np.arange(len(marks)), [len(x) for x in new])
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([*new, rows[:0]]).astype(np.int32)), pa.array(np.concatenate([*(m[x] for m, x in zip(marks, new, strict=True)), rows[:0]]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["other", "its", "mark"])

    return index


def _looked_up(gap: int, stride: int, bits: int):
    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, codes, weak in zip(batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)), strict=True):
                at, marks = probes_of(codes, weak, gap, stride, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([0] * 0)) if not len(at) else pa.array([key.as_py()] * len(at), batch.column(0).type), pa.array(at.astype(np.int32)), pa.array(marks)], ["id", "at", "mark"])

    return look_up


def search(prints: DataFrame, id_col: str, queries: Column, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP, gap: int = GAP, stride: int = STRIDE, bits: int = WEAK) -> DataFrame:
    """One row per distinct id of prints (id_col, codes, weak) for which the condition `queries` holds: id_col, n_codes,
    aligned_to, offset, bit_error, votes, n_aligned.

    n_aligned counts the other recordings that a query meets by a landmark and whose share of differing bits is below
    most_errors over at least least_overlap frames at the pair's fullest offset (ties: the smallest shift). aligned_to
    is the best of them: the smallest share (ties: most votes, then smallest id); null if there is none. offset: the
    query's frame less the other's. Recordings with equal codes come before all others, are met without landmarks, and
    have no votes.
    Of rows that repeat an id the one with most codes counts; null ids have no row, an empty table gives none.
    """
    kind = prints.schema[id_col].dataType.simpleString()
    ids = prints.where(F.col(id_col).isNotNull()).withColumn("_asked", queries).withColumn("_id", F.col(id_col))
    one = ids.groupBy(F.col("_id").alias("id")).agg(F.max_by(F.struct("codes", "weak", "_asked"), F.struct(F.size("codes"), "codes")).alias("r"))
    one = staged(one.select("id", F.coalesce("r.codes", F.array().cast("array<long>")).alias("codes"), F.coalesce("r.weak", F.array().cast("array<long>")).alias("weak"), F.coalesce("r._asked", F.lit(False)).alias("asked")).withColumn("digest", F.sha2(F.array_join("codes", ","), 256)), "prints")
    able = one.where(F.size("codes") >= max(2, least_overlap))  # no other can overlap enough
    classes = able.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size"))
    classes = staged(classes, "classes")
    second = able.join(classes.where("size > 1").select("digest", "node"), "digest").where("id <> node").groupBy("node").agg(F.min("id").alias("next"))
    nodes = staged(able.select("id", "codes", "weak").join(classes.select(F.col("node").alias("id"), "size"), "id"), "nodes")
    n_nodes = nodes.count()
    # a query stands for all queries with its codes
    asked = join_groups(able.where("asked").select("id", "digest"), classes, "digest", "size", able.count()).select("id", "node", "size")
    asked = staged(asked, "asked")
    asking = asked.select(F.col("node").alias("id")).distinct()
    query = staged(nodes.join(checked(asking), "id", "left_semi").select("id", "codes", "weak"), "queries")

    index = nodes.select("id", "codes").mapInArrow(_indexed(gap), f"other {kind}, its int, mark long")
    wanted = query.mapInArrow(_looked_up(gap, stride, bits), f"id {kind}, at int, mark long")
    met = join_split(wanted, index, "mark", max(100, n_nodes // 1000)).where("id <> other")
    histogram = met.groupBy("id", "other", (F.col("at") - F.col("its")).alias("offset")).agg(F.count("*").alias("votes"))
    fullest = histogram.groupBy("id", "other").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("h"))
    fullest = staged(fullest.select("id", "other", "h.votes", "h.offset"), "offsets")
    both = join_salted(fullest, nodes.select(F.col("id").alias("other"), F.col("codes").alias("theirs"), F.col("size").alias("held")), "other", "id")
    both = join_salted(both, query.select("id", "codes"), "id", "other")
    a, b = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    overlap = F.least(F.size("codes") - a, F.size("theirs") - b)
    bits_off = F.aggregate(F.zip_with(F.slice("codes", a + 1, overlap), F.slice("theirs", b + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    close = both.withColumn("overlap", overlap).where(F.col("overlap") >= least_overlap).withColumn("bit_error", bits_off / (32 * F.col("overlap"))).where(F.col("bit_error") < most_errors)
    best = close.groupBy(F.col("id").alias("node")).agg(F.min(F.struct("bit_error", (-F.col("votes")).alias("less"), F.col("other").alias("to"), "offset")).alias("m"), F.sum("held").alias("met"))

    rows = asked.join(best, "node", "left").join(second, "node", "left")
    twin = F.when(F.col("id") == F.col("node"), F.col("next")).otherwise(F.col("node"))
    twin = F.when((F.col("size") > 1) & F.lit(0.0 < most_errors), F.struct(F.lit(0.0).alias("bit_error"), F.lit(0).cast("long").alias("less"), twin.alias("to"), F.lit(0).alias("offset")))
    m = F.coalesce(twin, F.col("m"))
    found = rows.select("id", m.alias("m"), (F.coalesce("met", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_aligned"))
    return one.where("asked").select("id", "codes").join(found, "id", "left").select(
        F.col("id").alias(id_col), F.size("codes").cast("long").alias("n_codes"), F.col("m.to").alias("aligned_to"), F.col("m.offset").cast("long").alias("offset"), F.col("m.bit_error").alias("bit_error"), (-F.col("m.less")).alias("votes"), F.coalesce("n_aligned", F.lit(0).cast("long")).alias("n_aligned")
    )


def align(prints: DataFrame, id_col: str, most_errors: float = MOST_ERRORS, least_overlap: int = LEAST_OVERLAP) -> DataFrame:
    """One row per distinct id of prints (id_col, codes): id_col, n_codes, aligned_to, offset, bit_error, votes.

    aligned_to is null only if none of the recordings that have a smaller id and a common landmark is below most_errors
    over least_overlap frames at the fullest offset (ties: the smallest shift). Else it is the best of those that were
    met: the smallest share of differing bits (ties: most votes, then smallest id). offset: this recording's frame less
    the other's. Of rows that repeat an id the one with most codes counts; null ids have no row.
    """
    one = prints.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max_by("codes", F.struct(F.size("codes"), "codes")).alias("codes"))
    one = staged(one.withColumn("digest", F.sha2(F.array_join("codes", ","), 256)), "prints")
    able = one.where(F.size("codes") >= max(2, least_overlap))  # no other can overlap enough
    equal = staged(able.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size")).where("size > 1"), "equal")
    copies = join_groups(able, equal, "digest", "size", able.count()).where("id <> node").where(F.lit(0.0) < most_errors)
    copies = staged(copies.select("id", "node", (1 - F.size("codes")).cast("long").alias("less")), "copies")
    nodes = able.join(checked(copies.select("id")), "id", "left_anti")
    landmarks = staged(nodes.select("id", F.posexplode(F.expr("transform(sequence(1, size(codes) - 1), i -> xxhash64(codes[i - 1], codes[i]))")).alias("at", "mark")), "landmarks")
    buckets = landmarks.groupBy("mark").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("size")).where("pivot <> last")
    members = staged(join_groups(landmarks, staged(buckets.drop("last"), "buckets"), "mark", "size", landmarks.count()), "members")

    def verified(met: DataFrame) -> DataFrame:
        """(id, other, offset, votes, bit_error) of the pairs that align, from one row (id, other, offset) per vote."""
        histogram = met.groupBy("id", "other", "offset").agg(F.count("*").alias("votes"))
        fullest = staged(histogram.groupBy("id", "other").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")).alias("h")).select("id", "other", "h.votes", "h.offset"), "offsets")
        met_by = fullest.groupBy("other").agg(F.count("*").alias("n"))
        theirs = met_by.join(nodes.select(F.col("id").alias("other"), F.col("codes").alias("theirs")), "other")
        both = join_groups(fullest, theirs, "other", "n", fullest.count()).join(nodes.select("id", "codes"), "id")
        a, b = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
        overlap = F.least(F.size("codes") - a, F.size("theirs") - b)
        bits = F.aggregate(F.zip_with(F.slice("codes", a + 1, overlap), F.slice("theirs", b + 1, overlap), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        close = both.withColumn("overlap", overlap).where(F.col("overlap") >= least_overlap).withColumn("bit_error", bits / (32 * F.col("overlap")))
        return staged(close.where(F.col("bit_error") < most_errors).select("id", "other", "offset", "votes", "bit_error"), "aligned")

    pivots = members.where("id = pivot").groupBy("mark", "size", "pivot").agg(F.collect_list("at").alias("ats"))
    to_pivots = join_groups(members.where("id <> pivot").select("id", "at", "mark"), pivots, "mark", "size", landmarks.count())
    first = verified(to_pivots.select("id", F.col("pivot").alias("other"), "at", F.explode("ats").alias("its")).select("id", "other", (F.col("at") - F.col("its")).alias("offset")))

    # of one landmark's others, those that are still apart, or that have no smaller partner
    labels = components(first.select(F.col("id").alias("a"), F.col("other").alias("b")))
    state = labels.withColumnRenamed("node", "id").join(first.select("id", F.lit(True).alias("led")).distinct(), "id", "left")
    parts = members.where("id <> pivot").select("mark", "id", "at").join(checked(staged(state, "state")), "id", "left").select("mark", "id", "at", F.coalesce("label", "id").alias("label"), F.coalesce("led", F.lit(False)).alias("led"))
    split = parts.groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("label").alias("l"), F.max("label").alias("h"), F.every("led").alias("led"), F.count("*").alias("count")).where("low <> high and (l <> h or not led)")
    loose = staged(join_groups(parts, split.select("mark", "count"), "mark", "count", landmarks.count()).drop("count"), "loose")
    theirs = loose.select("mark", F.col("id").alias("other"), F.col("at").alias("its"), F.col("label").alias("its_label"))
    rest = loose.join(theirs, "mark").where("id > other and (not led or label <> its_label)")
    second = verified(rest.select("id", "other", (F.col("at") - F.col("its")).alias("offset")))

    as_found = lambda less, to, offset, error: F.struct(error.alias("bit_error"), less.alias("less"), to.alias("to"), offset.alias("offset"))
    best = first.unionAll(second).groupBy("id").agg(F.min(as_found(-F.col("votes"), F.col("other"), F.col("offset"), F.col("bit_error"))).alias("m"))
    of_copies = copies.join(best.select(F.col("id").alias("node"), "m"), "node", "left").select("id", F.least(as_found(F.col("less"), F.col("node"), F.lit(0), F.lit(0.0)), "m").alias("m"))
    return one.join(best.unionAll(of_copies), "id", "left").select(
        F.col("id").alias(id_col), F.size("codes").cast("long").alias("n_codes"), F.col("m.to").alias("aligned_to"), F.col("m.offset").cast("long").alias("offset"), F.col("m.bit_error").alias("bit_error"), (-F.col("m.less")).alias("votes")
    )
