"""Compression-distance classification of toxic text.

Two zstandard dictionaries are trained on labelled rows: one on ordinary text (its most common words), one on toxic
text (first what toxic text has far more often than ordinary text, then the same common words, so that the two
differ by that alone). A text is cut into windows of some words; a window's gain is by how many bytes the toxic
dictionary compresses it better than the ordinary one. The gains of a text give four figures, and a logistic
calibration on labelled rows that took no part in the dictionaries turns them into a probability.

How often something occurs is counted over distinct pairs of a word and the word before it: a passage that is
copied into many rows counts once, a term that stands in ever new places counts each time.
"""

from __future__ import annotations

import functools
import itertools
import math
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import small_batches, staged

#: What training takes at most of a class (the distinct texts with the smallest hashes): texts, and bytes of text in
#: all; and the longest text, in bytes, that it takes. Scoring has no such bound.
TOXIC_ROWS, ORDINARY_ROWS, TOXIC_BYTES, ORDINARY_BYTES, ROW_BYTES = 2500, 5000, 24_000_000, 24_000_000, 64_000
#: Bytes of a window at which it is closed; longest word piece; zstandard's level.
WINDOW, LONGEST, LEVEL = 64, 256, 6
#: Common words in both dictionaries; least log ratio of a toxic term; its least share of word pairs; terms at most.
COMMON, RATIO, SHARE, TERMS = 1500, 3.0, 2e-5, 2000


@dataclass(frozen=True)
class Model:
    """The two dictionaries and the calibration; a few ten KB, whatever the input's size."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def words_of(text: str | None) -> list[bytes]:
    found = (text or "").lower().encode().split()
    if all(len(w) <= LONGEST for w in found):
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


def windows(words: list[bytes]) -> list[bytes]:
    out, first, size = [], 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(words[first : i + 1]))
            first, size = i + 1, 0
    if first < len(words):
        out.append(b" %b " % b" ".join(words[first:]))
    return out


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def figures(model: Model, text: str | None) -> tuple[float, float, float, float]:
    """Of a text's window gains: the largest, the three largest, the share above two bytes; and the logarithm of how
    many windows there are. Nought for an empty text."""
    toxic, ordinary = _compressor(model.toxic).compress, _compressor(model.ordinary).compress
    gains = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(words_of(text))), reverse=True)
    if not gains:
        return 0.0, 0.0, 0.0, 0.0
    return float(gains[0]), float(sum(gains[:3])), sum(g > 2 for g in gains) / len(gains), math.log(len(gains))


def _design(rows: list[tuple[float, float, float, float]]) -> np.ndarray:
    x = np.array(rows, float).reshape(-1, 4)
    top = np.clip(x[:, 0], -4, 16)
    return np.column_stack([np.ones(len(x)), top, np.clip(x[:, 1], -8, 40), 10 * x[:, 2], x[:, 3], (top <= 1).astype(float)])


def probabilities(model: Model, texts: list[str | None]) -> np.ndarray:
    z = _design([figures(model, t) for t in texts]) @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _endings(texts: list[str]) -> tuple[Counter, int]:
    """How many distinct words stand before each word, and how many distinct pairs of words there are."""
    ids: dict[bytes, int] = {b"": 0}
    pairs = [np.empty(0, np.int64)]
    for t in texts:
        own = np.array([0, *(ids.setdefault(w, len(ids)) for w in words_of(t))], np.int64)
        pairs.append(np.unique((own[:-1] << 32) | own[1:]))
    distinct = np.unique(np.concatenate(pairs))
    counts = np.bincount(distinct & 0xFFFFFFFF, minlength=len(ids))
    return Counter({w: int(n) for w, n in zip(ids, counts, strict=True) if n}), len(distinct)


def _terms(endings: Counter, only: set[str] | None = None) -> Counter:
    """How many pairs end in a word, or a word that begins so (4 to 9 letters)."""
    found: Counter = Counter()
    for word, n in endings.items():
        w = word.decode(errors="ignore").strip(".,;:!?\"'()")
        for term in {*(f" {w[:k]}" for k in range(4, min(len(w), 9) + 1)), *([f" {w} "] if 3 <= len(w) <= 24 else [])}:
            if only is None or term in only:
                found[term] += n
    return found


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary; what occurs most stands last, where references are short."""
    common = Counter(w for t in ordinary for w in set(words_of(t)))
    base = b" ".join(w for w, _ in reversed(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON])) + b" "
    (of_toxic, n_toxic), (of_ordinary, n_ordinary) = _endings(toxic), _endings(ordinary)
    often = {t: n for t, n in _terms(of_toxic).items() if n >= max(4, SHARE * n_toxic)}
    other = _terms(of_ordinary, set(often))
    ratio = lambda t: math.log((often[t] + 0.5) / (n_toxic + 1)) - math.log((other[t] + 0.5) / (n_ordinary + 1))
    kept: list[str] = []
    for term in sorted((t for t in often if ratio(t) > RATIO), key=lambda t: (-often[t] * len(t), t)):
        if len(kept) < TERMS and not any(k.rstrip() in term or term.rstrip() in k for k in kept):
            kept.append(term)
    return "".join(reversed(kept)).encode() + base, base


def fit_rows(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """A model from texts of both classes; prior: the share of toxic rows among all labelled ones. Two thirds train
    the dictionaries, the rest the calibration. With a class missing, every score is the prior."""
    if not toxic or not ordinary:
        z = math.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
        return Model(b" ", b" ", (max(-30.0, min(30.0, z)), 0.0, 0.0, 0.0, 0.0, 0.0))
    deal = random.Random(7)
    toxic, ordinary = deal.sample(toxic, len(toxic)), deal.sample(ordinary, len(ordinary))
    part = lambda x: (x[: -(-2 * len(x) // 3)], x[-(-2 * len(x) // 3) :] or x)
    (t, t2), (o, o2) = part(toxic), part(ordinary)
    bare = Model(*dictionaries(t, o), (0.0,) * 6)
    x = _design([figures(bare, s) for s in [*t2, *o2]])
    y = np.array([1.0] * len(t2) + [0.0] * len(o2))
    weight = np.where(y == 1, prior / len(t2), (1 - prior) / len(o2)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(bare.toxic, bare.ordinary, tuple(float(v) for v in w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from docs and their labels (id_col, label_col: 1 or 0; rows with others and null texts are left out).

    Hashes and sizes of the labelled texts choose a bounded sample of each class, whose texts alone come to the
    driver; whole texts are neither shuffled nor sorted for it. The prior is counted over all labelled rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    rows = rows.withColumns({"h": F.xxhash64("t"), "size": F.octet_length("t")})
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    keys = rows.select("id", "h", "size").join(marks, "id").groupBy("y", "h").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    keys = staged(keys, "labelled")
    sizes = {r.y: (r.n, r.texts) for r in keys.groupBy("y").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()}
    chosen: dict[int, list[str]] = {}
    for y, most, limit in ((1, TOXIC_ROWS, TOXIC_BYTES), (0, ORDINARY_ROWS, ORDINARY_BYTES)):
        # hashes are spread evenly: four times as many as are wanted lie below this one, however many tasks look
        below = min(2**63 - 1, -(2**63) + 2**64 * 4 * most // max(1, sizes.get(y, (0, 0))[1]))
        found = keys.where((F.col("y") == y) & (F.col("h") <= below) & (F.col("size") <= ROW_BYTES)).orderBy("h").limit(most).select("h", "size").collect()
        hashes = [r.h for r, total in zip(found, itertools.accumulate(r.size for r in found), strict=True) if total <= limit]
        if not hashes:
            chosen[y] = []
            continue
        near = rows.where((F.col("h") <= hashes[-1]) & (F.col("size") <= ROW_BYTES)).join(marks.where(F.col("y") == y), "id")
        texts = near.groupBy("h").agg(F.first("t").alias("t")).collect()
        chosen[y] = [r.t for r in sorted(texts, key=lambda r: r.h)]
    prior = sizes.get(1, (0, 0))[0] / max(1, sum(n for n, _ in sizes.values()))
    return fit_rows(chosen[1], chosen[0], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the probability that a whole text is toxic. Empty and null texts get that of a text without any
    gain; repeated rows get equal scores; nothing but the text is read for it."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(probabilities(model, texts.tolist()))

    return docs.withColumn(score_col, scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
