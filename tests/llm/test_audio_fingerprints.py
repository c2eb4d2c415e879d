"""Chroma fingerprints: integral-image filters against plain sums, and alignment of shifted recordings."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidelake.llm.audio_fingerprints import HOP, STEP, WIDTH, align, chroma, codes, codes_and_weak, filters, fingerprints, search

RATE = 4096


def tune(seed: int, notes: int = 60) -> np.ndarray:
    pitch = np.random.default_rng(seed).integers(45, 80, notes)
    return np.sin(np.repeat(440 * 2 ** ((pitch - 69) / 12) * (2 * np.pi / RATE), 512).cumsum())


def test_a_code_depends_on_its_own_frames_only():
    frames = chroma(tune(1), RATE)
    assert np.allclose(frames.sum(axis=1), 1)
    whole = codes(frames)
    assert all(codes(frames[t : t + 16])[0] == whole[t] for t in range(0, len(whole), 7))
    assert (whole >= 0).all() and (whole < 2**32).all()


def test_shifted_and_noisy_recordings_align(spark):
    base, noise = tune(2), np.random.default_rng(0).normal(0, 0.01, 60 * 512)
    rows = [(1, base.tolist()), (2, base[8 * HOP :].tolist()), (3, (base + noise).tolist()), (4, tune(3).tolist()), (5, None), (6, []), (7, [0.0] * 40_000), (None, base.tolist()), (4, [])]
    prints = fingerprints(spark.createDataFrame(rows, "media_id long, samples array<double>"), "media_id", "samples", RATE)
    found = {r.media_id: r for r in align(prints, "media_id").collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7}
    assert (found[2].aligned_to, found[2].offset, found[2].bit_error) == (1, -8, 0)
    assert (found[3].aligned_to, found[3].offset) == (1, 0)
    assert all(found[i].aligned_to is None for i in (1, 4, 5, 6, 7)) and found[5].n_codes == found[6].n_codes == 0
    assert align(prints.limit(0), "media_id").count() == 0


def meets(a: list[int], b: list[int]) -> float | None:
    """By brute force: the share of differing bits at the offset of most shared landmarks; None without any."""
    votes = Counter(i - j for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2])
    if not votes:
        return None
    d = max(votes, key=lambda o: (votes[o], -abs(o), o))
    over = [(x ^ y).bit_count() for x, y in zip(a[max(d, 0) :], b[max(-d, 0) :], strict=False)]
    return sum(over) / (32 * len(over)) if len(over) >= 16 else None


def test_recordings_meet_whatever_smaller_ones_hold_their_pieces(spark):
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(0, 2**32, n).tolist()
    base, rough = new(64), new(64)
    rows = {i: new(20) + base[16 * i - 17 if i > 1 else 0 : 16 * i] + rough[16 * i - 17 if i > 1 else 0 : 16 * i] + new(20) for i in (1, 2, 3, 4)}  # medleys that hold every landmark
    rows |= {5: base, 9: [*base[:30], base[30] ^ 5, *base[31:]], 11: base, 12: base[3:] + new(4), 20: rough, 21: [c ^ (1 << i % 32) for i, c in enumerate(rough[:40])] + rough[40:]}
    rows |= {30 + i: new(10) + base[4 * i : 4 * i + 12] + new(10) for i in range(6)} | {50: [7] * 40, 51: [7] * 60, 52: base[:9]}
    found = {r.id: r for r in align(spark.createDataFrame(list(rows.items()), "id long, codes array<long>"), "id").collect()}
    assert (found[9].aligned_to, found[11].aligned_to, found[12].aligned_to, found[21].aligned_to, found[51].aligned_to) == (5, 5, 5, 20, 50)
    assert (found[11].bit_error, found[11].offset, found[11].votes, found[12].offset) == (0, 0, 63, -3)
    for i, r in found.items():
        near = [j for j in rows if j < i and (e := meets(rows[i], rows[j])) is not None and e < 0.2]
        assert (r.aligned_to is None) == (not near) and (r.aligned_to in near or not near)
        assert r.aligned_to is None or abs(meets(rows[i], rows[r.aligned_to]) - r.bit_error) < 1e-12


def test_codes_are_those_of_plain_sums():
    frames = chroma(tune(6, 12), RATE)
    for t, code in enumerate(codes(frames)):
        plain = 0
        for kind, p, h, w in filters():
            part = lambda a, b, c, d: sum(frames[t + i][j] for i in range(a, b) for j in range(c, d))
            if kind == 0:
                x, y = part(0, w, p, p + h), part(0, w, 0, p) + part(0, w, p + h, 12)
            elif kind == 1:
                x, y = part(0, w, p, p + h), part(WIDTH - w, WIDTH, p, p + h)
            elif kind == 2:
                x, y = part(0, w, p, p + h // 2), part(0, w, p + h // 2, p + h)
            else:
                m = (WIDTH - w) // 2
                x, y = 2 * part(m, m + w, p, p + h), part(0, m, p, p + h) + part(WIDTH - m, WIDTH, p, p + h)
            ratio = np.log1p(x) - np.log1p(y)
            assert min(abs(ratio - e) for e in (-STEP, 0, STEP)) > 1e-9
            plain = plain * 4 + {0: 0, 1: 1, 2: 3, 3: 2}[sum(ratio > e for e in (-STEP, 0, STEP))]
        assert plain == code


def test_any_rate_and_any_length():
    """At 44,100 samples a second a tune gives much the same codes, and a long recording the codes of its parts."""
    pitch = np.repeat(np.random.default_rng(8).integers(50, 75, 24), 3)
    at = lambda rate: np.sin(np.repeat(440 * 2 ** ((pitch - 69) / 12) * (2 * np.pi / rate), rate // 8).cumsum())
    low, high = codes(chroma(at(4096), 4096)), codes(chroma(at(44_100), 44_100))
    n = min(len(low), len(high))
    apart = lambda x, y: np.mean([int(a ^ b).bit_count() for a, b in zip(x, y, strict=True)])
    assert apart(low[:n], high[:n]) < 0.6 * apart(low[:n], high[:n][::-1])
    long = np.tile(at(4096), 60)
    whole = chroma(long, 4096)
    assert np.allclose(whole[3000:3100], chroma(long[3000 * HOP : 3099 * HOP + 1024], 4096))


def test_search_against_all_pairs(spark):
    """Every query and every recording, whose best offset of all is looked for by brute force: of pairs below an error
    of 0.1 nine in ten are found, what is found is right, and the best of them is given."""
    rng, rows = np.random.default_rng(1), []
    for i in range(60):
        base = tune(100 + i, 40)
        rows.append((10 * i, base))
        for j, noise in enumerate((0.05, 0.2, 0.4)):
            rows.append((10 * i + 1 + j, (base + rng.normal(0, noise, len(base)))[(j * 3 * HOP) :]))
    rows += [(990, rows[0][1]), (991, rows[0][1]), (992, np.zeros(9000)), (993, np.zeros(12_000)), (994, None)]
    prints = spark.createDataFrame([(i, *map(np.ndarray.tolist, codes_and_weak(chroma(x, RATE) if x is not None else np.zeros((0, 12)))), "x") for i, x in rows], "id long, codes array<long>, weak array<long>, other string")
    found = {r.id: r for r in search(prints, "id", F.col("id") % 2 == 0).collect()}
    own = {r.id: np.array(r.codes, np.uint64) for r in prints.collect()}
    assert set(found) == {i for i in own if i % 2 == 0}

    def errors(a, b):
        best = 1.0
        for d in range(-len(b) + 17, len(a) - 16):
            x, y = a[max(d, 0) :], b[max(-d, 0) :]
            n = min(len(x), len(y))
            best = min(best, np.bitwise_count(x[:n] ^ y[:n]).sum() / (32 * n))
        return best

    met = near = 0
    for i, r in found.items():
        if i % 10 == 0 and i < 600:
            sure = [j for j in own if j != i and j // 10 == i // 10 and errors(own[i], own[j]) < 0.1]
            near, met = near + len(sure), met + min(len(sure), r.n_aligned)
        assert r.aligned_to is None or r.bit_error >= errors(own[i], own[r.aligned_to]) - 1e-12
    assert near > 60 and met >= 0.9 * near
    assert (found[990].aligned_to, found[990].bit_error, found[0].aligned_to) == (0, 0, 990)
    assert (found[992].aligned_to, found[994].aligned_to, found[994].n_codes) == (993, None, 0)
    assert search(prints.limit(0), "id", F.lit(True)).count() == 0
