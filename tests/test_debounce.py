"""Batch debounce: against a plain loop, and without a key's events in one row."""

from __future__ import annotations

import random

from tidelake.streaming.debounce import windows


def plain(rows: list[tuple], length: int) -> set[tuple]:
    found = {}
    for kind in {k for k, _ in rows}:
        opened = None
        for t in sorted(t for k, t in rows if k == kind and t is not None):
            if opened is None or t >= opened + length:
                opened = t
            found[kind, opened] = found.get((kind, opened), 0) + 1
    return {(*k, n) for k, n in found.items()}


def test_windows_equal_a_plain_loop_and_hold_no_key_in_one_row(spark):
    rng = random.Random(5)
    rows = [("busy", rng.randrange(4_000)) for _ in range(3_000)] + [("busy", t) for t in range(9_000, 9_800, 10)] + [(None, rng.randrange(3_000)) for _ in range(40)] + [("exact", t) for t in (-20, -10, 0, 10, 10, 19, 20)] + [("none", None), ("exact", None)]
    events = spark.createDataFrame(rows, "kind string, at long")
    df = windows(events, "kind", "at", 10)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, 10)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert windows(events.limit(0), "kind", "at", 10).count() == 0
