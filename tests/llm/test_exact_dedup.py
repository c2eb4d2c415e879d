"""Exact dedup against a plain dictionary, with heavy groups, ties, nulls and repeated rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tidelake.llm.exact_dedup import decide, deduplicate, misra_gries


@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_misra_gries_keeps_what_is_frequent(stream, counters):
    keys, counts = np.unique(np.array(stream, np.int64), return_counts=True)
    kept, left = misra_gries(keys, counts, counters)
    assert len(kept) <= counters
    known = dict(zip(kept.tolist(), left.tolist(), strict=True))
    for key, n in Counter(stream).items():
        assert n - len(stream) / (counters + 1) <= known.get(key, 0) <= n


def rows():
    out = [(i, "heavy  text" if i % 3 else f"text {i % 20}") for i in range(300)]
    return [*out, (1000, "heavytext"), (1001, None), (1002, ""), (1003, " \t\n"), (None, "text 3"), (5, "heavy  text"), (2000, "y" * 200_000), (2001, "y " * 200_000), (3, "text 3")]


def test_decisions_equal_a_dictionary(spark):
    data = rows()
    found = decide(spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, digest string, kept int"), phi=0.2, counters=10).collect()
    groups = defaultdict(list)
    for i, t in data:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[3], len(g)) for k, g in groups.items()}
    assert len(found) == len(data)
    assert all((r.keep_id, r.group_size) == want[r.digest.hex()] for r in found)
    kept = Counter(r.digest.hex() for r in found if r.kept)
    assert kept == Counter(want.keys()) and all(r.doc_id == r.keep_id for r in found if r.kept)


def test_deduplicate_keeps_one_row_of_each_group_and_its_columns(spark):
    data = [(i, t, n) for n, (i, t) in enumerate(rows())]
    table = spark.createDataFrame(data, "doc_id long, text string, group_size long")
    found = deduplicate(table, phi=0.2, counters=10)
    assert found.columns == table.columns
    keys = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in found.collect()]
    assert sorted(keys) == sorted({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t, _ in data})
    assert deduplicate(table.limit(0)).count() == 0
