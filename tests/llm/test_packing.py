"""Packing: every id comes back exactly once, in windows without gaps or padding."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.twins import TESTDATA
from tidelake.llm.packing import TIERS, pack
from tidelake.llm.queries import vocabulary
from tidelake.llm.tokens import Encoder


def held(pieces, rows):
    """Checks windows and the round trip of rows (id, text), whose ids are distinct."""
    exact = Tokenizer.from_file(vocabulary()[0])
    of, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
    for i, text in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(of[i], key=lambda p: p.start)
        assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == ids
        assert [p.start for p in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
        assert all(p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length > 0 for p in own)
    for window in windows.values():
        own = sorted(window, key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:n]) for n in range(len(own))]
        total = sum(p.length for p in own)
        assert total == own[0].sequence_length <= TIERS[-1] and total & (total - 1) == 0
    assert set(of) == {i for i, _ in rows}
    return windows


def test_every_document_comes_back(spark):
    docs = spark.read.parquet(str(TESTDATA / "sf0.01/documents.parquet"))
    pieces = pack(docs, *vocabulary()).collect()
    windows = held(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    steps = defaultdict(int)
    for w in windows.values():
        steps[w[0].step_group] += w[0].sequence_length
    last = {max(g for g in steps if g >> 40 == task) for task in {g >> 40 for g in steps}}
    assert all(15 * 1024 < t < 17 * 1024 or (g in last and t < 17 * 1024) for g, t in steps.items())


def test_odd_rows(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "word " * 100_000), (4, "<|endoftext|> is here"), (5, "\U0001f600 é\r\n\t x")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start long")
    held(pack(table, *vocabulary()).collect(), rows)
    assert pack(table.limit(0), *vocabulary()).count() == 0
    twice = pack(table.union(table), *vocabulary()).where("doc_id = 1").count()
    assert twice == 2


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "a" * 1_000_000, "x\t" + "\n \u3000" * 50_000 + "y", "ab1!" * 300_000])
def test_very_long_runs(text):
    both = Encoder(*vocabulary())
    assert np.array_equal(both.encode(text), both.exact.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["Hello, world's  end \n\n x", "1234567 ½ ²", "naïve café 中文字 العربية", "a b c", "'S 'LL don't"])
def test_both_tokenizers_agree(text):
    both = Encoder(*vocabulary())
    assert both.encode(text).tolist() == both.exact.encode(text, add_special_tokens=False).ids
