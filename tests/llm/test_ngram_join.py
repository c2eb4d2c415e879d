"""The n-gram Jaccard join against all pairs, with frequent shingles forced by a low bound."""

from __future__ import annotations

import random

import pytest

from tidelake.llm.ngram_join import near_duplicates, one_of_each


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def documents(seed):
    deal = random.Random(seed)
    common = [f"c{deal.randrange(30)}" for _ in range(60)]  # a passage that most rows share
    rows = []
    for i in range(140):
        if i % 3 and rows:
            words = (deal.choice(rows)[1] or "x y").split()
            for _ in range(deal.randrange(6)):
                words[deal.randrange(len(words))] = f"n{deal.randrange(99)}"
        else:
            words = [f"w{deal.randrange(40)}" for _ in range(deal.randrange(1, 70))]
            words = words + common if i % 2 else words
        rows.append((i, " ".join(words)))
    return [*rows, (500, None), (501, " \t "), (502, "one"), (503, "ONE"), (504, "one two"), (505, "q " * 30_000)]


@pytest.mark.parametrize(("k", "percent", "frequent"), [(4, 85, 3), (5, 80, 32), (3, 80, 2)])
def test_components_equal_those_of_all_pairs(spark, k, percent, frequent):
    rows = documents(k)
    found = near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long"), k=k, percent=percent, frequent=frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, k, percent)


def test_odd_rows(spark):
    text = "a b c d e f g h i j"
    table = spark.createDataFrame([(3, text, "x"), (1, text, "y"), (None, text, "z"), (1, "other", "w")], "doc_id long, text string, component_id string")
    found = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(table).collect()}
    assert found == {(3, 6): 1, (1, 6): 1, (None, 6): None, (1, 1): 1}
    left = one_of_each(table)
    assert left.columns == table.columns and {r.component_id for r in left.collect()} == {"y", "z", "w"}
    assert near_duplicates(table.limit(0)).count() == 0
