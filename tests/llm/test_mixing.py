"""Raking meets its marginals; sampling is whole, deterministic and copes with odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm.mixing import calibrated, rake, sample

def columns():
    return {"source": F.col("source"), "lang": F.col("lang")}


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(s, la, 10 + 7 * i * j) for i, s in enumerate("abc") for j, la in enumerate("xyz")], "s string, l string, tokens long")
    want = {"s": {"a": 0.5, "b": 0.3, "c": 0.2}, "l": {"x": 0.1, "y": 0.6, "z": 0.3}}
    rows = rake(cells, {c: spark.createDataFrame(list(t.items()), f"{c} string, target double") for c, t in want.items()}).collect()
    for c, targets in want.items():
        for value, target in targets.items():
            assert sum(r.weight for r in rows if r[c] == value) == pytest.approx(target, abs=1e-4)


def test_odd_rows(spark):
    rows = [(i, "a" if i % 3 else "b", "x" if i % 2 else None, 10 + i) for i in range(400)] + [(900, None, None, None), (901, "a", "x", 0), (None, "b", "x", 5), (3, "a", "x", 13)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, lang string, n long, mix_probability double")
    powers = {"source": 0.5, "lang": 1.0}
    found = calibrated(docs, columns(), F.col("n"), powers).collect()
    assert len(found) == len(rows) and all(0 <= r[-1] <= 1 for r in found) and max(r[-1] for r in found) == pytest.approx(1)
    assert {r.mix_probability for r in found} == {0.5}
    assert all(r[-1] == 0 for r in found if not r.n)
    one, two = (sample(docs, columns(), F.col("n"), powers, F.col("doc_id")) for _ in range(2))
    assert one.columns == docs.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert calibrated(docs.limit(0), columns(), F.col("n"), powers).count() == 0


def test_one_rare_source_does_not_decide_what_share_is_kept(spark):
    rows = [(i, f"s{i % 20}" if i % 3 else "s0", "x" if i % 2 else "y", 100_000) for i in range(3000)]
    powers = {"source": 0.5, "lang": 1.0}
    for more in ([], [(9000, "mispelt", "x", 3), (9001, None, None, 1)]):
        docs = spark.createDataFrame(rows + more, "doc_id long, source string, lang string, n long")
        found = calibrated(docs, columns(), F.col("n"), powers, sweeps=5, share=0.4).collect()
        assert all(0 <= r.mix_probability <= 1 for r in found)
        assert sum(r.n * r.mix_probability for r in found) == pytest.approx(0.4 * sum(r.n for r in found), rel=1e-6)
        assert all(r.mix_probability == 1 for r in found if r.doc_id == 9000)
    kept = sample(docs, columns(), F.col("n"), powers, F.col("doc_id"), sweeps=5, share=0.4).count()
    assert 1000 < kept < 1400
    assert {r.mix_probability for r in calibrated(docs, columns(), F.col("n"), powers, sweeps=5, share=1.0).collect()} == {1.0}
    assert calibrated(docs.limit(0), columns(), F.col("n"), powers, sweeps=5, share=0.4).count() == 0


def test_the_pipeline_keeps_its_stated_share_beside_a_rare_source(spark):
    rows = [(i, "words of a document " * 40, "en", f"s{i % 4}") for i in range(2000)] + [(9000, "lost", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.mixed(spark, docs, "").count() == pytest.approx(corpus_pipeline.MIX_SHARE * 2000, rel=0.1)
