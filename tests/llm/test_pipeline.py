"""The corpus pipeline's stages against plain versions, on rows with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tidelake.llm import toxicity
from tidelake.llm.queries import toxicity_model, vocabulary
from tidelake.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, key string, id long, component_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    deal = random.Random(11)
    word = lambda: "".join(deal.choice("aeioubcdfgl") for _ in range(deal.randrange(3, 8)))
    texts = [" ".join(word() for _ in range(deal.randrange(12, 60))) for _ in range(120)]
    rows = []
    for i, t in enumerate(texts):
        toxic = i % 5 == 0
        rows.append((i, t + (" vilebad horrid vilebad" if toxic else ""), "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None))
    rows += [(200 + i, "  ".join(texts[i + 1].split()), "en", "s1") for i in range(0, 40, 5)]  # equal but for blanks
    rows += [(300 + i, texts[i + 2] + " tail", "de", "s0") for i in range(0, 100, 10)]  # near copies
    rows += [(400, None, "en", "s0"), (401, "", "en", "s0"), (402, " \t\n", None, None), (None, texts[3], "en", "s2"), (None, "only here and nowhere else at all", "en", "s2"), rows[7], rows[7], (403, "long " * 30_000, "en", "s3")]
    whole = [(*r, 1, True, "x", "y", 2, 3) for r in rows]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(whole, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, folder), "test-stage")
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")

    before, after = seen["toxicity"]
    model = toxicity_model(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))
    scores = toxicity.probabilities(model, [r.text for r in before])
    assert sorted(map(str, after)) == sorted(str(r) for r, p in zip(before, scores, strict=True) if p < 0.5 or not r.text)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone & set(range(0, 120, 5))) >= 15 and len(gone - set(range(0, 120, 5))) <= 6 and {400, 401, None} <= {r.doc_id for r in after}

    before, after = seen["exact dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    best = lambda g: min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert sorted(map(str, after)) == sorted(str(best(g)) for g in groups.values())

    before, after = seen["n-gram Jaccard join"]
    label = brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r.doc_id is None or label[r.doc_id][1] == r.doc_id)

    before, after = seen["mixing sources to target weights"]
    assert set(map(str, after)) <= set(map(str, before)) and 0 < len(after) < len(before)

    before, after = seen["packing"]
    encode, pieces = Encoder(*vocabulary()).encode, defaultdict(int)
    for p in after:
        pieces[p.doc_id] += p.length
    assert pieces == {r.doc_id: len(encode(r.text or "")) + 1 for r in before}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run_gives_the_pieces_of_the_last_stage(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.where("length <= 0 or length > 1024").count() == 0 < found.count()
