"""Compression-distance classification: held-out accuracy, odd inputs."""

from __future__ import annotations

import math
import random

import zstandard
from pyspark.sql import functions as F

from tests.twins import TESTDATA
from tidelake.llm import toxicity
from tidelake.llm.queries import op4_compression_toxicity


def test_held_out_rows_are_ranked_well(spark):
    sf_dir = str(TESTDATA / "sf0.1")
    scored = op4_compression_toxicity(spark, sf_dir)
    found = scored.where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("toxic", "score").collect()
    yes, no = [r.score for r in found if r.toxic == 1], [r.score for r in found if r.toxic == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in yes for b in no)
    assert wins / (len(yes) * len(no)) > 0.93
    assert sum(s >= 0.5 for s in no) < 0.03 * len(no)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_odd_rows_get_scores_and_columns_stay(spark):
    words = ["".join(chr(97 + (i * j) % 26) for j in range(3, 9)) for i in range(60)]
    docs = [(i, " ".join(words[(i * k) % 60] for k in range(1, 30)) + (" vilebad horrid " * 3 if i % 4 == 0 else ""), "x") for i in range(80)]
    table = spark.createDataFrame([*docs, (None, None, "y"), (500, "", None), (501, "word " * 50_000, "z"), (0, docs[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model, score_col="how_toxic").collect()
    assert len(rows) == 84 and all(0 <= r.how_toxic <= 1 for r in rows)
    assert {r.score for r in rows} == {"x", "y", "z", None}
    by_id = {r.doc_id: r.how_toxic for r in rows}
    assert min(by_id[i] for i in range(0, 80, 4)) > max(by_id[i] for i in range(80) if i % 4)


def test_a_missing_class_gives_the_prior_and_an_empty_table_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).first().score < 0.01
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(none, labels)).agg(F.count("score")).first()[0] == 1


def test_window_gains_are_those_of_plain_compression():
    """The figures of a text, from windows cut and compressed one by one with fresh compressors."""
    deal = random.Random(4)
    words = [f"{deal.choice('bcdfg')}a{deal.choice('lmnrst')}{deal.choice('eio')}{i % 7}" for i in range(200)]
    model = toxicity.fit_rows([" ".join(deal.choices(words, k=60)) + " vilebad horrid" for _ in range(60)], [" ".join(deal.choices(words, k=60)) for _ in range(120)], 0.3)

    def length(window: bytes, content: bytes) -> int:
        settings = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=2 * toxicity.WINDOW, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
        found = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=found, compression_params=settings).compress(window))

    for text in ["", "one", "A vilebad word " * 40, " ".join(deal.choices(words, k=300)), "x" * 5000, " ".join(deal.choices(words, k=50)) + " horrid vilebad é"]:
        parts, now = [], []
        for w in text.lower().encode().split():
            for piece in [w[i : i + toxicity.LONGEST] for i in range(0, len(w), toxicity.LONGEST)]:
                now.append(piece)
                if sum(len(x) + 1 for x in now) >= toxicity.WINDOW:
                    parts, now = [*parts, now], []
        gains = sorted((length(b" " + b" ".join(p) + b" ", model.ordinary) - length(b" " + b" ".join(p) + b" ", model.toxic) for p in [*parts, *([now] if now else [])]), reverse=True)
        want = (gains[0], sum(gains[:3]), sum(g > 2 for g in gains) / len(gains), math.log(len(gains))) if gains else (0, 0, 0, 0)
        assert toxicity.figures(model, text) == tuple(map(float, want))
