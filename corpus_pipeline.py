"""The corpus pipeline: five stages, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes every stage's result into the shared folder and reads it again for the next stage, so that no stage
computes another's work anew and a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import exact_dedup, mixing, ngram_join, packing, queries, toxicity
from tidelake.llm.common import free_name, staged, table

#: Share of its input's tokens that the mixing stage keeps, whatever rare values the marginals have.
MIX_SHARE = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is at least 0.5 go; the model is learnt from labelled rows of the stage's own input
    outside the held-out fold. Null and empty texts stay."""
    score = free_name(docs, "toxicity_score")
    model = queries.toxicity_model(spark, sf_dir, docs)
    return toxicity.score(docs, model, score_col=score).where((F.col(score) < 0.5) | (F.coalesce("text", F.lit("")) == "")).select(docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the most code points, then the smallest id. Null and blank
    texts are equal to each other. Of rows that repeat in id and text one stays, by the hash of its other columns."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of at least 80 % of their five-word shingles join, the one with the smallest id stays. Texts
    without words have no links and stay, as do rows with a null id; rows that share an id stay or go together."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of MIX_SHARE of the tokens by the probabilities that rake sources, languages and topics to their targets.
    Null sources and languages are values of their own, a null id is one key, texts without words go."""
    return mixing.sample(docs, queries.mix_columns(), queries.mix_tokens(), queries.MIX_POWERS, F.col("doc_id"), share=MIX_SHARE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; ids are left in digest form. Null and empty texts are the end token alone, null
    ids and repeated rows documents of their own."""
    pieces = packing.pack(docs, *queries.vocabulary())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. An empty table gives none; columns that documents has besides are carried to the last stage,
    whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: A trained classifier and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
