"""From raw documents to token ids: toxic texts go, one document of each near-duplicate class stays, personal data is
masked, sources are mixed to their targets, and texts become piece ids.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept. ``run`` writes each
result as Parquet to the shared folder of the session and reads it as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import jaccard, mixing, pieces, pii, toxicity
from formloom.llm.common import table
from formloom.session import kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the cut; the model learns from the labels of the training documents."""
    rows, score = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return rows.filter(F.col(score) < toxicity.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are alike in 0.8 of their five-word shingles or more."""
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, and the ids of the text."""
    return pieces.encoded(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
    ("pieces", encode),
]

#: A trained model and token ids can't be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
