"""From raw documents to token ids: language ID, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null texts
have no language and go in the first stage, so later stages meet none unless they are called by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import language_id as languages
from rasterloom.llm import mixing as mixes
from rasterloom.llm import ngram_join, pii, sentencepiece_viterbi
from rasterloom.llm.common import materialize, table
from rasterloom.llm.queries import PIECE_MODEL


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: what is rejected are null texts and texts without any, the only ones that are `und`.

    A short text, or one in a script that no labelled document has, counts to the language nearest to it and stays.
    Without any labelled document there is nothing to judge by, and all documents with a text stay.
    """
    model = languages.fit(docs)
    if not model["langs"]:
        return docs.where(F.col("text").isNotNull())
    judged = languages.identify(docs, model)
    return judged.where(F.col("lang_pred") != languages.UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more connect: the one with the least id."""
    return ngram_join.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to equal weights: a document appears as often as its draw says, in a global shuffle."""
    return mixes.mix(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return sentencepiece_viterbi.encode(docs, PIECE_MODEL)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL can't state the filters, the join's components or the segmentation; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
