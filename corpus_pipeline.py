"""A training-data pipeline of five stages over the documents table.

Each stage works on all rows that its predecessor kept and reads its input from Parquet; all but the last return the
columns of documents. Defined cases are those of the stages' operators; tables without rows pass through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.llm import op3_ngram_jaccard, op6_sentencepiece, op7_toxicity, op8_mixing, op10_language
from maskflow.llm.common import materialize, read_table
from maskflow.llm.sampling import fold

#: Percent of the tokens that reach the mixing stage which it hands on.
MIX = op8_mixing.Mix(percent=80, epochs=1)
#: Two documents are near copies when they share 80 % of their five-word shingles.
COPY_RULE = {"n": 5, "percent": 80}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call toxic go; those without a word have no neighbours and stay."""
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = op7_toxicity.score(docs, op7_toxicity.fit(docs, labels), keep=True, prefix="_toxicity_")
    return scored.where("_toxicity_predicted = 0").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language, go."""
    predicted = op10_language.predict(docs, op10_language.fit(docs), keep=True, prefix="_language_")
    return predicted.where("not _language_rejected").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by n-gram overlap, directly or through others, the one with the smallest id stays; documents
    without words are copies of nothing, and of those equal in doc_id and text one stays."""
    return op3_ngram_jaccard.one_of_each(docs, op3_ngram_jaccard.ngram_jaccard(docs, **COPY_RULE))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the token budgets of the domain-language-source tree stay."""
    return op8_mixing.mix_documents(docs, MIX).select("_row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of ids, piece spans and decoded text."""
    return op6_sentencepiece.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_copies", near_copies), ("mixing", mixing), ("encoding", encoding)]
#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
