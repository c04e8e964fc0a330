"""A training-corpus pipeline: five stages, each one operator of chronosieve.llm.

Every stage takes (spark, docs, sf_dir) and gives documents with the columns of
`documents`; the last one gives digests of the token ids. Stage by stage, nulls,
empty and very long texts, ties and repeated rows are handled as the operators'
docstrings say; an empty table passes through as an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronosieve.llm import exact_dedup, mixing, ngram_join, tokenize, toxicity
from chronosieve.llm.common import checkpointed, load


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from the labelled documents of this input."""
    return toxicity.clean(docs, toxicity.learnt(docs, load(spark, sf_dir, "labels")))


def exact_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles, the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, shingle=5, percent=80)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def texts_are_encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return tokenize.tokenized(docs, tokenize.Codec.from_file(tokenize.default_model()))


STAGES = [
    ("toxicity", toxic_documents_go),
    ("exact_dedup", exact_copies_go),
    ("ngram_join", near_copies_go),
    ("mixing", sources_are_mixed),
    ("sentencepiece", texts_are_encoded),
]
#: SQL can express neither the scores nor the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage gives is written before the next one reads it, more than once."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
