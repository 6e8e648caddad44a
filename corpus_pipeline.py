"""A corpus from documents to token ids: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage takes what its predecessor kept, as written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.llm.bpe import SMALL_CACHE, token_ids
from stemma.llm.common import materialize, table
from stemma.llm.decontaminate import drop_contaminated
from stemma.llm.near import keep_one
from stemma.llm.secrets import mask_secrets
from stemma.llm.toxicity import fit_toxicity, keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text."""
    return mask_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids."""
    return token_ids(docs, cache_words=SMALL_CACHE)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The classifier, the hashes and the recursion on words have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
