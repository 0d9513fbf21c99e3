"""The corpus pipeline: five stages, each an operator of tallyward.llm over all that the stage before kept.

Every stage takes (spark, docs, sf_dir). What one returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import language, nearcopies, packing, secretscan, toxicity
from tallyward.llm.common import drop, stored, table
from tallyward.llm.queries import TOXIC_FROM, language_model, toxicity_model

#: Documents whose language is this uncertain go, as those without any do. Clean text of a few words scores above 0.5.
LEAST_LANGUAGE_SCORE = 0.2
_OWN = "__pipeline_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts and texts without letters go."""
    told = language.predict(docs, language_model(docs), keep=docs.columns, prefix=_OWN)
    return told.filter((F.col(f"{_OWN}lang_pred") != language.UNKNOWN) & (F.col(f"{_OWN}lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under TOXIC_FROM."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns, prefix=_OWN).filter(F.col(f"{_OWN}toxicity") < TOXIC_FROM).select(*docs.columns)


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return nearcopies.deduplicated(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked and n_chars set anew where that changed a text."""
    return secretscan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language id", language_id), ("toxicity", not_toxic), ("near copies", near_copies_once), ("secret scan", secrets_masked), ("packing", packed)]
#: Models, hashing and a tokenizer: SQL expresses none of the stages; tests/llm/test_pipeline.py checks each.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
