"""The corpus pipeline: documents through five stages of the training-data operators.

toxicity (toxic documents go), n-gram Jaccard join (one document of each class
stays), secret scans (spans become ``[secret]``), mixing to target weights (rows are
repeated or dropped by their rates), best-fit packing (a row per piece). Every stage
works on all that its predecessor kept; each result is written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import mixing, ngram_join, packing, queries, secrets, toxicity
from newsloom.llm.common import durable, scratch_path, table

#: SQL cannot express the stages (a trained machine first of all); tests hold what the
#: stages keep, cut and pack against plainer versions on a small fixture.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, rates, _ = mixing.fit(docs, table(spark, sf_dir, "labels"), queries.MIX)
    return mixing.apply_rates(docs, model, rates)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_path(), queries.CAPACITY)


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing_to_targets),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
