"""A corpus from raw documents to a mixture, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. The last stage returns the mixture: one
row for each time a document is drawn.

Defined cases, as the operators state them: a null or empty text fails the quality rules and goes; a
null id is smaller than any other, and rows that share an id are one document for near_dedup and
documents of their own elsewhere; an empty table gives an empty mixture; other columns, whatever their
names, pass through all stages but the last as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import decontamination, host_rules, minhash, mixing, templates
from quillmill.llm.common import forget, forget_since, made, scratch, table

#: Percent of their shingles that near copies share at least in near_dedup; op10 itself takes 85.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.without_templates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_unique(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL can't express the line templates; tests/llm checks near_dedup and decontaminate by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        mark = made()
        docs = scratch(stage(spark, docs, sf_dir), name)
        forget_since(mark, docs)  # a stage's own tables, and then its input, are read no more
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
