"""The corpus pipeline: five stages over ``documents``, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm import common, decontaminate, line_dedup, packing, passage_dedup, queries, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have no votes; repeated rows go or stay alike; without labels to learn from, and in an empty
    table, nothing goes."""
    return toxicity.drop_toxic(docs, common.read_table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated runs of three lines, then of fifty words, are cut out; every document stays, n_chars follows its text.

    A null text stays null (n_chars null), a text of which nothing is left becomes empty; identical rows are one document."""
    lines = common.cut(line_dedup.line_dedup(docs))
    common.release(spark)
    out = passage_dedup.passage_dedup(lines)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest doc_id, null ids last.

    Null and empty texts are one group; repeated rows stay once; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and all their repeated rows.

    Null and empty texts and items match nothing; without a benchmark nothing goes."""
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences; columns are those of ``packing.pack``.

    A null or empty text is one id; repeated rows and null doc_ids are packed like others; no rows give no sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages learn, hash and tokenise, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the table ``documents``; each one's result is written before the next reads it."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
    return docs
