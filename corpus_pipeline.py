"""Documents to packed training sequences: quality rules, line dedup, near dedup, decontamination, packing.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of ``docs``, whatever else they hold and however it is called. An empty table stays empty. A null
text counts as an empty one: the quality rules take it out, every other stage carries it on. Null ids stay;
rows that repeat are rows of their own until near dedup, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from reviewlake.llm.common import table
from reviewlake.sources.folders import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The trees learn from labelled rows of this stage's input.

    Without labels, or without rows that have one, only the base rules judge.
    """
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines frequent at a source go from its documents; every document stays, with its new length.

    Rows without a source are one source. A text whose lines all go is empty; a null text stays null.
    """
    done = line_dedup.dedup_documents(docs, site_col="source")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8), the one of least id.

    Documents without words are in no group and all stay.
    """
    return near_dedup.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go. Without benchmark items all stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids. A document without text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL: str | None = None  # trees, hashing and packing have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; what a stage kept is a table for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
