"""The corpus pipeline: documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeflow.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from fringeflow.llm.common import discard, materialise, table

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]
#: Quality cutoffs, components and token ids can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    Each stage's documents are written to the shared folder and read as the next one's, and removed once that has written its own; those of the last but one
    stay, as the result still reads them. Null and empty texts, repeated rows, ties and clashing columns are each stage's to handle, as its docstring says; an
    empty table gives no pieces.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
