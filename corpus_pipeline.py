"""From raw documents to packed sequences, one written table after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casestream.llm.common import drop_staged, stage, staged
from casestream.llm.line_dedup import line_dedup_stage
from casestream.llm.mixing import mixing_stage
from casestream.llm.near_dup import near_duplicate_stage
from casestream.llm.packing import packing_stage
from casestream.llm.quality_classifier import classifier_stage

STAGES = [
    ("quality classifier", classifier_stage),
    ("line dedup", line_dedup_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier, fuzzy lines and the tokenizer have no SQL form; tests/llm/test_cases.py holds each stage, on what
#: its predecessor kept, against a brute-force version, the classifier against its operator's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; every stage but the last is written as Parquet and read again.
    A stage's own tables, and its input, go when its output is written; the last stage's stay for the caller."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with staged() as made:
            docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(spark, [*made[:-1], *held])
        held = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
