"""A corpus pipeline out of the operators of ``tabforge.llm``: each stage's output is written as Parquet
and read again as the documents of the next.

``STAGES`` names the stages; each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabforge.llm import stages
from tabforge.llm.common import stash, table

STAGES = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.line_dedup),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("mixing sources to target weights", stages.mix),
    ("best-fit packing", stages.pack),
]

#: The stages fit a classifier and run iterative graph and packing steps, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs
