"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last
returns the columns of ``documents``.  A run writes each stage's rows as Parquet in the
shared folder and reads them again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ondula.llm import common
from ondula.llm import op1_pareto_mix, op2_bin_completion, op3_host_rules, op5_line_runs, op7_count_rtree

STAGES = [
    ("quality rules", op3_host_rules.stage),
    ("line dedup", op5_line_runs.stage),
    ("n-gram Jaccard join", op7_count_rtree.stage),
    ("mixing sources", op1_pareto_mix.stage),
    ("best-fit packing", op2_bin_completion.stage),
]

#: SQL cannot express the packing; tests hold each stage against brute force on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
