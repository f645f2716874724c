"""The corpus pipeline: quality rules, near duplicates, decontamination, secret
scans and mixing, in this order.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet in the shared folder and read again for the next; what a stage
has stored goes when its result is there. All but the
last return the columns of documents. The first two and the third drop
documents, the fourth masks secrets, the last samples documents by calibrated
probabilities and adds topic, n_tokens, weight and keep_prob. Empty tables give
empty results; nulls and repeated rows are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuewright.llm import decontaminate, mixing, neardup, quality, secrets
from cuewright.llm.common import scratch, stored

STAGES = [
    ("quality rules", quality.stage),
    ("n-gram jaccard join", neardup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("secret scans", secrets.stage),
    ("mixing to target weights", mixing.stage),
]


#: Hashed features, MinHash and raking aren't expressed in SQL; tests/llm/test_pipeline.py has them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept = made.pop()
            made += [last] if last else []  # the stage before, as this one's rows are written
        last = kept
    return docs
