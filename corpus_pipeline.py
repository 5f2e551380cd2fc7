"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet to the shared folder and read again as the next stage's docs. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinledger.llm.common import discard, scratch, table, written
from kinledger.llm.decontaminate import stage_decontaminate
from kinledger.llm.linechunks import stage_line_chunks
from kinledger.llm.minhash import stage_near_duplicates
from kinledger.llm.mixing import stage_mixing
from kinledger.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_chunks),
    ("near_dedup", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mixing),
]

#: A trained classifier and MinHash are among the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the last one's rows, doc_id with the words the mix takes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", outlives=True)
        if before is not None:
            discard(spark, before)
        before = docs
    return docs
