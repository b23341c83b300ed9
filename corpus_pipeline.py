"""A training corpus from the documents table, in five stages; each is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colorjobs.llm.common import cut, drop
from colorjobs.llm.decontaminate import stage_decontaminate
from colorjobs.llm.mixing import stage_mix
from colorjobs.llm.quality import stage_quality
from colorjobs.llm.simhash import stage_near_dedup
from colorjobs.llm.tokens import stage_tokens
from colorjobs.sources.shared import keep, scratch

STAGES = [
    ("quality classifier", stage_quality),
    ("SimHash near-dedup", stage_near_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("mixing sources to target weights", stage_mix),
    ("token-ID output", stage_tokens),
]
#: Votes, fingerprints and token ids have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other. What a stage writes on its way goes with it, its result with the next stage's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            after = keep(cut(stage(spark, docs, sf_dir), "stage"))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
