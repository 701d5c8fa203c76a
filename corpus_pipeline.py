"""The corpus pipeline: quality rules, near and substring duplicates, secrets, packing.

Each stage takes the documents that its predecessor kept, written as Parquet and read again. A stage's
own scratch tables go when the next one begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import common, line_quality, minhash_dedup, secret_scan, sos_packing, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(apply: Callable[[DataFrame], DataFrame]) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
        common.ship(spark)
        common.clear_scratch("pipeline")
        with common.scratch_of("pipeline"):
            return apply(docs)

    return run_stage


#: Quality: boilerplate lines and rejected documents go. Near duplicates: shingles of five words,
#: similarity 0.8, one document of each group stays. Substrings: passages of 20 words that stand earlier
#: go. Secrets: live ones are masked. Packing: pieces of windows of 4096 tokens.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(line_quality.without_boilerplate)),
    ("minhash_near_dedup", _stage(minhash_dedup.without_near_duplicates)),
    ("substring_dedup", _stage(substring_dedup.without_repeats)),
    ("secret_scans", _stage(secret_scan.redact)),
    ("packing", _stage(sos_packing.sos_pack)),
]

#: Tokens and passages aren't SQL's; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; all but the last are written to the shared folder."""
    docs, run_id, last = common.table(spark, sf_dir, "documents"), uuid.uuid4().hex, None
    for name, stage in STAGES[:-1]:
        with common.scratch_of(f"{run_id} {name}"):
            docs = common.materialize(stage(spark, docs, sf_dir))
        if last:  # a stage's table goes when the next one's is written
            common.clear_scratch(f"{run_id} {last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
