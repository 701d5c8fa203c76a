"""How inputs are dealt to tasks, and what tasks need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each core below which a scan has too few tasks: Spark cuts files no finer.
LEAST_SPLIT = 4 << 20
_ROOT = str(Path(__file__).resolve().parents[1])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input is so small that a task or two would read it all; larger inputs as they are.

    Texts are costly to work on and cheap to move at that size. Rows are the same either way.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    small = int(str(plan.optimizedPlan().stats().sizeInBytes())) < cores * LEAST_SPLIT
    return df.repartition(cores) if small and plan.toRdd().getNumPartitions() < 2 * cores else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
