"""Where iterative operators write what cuts their lineage."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Has checkpoint() write to the folder that spark.checkpoint.dir names; one on this machine serves a local master
    only, for elsewhere other executors would not see it."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or "/tmp/tabulon-checkpoints")
