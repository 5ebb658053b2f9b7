"""Lineage cuts and range partitions that later steps can rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: ``spark.checkpoint.dir`` where it is set.

    A session without it gets a folder of its own in local mode, where driver
    and workers share a disk, and an error on a cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_ranges(df: DataFrame, order: list, part: str = "_part") -> DataFrame:
    """Rows range-partitioned by ``order`` and written, with their partition's number.

    Written, because several uses of the table must see the same rows in the
    same partitions, whatever adaptive execution or a lost executor does.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumns({part: F.spark_partition_id(), "_nth": F.monotonically_increasing_id() % (1 << 33)}))
