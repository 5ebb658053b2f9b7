"""Download and label streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from traitloom.operators.detections import parsed_labels

LOG_SCHEMA = "id long, ts timestamp, fullname string, host string, status string"


def label_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Detection rows of label files as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]*$", 1)
    return parsed_labels(lines.select(stem.alias("filename"), F.col("value").alias("text")), "filename", "text")


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def live_quota(log: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` successes of every taxon, in order of time within a micro-batch, then id.

    State per taxon is one counter.
    """

    def accept(key, frames: Iterator[pd.DataFrame], state: GroupState):
        taken = state.get[0] if state.exists else 0
        rows, free = pd.DataFrame(columns=["id", "fullname", "ts"]), max(0, cap - taken)
        for frame in frames:  # never more than a frame and what is still free
            rows = (pd.concat([rows, frame]) if len(rows) else frame).sort_values(["ts", "id"]).head(free)
        state.update((taken + len(rows),))
        yield rows[["id", "fullname", "ts"]]

    done = log.where("status = 'ok'").select("id", "fullname", "ts")
    return done.groupBy("fullname").applyInPandasWithState(accept, "id long, fullname string, ts timestamp", "taken long", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(log: DataFrame, most: int = 50) -> DataFrame:
    """Running strikes per host and whether it is banned."""
    return log.where("status <> 'ok'").groupBy("host").agg(F.count("*").alias("strikes")).withColumn("banned", F.col("strikes") > most)


def windowed_strikes(log: DataFrame, late: str = "1 hour", window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Strikes per host and event-time window; rows later than the watermark are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return log.where("status <> 'ok'").withWatermark("ts", late).groupBy(span, "host").agg(F.count("*").alias("strikes"))


def routed(log: DataFrame, path: str, checkpoint: str):
    """Write every micro-batch to one folder per status and batch; a batch that is retried replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch_id").parquet(path)

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (id, host) once within the watermark, for an exactly-once append."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "host"])


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Progress of each taxon's download sessions: rows, first and last time."""
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "fullname").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
