"""Requests over the limit per client and window; one function for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def over_limit(events: DataFrame, limit: int = 100, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """user_id, window_start and requests of every client and window with more than ``limit`` requests.

    On a stream, counts wait for the watermark and go out once.
    """
    df = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    df = df.withWatermark("ts", late) if events.isStreaming else df
    per = df.groupBy("user_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("requests"))
    return per.filter(F.col("requests") > limit).select("user_id", F.col("window.start").alias("window_start"), "requests")


def load_increment(batch: DataFrame, batch_id: int, target: str, keys: list[str], seq: str) -> None:
    """For ``foreachBatch``: adds the batch's last row per key as a version of its own, safe to repeat.

    A batch writes the folder of its number only, so a repeated batch writes the same again
    and nothing written before is touched; ``loaded`` merges the versions.
    """
    from quire.operators.etl import last_wins

    last_wins(batch, keys, seq).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def loaded(spark: SparkSession, target: str, keys: list[str], seq: str) -> DataFrame:
    """The target's rows: per key that of the greatest ``seq``, then of the latest batch."""
    rows = spark.read.parquet(target)
    order = F.struct(F.col(seq), F.col("batch"))
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
