"""Block amplitudes over a stream of samples: tumbling event-time windows behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_block_rms(samples: DataFrame, entity: str, ts: str, value: str, block: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(entity, block_start, n, rms); a block is final once the watermark has passed its end."""
    timed = samples.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    by = timed.groupBy(F.window("__ts", block).alias("w"), entity).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return by.select(entity, F.col("w.start").alias("block_start"), "n", "rms")
