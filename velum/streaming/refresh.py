"""Optional incremental refresh of rating aggregates: sums that merge, kept up to date micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial(ratings: DataFrame, key: str) -> DataFrame:
    """Count, sum and sum of squares by key; partial results add up."""
    return ratings.groupBy(key).agg(F.count("*").alias("n"), F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q"))


def merged(parts: DataFrame, key: str) -> DataFrame:
    """Count, mean and population deviation from partial results."""
    by = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    return by.select(key, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def keep_partials(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's partial results under its number, so a repeated batch replaces its own and none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        partial(batch, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
