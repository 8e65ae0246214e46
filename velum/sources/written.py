"""Intermediate results that are written once: short lineage, one computation, recovery from the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint under ``spark.checkpoint.dir``: rows, their order within partitions, and the partitions stay as they are.

    A folder of its own is made only where the setting is missing and Spark runs in one process (tests); a cluster without one is refused.
    """
    _ready(df)
    return df.checkpoint()


def _ready(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(place or "file://" + tempfile.mkdtemp(prefix="velum-"))


def shared_dir(df: DataFrame) -> str:
    """The folder of checkpoints, set if need be as in :func:`written`."""
    _ready(df)
    return df.sparkSession.sparkContext.getCheckpointDir()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, in directories by the columns ``by``, so that a filter on them reads only its files."""
    path = f"{shared_dir(df)}/velum-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
