"""Where intermediate tables go, and how they are written and dropped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a new local one only where that is unset and Spark runs in one process (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="velum-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: short lineage, no recomputation when executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/velum-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._velum_path = path
    if _made:
        _made[-1].append(out)
    return out


#: Tables that each of the running calls of :func:`settle` has made.
_made: list[list[DataFrame]] = []


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns and delete all tables that were made on the way to it."""
    _made.append([])
    try:
        out = cut(make())
    except BaseException:
        drop(*_made.pop())
        raise
    drop(*(df for df in _made.pop() if df is not out))
    if _made:
        _made[-1].append(out)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in frames:
        path = df.__dict__.pop("_velum_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch; texts are long, and a batch stands in the JVM and in a Python worker at once.
BATCH_ROWS = 2_000


BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> str:
    """Bound the rows of the session's Arrow batches; returns the setting that held before."""
    before = spark.conf.get(BATCHES)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(BATCHES, str(BATCH_ROWS))
    return before


def query(run: Callable, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    """``run`` over the named tables of a folder, as a registered query: its result is written, what it made on the way is deleted and the session's settings are as before."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = small_batches(spark)
        try:
            return settle(lambda: run(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names)))
        finally:
            spark.conf.set(BATCHES, before)

    return call
