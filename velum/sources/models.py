"""Model tables that are stored as they are looked up: bucketed and sorted tables, and checked packed artefacts.

A neighbour model is asked by its source: stored in buckets of the source, a join with anything in the same buckets moves no row, and the
lookup of a few sources reads only their buckets. A sparse index is stored as compressed rows in blocks with digests and
checked as a whole before it is used.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

col = F.col


def bucketed(df: DataFrame, table: str, key: str, *order: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """``df`` as table ``table`` in ``buckets`` of ``key``, sorted by key and ``order`` within each; at ``path``, or in the warehouse.

    Rows are dealt by the bucket's own hash before they are written, so every bucket is one file.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def lookup(table: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """The rows of some keys of a bucketed table; only their buckets are read."""
    return table.where(col(key).isin(ids))


def met(model: DataFrame, asked: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join of two tables in the same buckets of ``key``; the hint keeps either from being sent to all executors, so nothing is exchanged."""
    return asked.join(model.hint("merge"), key, how)


class ModelError(ValueError):
    """A stored model that can't be used; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


PACKED = "block long, first long, rows long, offsets array<long>, ids array<long>, weights array<double>, digest string"


def _digest(first: int, rows: int, offsets, ids, weights) -> str:
    h = hashlib.sha256(f"{first} {rows} ".encode())
    for x, kind in ((offsets, "<i8"), (ids, "<i8"), (weights, "<f8")):
        h.update(np.ascontiguousarray(np.asarray(x), kind).tobytes())
    return h.hexdigest()


def pack(entries: DataFrame, path: str, rows: int, columns: int, block: int = 4096) -> dict:
    """Stores ``row, column, weight`` as compressed rows in blocks of ``block`` rows, and a manifest; returns the manifest.

    Rows without entries are empty, blocks without entries aren't written. A row or column outside the shape and a repeated place are
    refused while packing.
    """

    def run(t: pa.Table) -> pa.Table:
        row, column, weight = (t[c].to_numpy() for c in ("row", "column", "weight"))
        by = np.lexsort((column, row))
        row, column, weight = row[by], column[by], weight[by]
        if len(row) and (row[0] < 0 or row[-1] >= rows or column.min() < 0 or column.max() >= columns):
            raise ModelError("outside_shape")
        if ((row[1:] == row[:-1]) & (column[1:] == column[:-1])).any():
            raise ModelError("repeated_place")
        at = int(row[0]) // block
        many = min(block, rows - at * block)
        offsets = np.searchsorted(row, np.arange(at * block, at * block + many + 1))
        cells = [at, at * block, many, offsets, column, weight, _digest(at * block, many, offsets, column, weight)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.string()]
        return pa.Table.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

    blocks = entries.select(col("row").cast("long"), col("column").cast("long"), col("weight").cast("double")).groupBy(F.floor(col("row") / block).alias("__block")).applyInArrow(run, PACKED)
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    spark = entries.sparkSession
    manifest = {"rows": rows, "columns": columns, "block": block} | _summary(spark.read.parquet(f"{path}/blocks"))
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def _summary(blocks: DataFrame) -> dict:
    """Numbers of blocks and entries, and a digest of the blocks' digests that doesn't depend on their order."""
    sums = [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(8)]
    r = blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("entries"), *sums).first()
    return {"blocks": r.blocks, "entries": r.entries, "digest": hashlib.sha256(" ".join(str(int(r[f"s{i}"] or 0)) for i in range(8)).encode()).hexdigest()}


def unpack(spark: SparkSession, path: str) -> DataFrame:
    """``row, column, weight`` of a packed index, after its checks; a damaged one is refused with the reason.

    Every block is checked where it is read: its digest, its offsets, its place in the shape, repeated columns of a row. The manifest
    must agree with the number of blocks and entries and with all digests.
    """
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        blocks = spark.read.schema(PACKED).parquet(f"{path}/blocks")
    except Exception as e:
        raise ModelError("unreadable", str(e)[:200]) from e
    rows, columns, size = (manifest.get(k) for k in ("rows", "columns", "block"))
    if not all(isinstance(x, int) and x >= 0 for x in (rows, columns, size)):
        raise ModelError("bad_manifest")

    def verdict(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fault(r) for r in b.to_pylist()], pa.string())], ["fault"])

    def fault(r) -> str | None:
        offsets, ids, weights = (np.asarray(r[c] if r[c] is not None else []) for c in ("offsets", "ids", "weights"))
        if r["first"] != r["block"] * size or not 0 <= r["first"] < rows or r["rows"] != min(size, rows - r["first"]) or len(offsets) != r["rows"] + 1:
            return "bad_shape"
        if offsets[0] != 0 or offsets[-1] != len(ids) or (np.diff(offsets) < 0).any() or len(ids) != len(weights):
            return "bad_offsets"
        if len(ids) and (ids.min() < 0 or ids.max() >= columns):
            return "bad_column"
        inner = np.ones(max(len(ids) - 1, 0), bool)
        inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(ids))] - 1] = False
        if (np.diff(ids)[inner] <= 0).any():
            return "repeated_or_unsorted_column"
        if not np.isfinite(weights).all():
            return "bad_weight"
        return None if _digest(r["first"], r["rows"], offsets, ids, weights) == r["digest"] else "bad_digest"

    found = blocks.mapInArrow(verdict, "fault string").where("fault is not null").groupBy("fault").count().orderBy("fault").first()
    if found:
        raise ModelError(found.fault, f"{found['count']} blocks")
    if blocks.groupBy("block").count().where("count > 1").limit(1).count():
        raise ModelError("repeated_block")
    if {k: manifest.get(k) for k in ("blocks", "entries", "digest")} != _summary(blocks):
        raise ModelError("not_as_in_manifest")

    def spread(batches):
        for b in batches:
            for r in range(b.num_rows):
                first, offsets, ids, weights = b.column(0)[r].as_py(), b.column(1)[r].values.to_numpy(), b.column(2)[r].values, b.column(3)[r].values
                row = pa.array(np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets)))
                for a in range(0, len(row), 50_000):
                    yield pa.RecordBatch.from_arrays([x.slice(a, 50_000) for x in (row, ids, weights)], ["row", "column", "weight"])

    return blocks.select("first", "offsets", "ids", "weights").mapInArrow(spread, "row long, column long, weight double")
