"""Binary files that tasks write to the shared folder, and their manifests.

A task writes under a temporary name that no other attempt uses. Its manifest
row goes through Spark's own commit, so the manifest names the files of exactly
one attempt of each task; what a lost attempt has left is never read.
"""

import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI (file, hdfs, s3, ...) or absolute path."""
    return fs.FileSystem.from_uri(uri)


def temporary_name(folder: str) -> str:
    return posixpath.join(folder, f"_tmp-{uuid.uuid4().hex}")


def publish(source: str, target: str) -> None:
    """Rename; a retried task finds its work done."""
    store, old = filesystem(source)
    _, new = filesystem(target)
    if store.get_file_info(old).type != fs.FileType.NotFound:
        store.move(old, new)
    elif store.get_file_info(new).type == fs.FileType.NotFound:
        raise FileNotFoundError(source)


def range_bounds(rows: DataFrame, target: int) -> list[int]:
    """Lower ends of consecutive key ranges of about `target` weight each, but the first.

    `rows`: (key bigint, weight bigint), keys not null. The bounds follow from
    the rows alone, not from their order or partitions. Only histograms of
    `BINS` bins come to the driver; bins above the target are split again, down
    to single keys.
    """
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    if ends["low"] is None:
        return []

    def bins(low: int, high: int) -> list[tuple[int, int]]:
        width = max(1, -(-(high - low + 1) // BINS))
        # In decimals: the difference of two longs can be larger than a long.
        number = F.floor((F.col("key").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        inside = rows.where(F.col("key").between(low, high))
        counted = inside.groupBy(number.cast("bigint").alias("bin")).agg(F.sum("weight").alias("weight")).collect()
        found = []
        for row in sorted(counted, key=lambda r: r["bin"]):
            start = low + row["bin"] * width
            if row["weight"] > target and width > 1:
                found += bins(start, min(start + width - 1, high))
            else:
                found.append((start, row["weight"]))
        return found

    bounds, held = [], 0
    for start, weight in bins(ends["low"], ends["high"]):
        if held and held + weight > target:
            bounds.append(start)
            held = 0
        held += weight
    return bounds


def shard_numbers(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Number of the range that each key is in; null is in the first."""
    known = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return np.searchsorted(bounds, known, side="right").astype(np.int32)


def with_shards(rows: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """`rows` with the column `shard`."""
    cuts = np.array(bounds, dtype=np.int64)
    where = rows.columns.index(key)

    def number(batches):
        for batch in batches:
            shards = pa.array(shard_numbers(batch.column(where), cuts))
            yield pa.RecordBatch.from_arrays([*batch.columns, shards], names=[*batch.schema.names, "shard"])

    return rows.mapInArrow(number, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))


def one_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows about files (one each), each in a partition of its own; `schema` starts with `number int`."""
    table = spark.createDataFrame(rows, schema)
    return table.repartitionById(max(1, len(rows)), F.col("number"))
