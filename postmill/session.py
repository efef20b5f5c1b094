"""Session helpers."""

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Larger methods are never compiled by the JVM; Spark then splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
CHECKPOINT_DIR = "spark.checkpoint.dir"
SCRATCH_DIR = "postmill.scratch.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("postmill")
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        **extra,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` as the cluster
    names it, else what the caller has set as `postmill.scratch.dir`."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(SCRATCH_DIR, None)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_DIR}, or {SCRATCH_DIR} on this session, to a folder all executors share")
    return folder


def use_scratch(spark: SparkSession, folder: str) -> SparkSession:
    """Name the scratch folder of a session for which no cluster has named one."""
    if not spark.conf.get(CHECKPOINT_DIR, None) and not spark.conf.get(SCRATCH_DIR, None):
        spark.conf.set(SCRATCH_DIR, folder)
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a not yet existing table in the shared folder."""
    return f"{shared_dir(spark)}/postmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    Cuts lineage, survives lost executors, and unlike an RDD checkpoint runs
    the plan once and keeps column pruning and filter pushdown for readers.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation: Spark knows its size, so joins
    broadcast it by the usual size check instead of shuffling the big side."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns)).select(
        *[F.col(part.split()[0]).cast(part.split()[1]) for part in schema.split(", ")]
    )

