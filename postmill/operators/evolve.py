"""Additive schema evolution and versioned backfill of the jobs table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.keys import fingerprint
from postmill.functions.text import text_or_empty
from postmill.functions.urls import normalize_url
from postmill.schemas import JOBS, JOBS_ADDED, SCHEMA_VERSION


def evolve(df: DataFrame, added: list[tuple[T.StructField, object]] = JOBS_ADDED) -> DataFrame:
    """Adds the columns that are missing, with their defaults."""
    missing = [(f, v) for f, v in added if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(v).cast(f.dataType) for f, v in missing})


def backfill(df: DataFrame, from_version: int) -> tuple[DataFrame, int]:
    """Brings an evolved table to the current version.

    Below 2: null fingerprints are filled, without location. Below 3: null
    normalized URLs are filled and all fingerprints recomputed with location.
    At the current version nothing changes.
    """
    if from_version < 2:
        plain = fingerprint(F.col("company"), F.col("title"))
        df = df.withColumn("fingerprint", F.coalesce("fingerprint", plain))
    if from_version < 3:
        df = df.withColumns(
            {
                "normalized_url": F.coalesce("normalized_url", normalize_url(text_or_empty(F.col("job_url")))),
                "fingerprint": fingerprint(F.col("company"), F.col("title"), F.col("location")),
            }
        )
    return df, max(from_version, SCHEMA_VERSION)


def read_versions(spark: SparkSession, *folders: str) -> DataFrame:
    """JOBS rows, at the current version, of folders whose part files are of different versions.

    The current schema is given to the scan, so no footers are merged and files
    may lack any added column or have more. The version of a row shows in it:
    since version 3 every row has a normalized URL, so a row without one is older
    and gets what `backfill` gives it; others keep theirs. Added columns with a
    default have it in place of null. One scan, nothing is shuffled.
    """
    table = spark.read.schema(JOBS).parquet(*folders)
    older = F.col("normalized_url").isNull()
    current = fingerprint(F.col("company"), F.col("title"), F.col("location"))
    url = normalize_url(text_or_empty(F.col("job_url")))
    defaults = {f.name: F.coalesce(f.name, F.lit(v).cast(f.dataType)) for f, v in JOBS_ADDED if v is not None}
    return table.withColumns(
        defaults
        | {
            "fingerprint": F.when(older, current).otherwise(F.col("fingerprint")),
            "normalized_url": F.when(older, url).otherwise(F.col("normalized_url")),
        }
    )
