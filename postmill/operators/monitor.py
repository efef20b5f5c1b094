"""Monitoring aggregates over the jobs and runs tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import default_if_empty, text_or_empty
from postmill.session import local_table

RECENT = 50
STATUSES = [0, 1, 2]


def source_counts(jobs: DataFrame) -> DataFrame:
    return (
        jobs.groupBy(default_if_empty(F.col("source"), "unknown").alias("source"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source")
    )


def major_counts(jobs: DataFrame) -> DataFrame:
    """Counts per label of a comma list; blanks trimmed, empty ones skipped."""
    label = F.explode(F.split(text_or_empty(F.col("majors")), ","))
    return (
        jobs.select(label.alias("item"))
        .select(F.trim("item").alias("major"))
        .where("major <> ''")
        .groupBy("major")
        .agg(F.count("*").alias("n"))
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    """Counts per status; 0, 1 and 2 always appear, other values if present."""
    counted = jobs.groupBy(F.col("posted_to_discord").cast("int").alias("status")).agg(F.count("*").alias("n"))
    base = local_table(jobs.sparkSession, [(s, 0) for s in STATUSES], "status int, n bigint")
    return counted.unionByName(base).groupBy("status").agg(F.sum("n").alias("n"))


def recent(jobs: DataFrame, limit: int = RECENT) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_last("date_found"), F.desc("id")).limit(limit)


def last_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def summary(jobs: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The five tables of the monitoring page."""
    return {
        "recent_jobs": recent(jobs),
        "source_counts": source_counts(jobs),
        "major_counts": major_counts(jobs),
        "last_run": last_run(runs),
        "status_counts": status_counts(jobs),
    }


def stats_json(jobs: DataFrame, runs: DataFrame, recent_since: Column) -> DataFrame:
    """One JSON document. The jobs are read and counted once, by (part, name);
    the maps in it have one entry per source, label and status.
    `recent_job_count`: jobs found at `recent_since` or later."""

    def entry(part: str, name: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), name.alias("name"))

    labels = F.filter(F.transform(F.split(text_or_empty(F.col("majors")), ","), lambda m: F.trim(m)), lambda m: m != "")
    entries = F.concat(
        F.array(
            entry("source_counts", default_if_empty(F.col("source"), "unknown")),
            entry("status_counts", F.col("posted_to_discord").cast("int").cast("string")),
            entry("recent_job_count", F.when(F.col("date_found") >= recent_since, "")),
        ),
        F.transform(labels, lambda m: entry("major_counts", m)),
    )
    counted = jobs.select(F.explode(entries).alias("e")).where("e.name IS NOT NULL").groupBy("e.part", "e.name").agg(F.count("*").alias("n"))
    always = [("status_counts", str(s), 0) for s in STATUSES] + [("recent_job_count", "", 0)]
    base = local_table(jobs.sparkSession, always, "part string, name string, n bigint")
    counts = counted.unionByName(base).groupBy("part", "name").agg(F.sum("n").alias("n"))

    def as_map(part: str) -> Column:
        mine = F.collect_list(F.when(F.col("part") == part, F.struct("name", "n")))
        return F.map_from_entries(F.array_sort(mine)).alias(part)

    maps = counts.agg(
        *[as_map(part) for part in ("source_counts", "major_counts", "status_counts")],
        F.max(F.when(F.col("part") == "recent_job_count", F.col("n"))).alias("recent_job_count"),
    )
    last = last_run(runs).agg(F.first(F.struct(*runs.columns)).alias("last_run"))
    rows = maps.unionByName(last, allowMissingColumns=True)
    names = ["source_counts", "major_counts", "status_counts", "last_run", "recent_job_count"]
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names]).select(
        F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("stats")
    )


def fetch_counts(postings: DataFrame) -> DataFrame:
    """Postings per source and in total (source null), in one pass."""
    return postings.rollup("source").agg(F.count("*").alias("n"))


def source_name():
    """Catalog entry -> the source text its postings carry."""
    return (
        F.when(F.col("platform").isin("Greenhouse", "Lever"), F.concat_ws("/", "platform", "key"))
        .when(F.col("platform") == "GitHub", F.col("key"))
        .otherwise(F.col("platform"))
    )


def source_health(catalog: DataFrame, postings: DataFrame) -> DataFrame:
    """Catalog sources with their posting count and whether they are silent.

    Postings are counted per source before they meet the small catalog."""
    counted = postings.groupBy("source").agg(F.count("*").alias("n"))
    names = catalog.select("platform", source_name().alias("source")).distinct()
    return names.join(counted, "source", "left").select(
        "platform", "source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("silent")
    )


def pass_status(jobs: DataFrame) -> DataFrame:
    """Retried, posted and abandoned jobs in one pass over the table."""
    return jobs.agg(
        F.count_if((F.col("posted_to_discord") == 1)).alias("posted"),
        F.count_if((F.col("posted_to_discord") == 0) & (F.col("post_attempts") > 0)).alias("retrying"),
        F.count_if((F.col("posted_to_discord") == 2)).alias("abandoned"),
    )
