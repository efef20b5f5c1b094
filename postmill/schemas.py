"""Table and payload schemas."""

from pyspark.sql import types as T

SCHEMA_VERSION = 3

POSTING = T.StructType(
    [T.StructField("seq", T.LongType(), False)]
    + [
        T.StructField(name, T.StringType())
        for name in (
            "url", "title", "company", "description",
            "location", "work_model", "posted_date", "source",
        )
    ]
)

SCORED = T.ArrayType(
    T.StructType([T.StructField("major", T.StringType()), T.StructField("score", T.IntegerType())])
)

JOBS_V1 = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("job_url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("majors", T.StringType()),
        T.StructField("date_found", T.TimestampType()),
        T.StructField("posted_to_discord", T.IntegerType()),
        T.StructField("discord_channel_ids", T.StringType()),
    ]
)

# Columns added after version 1, with the value an existing row gets.
JOBS_ADDED = [
    (T.StructField("fingerprint", T.StringType()), None),
    (T.StructField("source", T.StringType()), None),
    (T.StructField("location", T.StringType()), None),
    (T.StructField("work_model", T.StringType()), None),
    (T.StructField("posted_date", T.StringType()), None),
    (T.StructField("post_attempts", T.IntegerType()), 0),
    (T.StructField("last_error", T.StringType()), None),
    (T.StructField("last_attempt_at", T.TimestampType()), None),
    (T.StructField("normalized_url", T.StringType()), None),
]

JOBS = T.StructType(JOBS_V1.fields + [field for field, _ in JOBS_ADDED])

RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("fetched", T.LongType()),
        T.StructField("deduped", T.LongType()),
        T.StructField("new_jobs", T.LongType()),
        T.StructField("posted", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

# Landed payload bodies. `_corrupt_record` is filled by PERMISSIVE parsing.
GREENHOUSE_BODY = (
    "jobs array<struct<title:string, absolute_url:string, company_name:string,"
    " content:string, location:struct<name:string>>>, _corrupt_record string"
)
LEVER_BODY = (
    "array<struct<text:string, hostedUrl:string, descriptionPlain:string,"
    " categories:struct<commitment:string, location:string, workplaceType:string>>>"
)
ADZUNA_BODY = (
    "results array<struct<redirect_url:string, title:string, description:string,"
    " company:struct<display_name:string>,"
    " location:struct<display_name:string, area:array<string>>>>, _corrupt_record string"
)
