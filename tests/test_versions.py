"""Part files of mixed versions; duplicates within a watermark."""

import datetime

from pyspark.sql import functions as F

from postmill.operators import evolve
from postmill.schemas import JOBS, JOBS_V1, POSTING
from postmill.session import new_folder
from postmill.streaming import ingest


def test_part_files_of_all_versions_in_one_folder(spark):
    folder = new_folder(spark, "versions")
    day = datetime.datetime(2024, 1, 1)

    def rows(first, *last):
        return spark.createDataFrame([(first, f"https://www.e.org/{first}/", "Plant Intern", "Vale, Inc.", "civil", day, 0, "")], JOBS_V1).withColumns(
            dict(last)
        ).coalesce(1)

    rows(1).write.parquet(folder)
    rows(2, ("fingerprint", F.lit("stale|print")), ("location", F.lit("Reno, Nevada"))).write.mode("append").parquet(folder)
    third = evolve.evolve(rows(3)).withColumns({"normalized_url": F.lit(""), "fingerprint": F.lit("own"), "post_attempts": F.lit(2)})
    third.select(*JOBS.names).write.mode("append").parquet(folder)
    third.withColumns({"id": F.lit(4).cast("bigint"), "later": F.lit("x")}).write.mode("append").parquet(folder)
    table = evolve.read_versions(spark, folder)
    assert table.columns == JOBS.names
    got = [tuple(r) for r in table.select("id", "fingerprint", "normalized_url", "post_attempts").orderBy("id").collect()]
    assert got == [
        (1, "vale|intern-plant|", "https://e.org/1", 0), (2, "vale|intern-plant|reno-nv", "https://e.org/2", 0),
        (3, "own", "", 2), (4, "own", "", 2),
    ]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert evolve.read_versions(spark, folder).where("false").count() == 0


def test_repeats_within_the_watermark_go(spark):
    landed, table, offsets = (new_folder(spark, name) for name in ("landed", "within", "offsets"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSTING.fields) + ", ts timestamp"

    def land(day, *names):
        posts = [(0, f"https://www.e.org/{n}/?utm_source=x{day}" if n else None, *[""] * 7, datetime.datetime(2024, 1, day)) for n in names]
        spark.createDataFrame(posts, kinds).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(kinds).parquet(landed)
        ingest.first_seen_within(stream, "ts", "3 days", table, offsets).awaitTermination()
        return {(r[0], r[1]) for r in spark.read.parquet(table).select("normalized_url", F.day("ts")).collect()}

    url = "https://e.org/{}".format
    first = land(1, "a", "a", "b", None, None)
    assert first == {(url("a"), 1), (url("b"), 1), ("", 1)}
    assert land(2, "a", "c") - first == {(url("c"), 2)}
    second = land(9, "d")
    assert (url("d"), 9) in second
    # The watermark has passed the first `a`; `d` is still known; a late posting goes.
    assert land(10, "a", "d") - second == {(url("a"), 10)}
    assert (url("e"), 3) not in land(3, "e")
    total = spark.read.parquet(table).count()
    assert total == len(spark.read.parquet(table).select("normalized_url", "ts").distinct().collect())
