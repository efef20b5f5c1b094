"""Places counted in ranges, and chunks made of them."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import classify
from postmill.operators.numbering import numbered
from postmill.session import materialize


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_equal_row_number(spark, parts):
    rng = random.Random(2)
    # One group holds most rows; ties, nulls in both, and rows that repeat.
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(40)]), rng.randrange(3)) for _ in range(3000)]
    df = materialize(spark.createDataFrame(rows, "`g.x` int, o int, v int").repartition(parts), "rows")
    got = numbered(df.withColumnRenamed("g.x", "g"), ["o", "v"], ("g",), "n").collect()
    want = df.select(
        F.col("`g.x`").alias("g"), "o", "v", F.row_number().over(Window.partitionBy("`g.x`").orderBy("o", "v")).alias("n")
    ).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_numbers_of_a_whole_table(spark):
    df = materialize(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5), "rows")
    assert all(r.k + 1 == r.row_number for r in numbered(df, ["k"]).collect())
    assert numbered(df.where("k < 0"), ["k"]).count() == 0


def test_chunks_do_not_depend_on_partitions(spark):
    seen = []
    for parts in (1, 6):
        df = spark.range(100).select(F.col("id").alias("seq"), F.lit("t").alias("title")).repartition(parts)
        chunks = classify.with_chunks(materialize(df, "rows"))
        seen.append(sorted((r["seq"], r["chunk_id"], r["index"]) for r in chunks.collect()))
    assert seen[0] == seen[1] == [(k, k // 15, k % 15) for k in range(100)]
