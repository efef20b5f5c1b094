"""Exact places in an order, counted in parts instead of one sorted task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import materialize


def numbered(rows: DataFrame, order: list[str], group: tuple[str, ...] = (), name: str = "row_number") -> DataFrame:
    """`rows` with their place (from 1) in `order`, per `group`; written once.

    Equals `row_number()`, but a group, or the whole table, is never sorted in one
    task: rows are dealt into ranges of (group, order), each range counts its
    groups, and the counts of the ranges before are added. Only groups that lie in
    several ranges get such an offset, so the joined table has at most a row per
    range and group border. Rows equal in group and order are told apart by their
    place in the input, which must be a stored table.
    """
    place, part, before = "__place__", "__part__", "__before__"
    ranged = (
        rows.withColumn(place, F.monotonically_increasing_id())
        .repartitionByRange(*group, *order, place)
        .sortWithinPartitions(*group, *order, place)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn(part, F.spark_partition_id())
    )
    ranged = materialize(ranged, "ranged")
    # Where each group starts in each range, and how many rows of it the ranges before hold.
    runs = ranged.groupBy(*group, part).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        runs.select(*group, part, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)), "offsets"
    )
    keys = [*group, part]
    joined = ranged.alias("r").join(offsets.alias("o"), [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    number = (F.col(place) - F.col("o.first") + F.col(f"o.{before}") + 1).alias(name)
    return joined.select(*[F.col(f"r.`{c}`") for c in rows.columns], number)
