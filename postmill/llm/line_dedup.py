"""Line deduplication against levelled sorted runs of line hashes.

Runs are bucketed, sorted tables (key, n_docs, keeper) in the shared folder, all
with the same buckets, so that a batch is shuffled once and then merge-joined
with every run without moving the runs. A batch's keys that no run holds yet
(the anti-join) are first sightings and name their keeper; known ones only add
to the count. `fan_in` runs of a level are compacted into one of the next.

Batches go from the largest document ids to the smallest, so a key's first
sighting is in the largest document that holds it.

Defined results: null or empty text is one empty line; a document without id
passes unchanged; rows that repeat an id are one document when documents are
counted, and lose the same lines; an empty table gives no rows; other columns
are kept, whatever their names.
"""

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.text import BLANKS, in_row, lower_ascii
from postmill.session import materialize, new_folder

RUN = "key binary, n_docs bigint, keeper bigint"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """16 bytes; equal for equal keys and, but for chance of 2 to the -128, for no others."""
    return F.unhex(F.md5(key))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineRuns:
    """The runs seen so far, by level."""

    spark: SparkSession
    buckets: int
    fan_in: int = 3
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, "key").sortWithinPartitions("key")
            .write.format("parquet").option("path", new_folder(self.spark, "runs"))
            .bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        )
        return name

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._put(self._write(self._merged(old)), level + 1)
            for table in old:
                self.spark.sql(f"DROP TABLE {table}")

    def _merged(self, names: list[str]) -> DataFrame:
        rows = [self.spark.table(name) for name in names]
        if not rows:
            return self.spark.createDataFrame([], RUN)
        # Merge joins, not a union: Spark 4.1 may take a union of bucketed tables for
        # bucketed and then aggregates keys that lie in different partitions.
        merged = rows[0]
        for more in rows[1:]:
            right = more.select("key", F.col("n_docs").alias("n_more"), F.col("keeper").alias("k_more"))
            merged = merged.join(right.hint("merge"), "key", "full").select(
                "key",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))).alias("n_docs"),
                F.greatest("keeper", "k_more").alias("keeper"),
            )
        return merged

    def add(self, batch: DataFrame) -> None:
        """`batch`: (key, doc_id), once for each key of a document; ids below those of earlier batches."""
        rows = batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        rows = rows.repartition(self.buckets, "key").withColumn("known", F.lit(False))
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).select("key", F.lit(True).alias("held"))
            rows = rows.join(run.hint("merge"), "key", "left").select(
                "key", "n_docs", "keeper", (F.col("known") | F.col("held").isNotNull()).alias("known")
            )
        first_seen = F.when(~F.col("known"), F.col("keeper")).alias("keeper")
        self._put(self._write(rows.select("key", "n_docs", first_seen)), 0)

    def totals(self) -> DataFrame:
        """(key, n_docs, keeper) over all runs."""
        return self._merged([n for level in self.levels for n in level])

    def drop(self) -> None:
        """Forget the runs' names; their files stay until the shared folder is cleaned."""
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE {table}")
        self.levels = []


def document_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, key hash) once for each long enough key of a row."""
    keys = F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.length(k) >= least_chars)
    return docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.explode(F.transform(F.array_distinct(keys), key_hash)).alias("key")
    )


def repeated_keys(
    docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fan_in: int = 3
) -> DataFrame:
    """(doc_id, gone): the hashes of the keys that a document has to lose."""
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    cuts = set(docs.approxQuantile("doc_id", shares, 0.01)) if shares else set()
    # Batch 0 has the largest ids. The table holds no text, only hashes.
    batch = sum((F.when(F.col("doc_id") < F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    found = document_keys(docs, least_chars).withColumn("batch", batch)
    path = new_folder(spark, "line-keys")
    found.write.partitionBy("batch").parquet(path)
    found = spark.read.schema("doc_id bigint, key binary, batch int").parquet(path)
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    for k in range(len(cuts) + 1):
        runs.add(found.where(F.col("batch") == k).select("key", "doc_id").distinct())
    often = materialize(runs.totals().where(F.col("n_docs") >= least_docs).select("key", "keeper"), "often")
    runs.drop()
    lost = found.join(often, "key").where("doc_id <> keeper")
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, **how) -> DataFrame:
    """`docs` with the lines that stay as `text`, and the struct `line_dedup` (n_lines, n_dropped).

    Lines with a key of at least `least_chars` code points that is found in at
    least `least_docs` documents stay in the largest doc_id only. A column
    `line_dedup` of the input is replaced.
    """
    gone = repeated_keys(docs.select("doc_id", "text"), least_chars, least_docs, **how)
    rows = docs.select(in_row(docs, "line_dedup"), F.col("doc_id").alias("id"))
    gone = gone.withColumnRenamed("doc_id", "key_of")
    joined = rows.join(gone, F.col("id") == F.col("key_of"), "left")
    text = F.col("row").getField("text")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < least_chars) | ~F.array_contains("gone", key_hash(key))

    kept = F.when(F.col("gone").isNull(), lines(text)).otherwise(F.filter(lines(text), stays))
    counted = joined.select("row", "gone", kept.alias("kept"))
    sizes = F.struct(
        F.size(lines(text)).cast("bigint").alias("n_lines"),
        (F.size(lines(text)) - F.size("kept")).cast("bigint").alias("n_dropped"),
    )
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join("kept", "\n"))
    return counted.select(F.col("row").withField("text", left).alias("row"), sizes.alias("line_dedup")).select(
        "row.*", "line_dedup"
    )
