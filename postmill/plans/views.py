"""Feed-shaped views derived from the sample tables."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.dims import TAXONOMY

# One keyword of each label.
TERMS = [keywords[1] for keywords in TAXONOMY.values()]


# Parts of `postings.seq`, from the least significant one.
COPY_BITS, LINE_BITS = 8, 3
# A supplier's postings, whose number doesn't grow with the tables, land in so many documents.
BODIES = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(table: DataFrame) -> DataFrame:
    """The sample tables are single files; adaptive execution sizes the partitions."""
    return table.hint("rebalance")


def feed(spark: SparkSession, sf_dir: str, lines: Column | None = None) -> DataFrame:
    """POSTING rows from lineitem, part, supplier and nation, and `supplier`; of the given `lines` only.

    `seq` packs order, line, and the number of the row among those with the same
    order and line, of which there are few. The rows of lineitem are dealt out by that
    key, so one exchange of narrow rows does for the number too, and stays where no
    one asks for `seq`. Descriptions name one term of one label of the taxonomy and
    differ in length.
    """
    line = F.col("l_linenumber")
    copy = F.row_number().over(
        Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    )
    items = read(spark, sf_dir, "lineitem")
    rows = (
        (items if lines is None else items.where(lines))
        .hint("rebalance", "l_orderkey", "l_linenumber")
        .withColumn("copy", copy - 1)
        .withColumn("copy", F.when(F.col("copy") < 1 << COPY_BITS, F.col("copy")).otherwise(F.raise_error(F.lit("too many copies"))))
        .join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    term = F.get(F.array(*map(F.lit, TERMS)), ((F.col("l_partkey") + line) % len(TERMS)).cast("int"))
    kind = F.when(line % 3 == 0, "Internship (Summer 2026)").when(
        line % 3 == 1, "Co-Op [Remote]"
    ).otherwise(F.concat(F.lit("Intern - JR-"), (F.lit(10000) + F.col("l_partkey")).cast("string")))
    suffix = F.when(F.col("l_returnflag") == "N", "").otherwise(
        F.concat(F.lit(" & "), F.lower("p_type"))
    )
    return rows.select(
        F.expr(
            f"(l_orderkey * {1 << LINE_BITS} + l_linenumber) * {1 << COPY_BITS} + copy"
        ).alias("seq"),
        F.concat(
            F.lit("HTTPS://WWW.Jobs.example.com/ad/"), F.col("l_partkey").cast("string"),
            F.lit("/?utm_source=feed&v="), line.cast("string"),
            F.lit("&se="), F.col("l_orderkey").cast("string"),
        ).alias("url"),
        F.when(line == 7, "Engineering Intern")
        .otherwise(F.concat(F.col("p_name"), suffix, F.lit(" Engineering "), kind))
        .alias("title"),
        F.when(line % 4 == 0, F.concat(F.col("s_name"), F.lit(", Inc.")))
        .when(line % 4 == 1, F.concat(F.lit("The "), F.col("s_name"), F.lit(" Company")))
        .when(line % 4 == 2, F.concat(F.col("s_name"), F.lit(" Labs, LLC")))
        .otherwise(F.concat(F.lit("Café "), F.col("s_name")))
        .alias("company"),
        F.concat(
            F.concat_ws(" ", "p_name", "p_brand", "l_returnflag", term),
            F.repeat(F.lit(" on site"), F.col("l_quantity").cast("int")),
        ).alias("description"),
        F.when(line % 4 == 0, "Dallas, Texas")
        .when(line % 4 == 1, "Dallas, TX")
        .when(line % 4 == 2, F.concat(F.lit("Remote - "), F.col("n_name")))
        .otherwise("")
        .alias("location"),
        F.when(F.col("l_returnflag") == "A", "Hybrid")
        .when(F.col("l_returnflag") == "R", "On Site")
        .otherwise("")
        .alias("work_model"),
        F.lit("").alias("posted_date"),
        F.when(line % 3 == 0, F.concat(F.lit("Greenhouse/s"), F.col("l_suppkey").cast("string")))
        .when(line % 3 == 1, "org/repo")
        .otherwise("Adzuna")
        .alias("source"),
        F.col("l_suppkey").alias("supplier"),
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """POSTING rows. They are dealt out as rows of lineitem, before they get wide."""
    return feed(spark, sf_dir).drop("supplier")


def order_of():
    """The order number packed in `postings.seq`."""
    return F.shiftright("seq", COPY_BITS + LINE_BITS)


def is_history():
    """The twentieth part of `postings` that stands for stored history."""
    return order_of() % 20 == 0


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOBS rows from orders."""
    key = F.col("o_orderkey")
    channel = F.lit("1002")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.lit("https://jobs.example.com/o/"), key.cast("string")).alias("job_url"),
        F.concat(F.lit("Role "), F.col("o_orderpriority")).alias("title"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("company"),
        F.when(key % 4 == 0, "mechanical,civil")
        .when(key % 4 == 1, " MIS , computer science,")
        .when(key % 4 == 2, "")
        .otherwise("mechanical,unknown,CIS")
        .alias("majors"),
        F.col("o_orderdate").alias("date_found"),
        F.when(F.col("o_orderstatus") == "O", 0)
        .when(F.col("o_orderstatus") == "F", 1)
        .otherwise(2)
        .alias("posted_to_discord"),
        F.when(key % 3 == 0, channel).otherwise("").alias("discord_channel_ids"),
        F.when(key % 5 == 0, F.lit(None).cast("string"))
        .when(key % 5 == 1, "")
        .when(key % 5 == 2, "Adzuna")
        .when(key % 5 == 3, "org/repo")
        .otherwise("Lever/acme")
        .alias("source"),
        F.when(key % 6 == 0, F.lit(None).cast("string")).otherwise("Reno, NV").alias("location"),
        F.lit("").alias("work_model"),
        F.lit("3d").alias("posted_date"),
        (F.col("o_custkey") % 7).cast("int").alias("post_attempts"),
        F.lit(None).cast("string").alias("last_error"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUNS rows: one per day of events; every fifth never finished."""
    day = F.to_date("ts")
    number = F.datediff(F.col("day"), F.lit("2024-01-01").cast("date")).cast("bigint")
    kinds = {"fetched": "view", "deduped": "click", "new_jobs": "signup", "posted": "purchase", "errors": "error"}
    counted = (
        read(spark, sf_dir, "events")
        .groupBy(day.alias("day"))
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_ts"),
            *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()],
        )
    )
    open_run = number % 5 == 0
    return counted.select(
        number.alias("id"),
        "started_at",
        F.when(~open_run, F.col("last_ts")).alias("finished_at"),
        *kinds,
        F.when(open_run, "running").when(number % 7 == 3, "error").otherwise("ok").alias("status"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ATTEMPT rows: one per (job, label) of a pass, from events.

    A job is a user, a label an event type; a label fails when the user ever
    had an event of that type with a value under 0.5.
    """
    label = (
        F.when(F.col("event_type") == "view", "mechanical")
        .when(F.col("event_type") == "click", "civil")
        .when(F.col("event_type") == "signup", "MIS")
        .when(F.col("event_type") == "purchase", "CIS")
        .otherwise("computer science")
    )
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("job"), label.alias("major"))
        .agg((F.min("value") >= 0.5).alias("ok"), F.max("ts").alias("ts"))
        .select(
            F.concat(F.lit("https://jobs.example.com/o/"), F.col("job").cast("string")).alias("job_url"),
            "major", "ok", "ts",
        )
    )


def line_of():
    """The line number packed in `postings.seq`."""
    return F.shiftright("seq", COPY_BITS) % (1 << LINE_BITS)


def body_of():
    """Number of the document a posting lands in; unique for all suppliers that fit 33 bits."""
    return F.col("supplier") * BODIES + F.floor(order_of() / 500) % BODIES


def _packed(rows: DataFrame, slug, item, head: str, tail: str) -> DataFrame:
    """Landed JSON bodies of bounded size, items in order of `seq`.

    Items become JSON before they are collected, in compiled code, so that rows of one text each are
    sorted and moved. The number comes first in the key, so that rows sort by it without a look at the slug.
    """
    items = rows.select("seq", F.to_json(item).alias("item"), body_of().alias("doc_ord"), slug.alias("slug"))
    listed = F.sort_array(F.collect_list(F.struct("seq", "item")))
    return (
        items.groupBy("doc_ord", "slug")
        .agg(F.array_join(listed["item"], ",").alias("items"))
        .select("slug", "doc_ord", F.concat(F.lit(head), "items", F.lit(tail)).alias("body"))
    )


def greenhouse_raw(posts: DataFrame) -> DataFrame:
    item = F.struct(
        "title", F.col("url").alias("absolute_url"),
        F.when(line_of() == 3, "").otherwise(F.col("company")).alias("company_name"),
        F.concat(F.lit("<p>"), F.col("description"), F.lit(" &amp; more</p>")).alias("content"),
        F.struct(F.col("location").alias("name")).alias("location"),
    )
    slug = F.concat(F.lit("s"), F.col("supplier").cast("string"))
    return _packed(posts, slug, item, '{"jobs":[', "]}")


def lever_raw(posts: DataFrame) -> DataFrame:
    commitment = F.when(F.col("work_model") == "Hybrid", "Internship").when(
        F.col("work_model") == "On Site", "co-op"
    ).otherwise("Full-time")
    item = F.struct(
        F.regexp_replace("title", "Co-Op|Intern", "Analyst").alias("text"),
        F.col("url").alias("hostedUrl"), F.col("description").alias("descriptionPlain"),
        F.struct(
            commitment.alias("commitment"), "location", F.col("work_model").alias("workplaceType")
        ).alias("categories"),
    )
    slug = F.concat(F.lit("s"), F.col("supplier").cast("string"), F.lit("-labs"))
    return _packed(posts, slug, item, "[", "]")


def adzuna_raw(posts: DataFrame) -> DataFrame:
    def levels(*names):
        return F.array(*[F.lit(n) for n in names])

    area = (
        F.when(line_of() == 2, levels("US", "Texas", "Dallas County", "Dallas"))
        .when(line_of() == 5, levels("US", "New York", "New York", "Brooklyn", "Kings County"))
        .otherwise(levels("US"))
    )
    item = F.struct(
        F.col("url").alias("redirect_url"), "title", "description",
        F.struct(F.col("company").alias("display_name")).alias("company"),
        F.struct(F.lit("United States").alias("display_name"), area.alias("area")).alias("location"),
    )
    return _packed(posts, F.lit("term"), item, '{"results":[', "]}")


def payloads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw rows of all five kinds; postings go to the JSON kind that their source names.

    The source follows from the line, so each kind reads its own lines only.
    """
    third = F.col("l_linenumber") % 3
    return {
        "greenhouse": greenhouse_raw(feed(spark, sf_dir, third == 0)),
        "lever": lever_raw(feed(spark, sf_dir, third == 1)),
        "adzuna": adzuna_raw(feed(spark, sf_dir, third.isNull() | ~third.isin(0, 1))),
        "markdown": readme_docs(spark, sf_dir, True),
        "html": readme_docs(spark, sf_dir, False),
    }


def readme_docs(spark: SparkSession, sf_dir: str, markdown: bool) -> DataFrame:
    """Tables rendered from part: one document per brand and 500 part numbers,
    sorted by name, with the mark for a repeated company."""
    part = dealt(read(spark, sf_dir, "part"))
    chunk = F.expr("p_partkey div 500")
    entry = F.struct("p_name", "p_partkey", "p_type", "p_size")
    grouped = part.groupBy("p_brand", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))

    def cell(row, i):
        above = F.get(F.col("rows"), i - 1)["p_name"]
        repeated = (i > 0) & (above == row["p_name"])
        key = row["p_partkey"].cast("string")
        size = row["p_size"].cast("string")
        if markdown:
            own = F.concat(F.lit("**["), row["p_name"], F.lit("](https://c.example.com)**"))
            return F.concat(
                F.lit("| "), F.when(repeated, "↳").otherwise(own), F.lit(" | ["), row["p_type"],
                F.lit(" Intern](https://jobs.example.com/p/"), key, F.lit(") | Reno, NV | Hybrid | "), size, F.lit("d |"),
            )
        own = F.concat(F.lit("<b>"), row["p_name"], F.lit(" &amp; Sons</b>"))
        return F.concat(
            F.lit("<tr><td>"), F.when(repeated, "↳").otherwise(own), F.lit("</td><td>"), row["p_type"],
            F.lit(" Intern</td>\n<td>Reno,&nbsp;NV</td><td><a href=\"https://jobs.example.com/p/"), key,
            F.lit("\">Apply</a></td><td>"), size, F.lit("d</td></tr>"),
        )

    lines = F.array_join(F.transform("rows", cell), "\n")
    if markdown:
        head = F.lit("# List\n| Company | Title | Location | Model | Date |\n|---|---|---|---|---|\n")
        text = F.concat(head, lines)
    else:
        text = F.concat(F.lit("<table><thead><tr><th>x</th></tr></thead><tbody>\n"), lines, F.lit("\n</tbody></table>"))
    name = F.concat(F.col("p_brand"), F.lit("/"), F.col("chunk").cast("string"))
    return grouped.select(name.alias("name"), F.expr("bigint(substring_index(p_brand, '#', -1)) * bigint(134217728) + chunk").alias("doc_ord"), text.alias("text"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 15 parts as postings to be scored."""
    return read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 15").alias("chunk_id"), F.expr("int(p_partkey % 15)").alias("index"),
        F.col("p_name").alias("title"), F.expr("repeat(concat(p_type, ' '), 3 * p_size)").alias("description"), "p_partkey", "p_size", "p_type",
    )


def responses(asked: DataFrame) -> DataFrame:
    """Scored answers with gaps, misplaced and repeated indices, bad labels."""
    size = F.col("p_size")
    gap = (size % 10 == 0) | ((F.col("chunk_id") % 7 == 0) & (F.col("index") % 3 != 0))

    def entry(major, score):
        return F.struct(major.alias("major"), score.cast("int").alias("score"))

    first = F.array(
        entry(F.lit("civil"), F.lit(3)), entry(F.lit("unknown"), F.lit(4)),
        entry(F.when(F.col("p_type") == "PROMO", "MIS").otherwise("mechanical"), size % 7),
    )
    second = F.array(entry(F.lit("chemical"), F.lit(5)))
    answers = F.when(size % 10 == 2, F.array(first, second)).otherwise(F.array(first))
    return asked.where(~gap).select(
        "chunk_id", F.when(size % 10 == 1, F.col("index") + 100).otherwise(F.col("index")).alias("index"),
        F.posexplode(answers).alias("n", "majors"), F.col("p_partkey"),
    ).select("chunk_id", "index", (F.col("p_partkey") * 2 + F.col("n")).alias("position"), "majors")
