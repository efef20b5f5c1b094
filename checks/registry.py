"""One query per operator, over the sample tables."""

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.words import DOCUMENT_WORDS
from postmill import dims
from postmill.functions import keys, text
from postmill.functions.urls import normalize_url
from postmill.operators import classify, dedupe, delivery, evolve, incremental, ledger, monitor, routing
from postmill.plans import daily, store, views
from postmill.schemas import JOBS, JOBS_V1, POSTING
from postmill.session import materialize, new_folder
from postmill.sources import json_feeds, readme_tables, union
from postmill.streaming import delivery_state, ingest

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def majors_text(col="majors"):
    return F.array_join(
        F.transform(col, lambda m: F.concat(m["major"], F.lit(":"), m["score"].cast("string"))), ","
    )


# --- functions --------------------------------------------------------------


@query
def normalize_page_url(spark, sf):
    pages = views.dealt(views.read(spark, sf, "pages"))
    return pages.select("page_id", normalize_url(F.col("url")).alias("normalized_url"))


@query
def normalize_posting_url(spark, sf):
    return views.postings(spark, sf).select("seq", normalize_url(F.col("url")).alias("normalized_url"))


@query
def page_text(spark, sf):
    pages = views.dealt(views.read(spark, sf, "pages"))
    return pages.select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query
def page_links(spark, sf):
    pages = views.dealt(views.read(spark, sf, "pages"))
    items = F.regexp_extract_all("html", F.lit("(?s)<li>(.*?)</li>"), F.lit(1))
    return pages.select("page_id", F.posexplode(items).alias("pos", "item")).select(
        "page_id", "pos", F.regexp_extract("item", 'href="([^"]+)"', 1).alias("href"),
        text.strip_tags(F.col("item")).alias("label"),
    )


@query
def fold_documents(spark, sf):
    docs = views.dealt(views.read(spark, sf, "documents"))
    return docs.select("doc_id", text.fold_ascii(F.col("text")).alias("folded"))


@query
def company_keys(spark, sf):
    return views.postings(spark, sf).select("seq", keys.normalize_company(F.col("company")).alias("company_key"))


@query
def title_keys(spark, sf):
    return views.postings(spark, sf).select("seq", keys.normalize_title(F.col("title")).alias("title_key"))


@query
def location_keys(spark, sf):
    return views.postings(spark, sf).select("seq", keys.normalize_location(F.col("location")).alias("location_key"))


@query
def fingerprints(spark, sf):
    return keys.with_keys(views.postings(spark, sf)).select("seq", "fingerprint")


@query
def source_priorities(spark, sf):
    return views.postings(spark, sf).select("seq", keys.source_priority(F.col("source")).alias("priority"))


@query
def intern_filter(spark, sf):
    posts = views.postings(spark, sf)
    title = F.when(F.col("work_model") == "", F.replace("title", F.lit("Intern"), F.lit("International"))).otherwise(
        F.col("title")
    )
    return posts.select("seq", title.alias("title")).where(text.is_internship(F.col("title")))


# --- collapse ----------------------------------------------------------------


@query
def dedupe_batch(spark, sf):
    kept = dedupe.dedupe_batch(views.postings(spark, sf))
    return kept.select("seq", "company_key", "company_first", "slot_first", "title", "source")


@query
def dedupe_dropped(spark, sf):
    return dedupe.dropped_by_company(views.postings(spark, sf))


@query
def containment_pairs(spark, sf):
    return dedupe.containment_pairs(dedupe.dedupe_columns(views.postings(spark, sf)))


@query
def best_per_key(spark, sf):
    return dedupe.survivors_by_key(views.postings(spark, sf))


# --- incremental ---------------------------------------------------------------


def split_history(spark, sf):
    """Keyed postings, stored once, as (history, batch)."""
    keyed = keys.with_keys(views.postings(spark, sf)).select("seq", "url", "normalized_url", "fingerprint")
    keyed = materialize(keyed, "keyed")
    return keyed.where(views.is_history()), keyed.where(~views.is_history())


@query
def existing_urls(spark, sf):
    history, batch = split_history(spark, sf)
    return incremental.existing_keys(history, batch, "normalized_url")


@query
def existing_fingerprints(spark, sf):
    history, batch = split_history(spark, sf)
    return incremental.existing_keys(history, batch, "fingerprint")


@query
def exists_by_url(spark, sf):
    history, batch = split_history(spark, sf)
    twentieth = F.concat(F.lit("&se="), (F.floor(views.order_of() / 20) * 20).cast("string"))
    probe = batch.select("seq", F.regexp_replace("url", F.lit("&se=.*"), twentieth).alias("job_url"))
    return incremental.existing(history.withColumnRenamed("url", "job_url"), probe)


@query
def select_new(spark, sf):
    history, batch = split_history(spark, sf)
    return incremental.select_new(batch, history).select("seq", "normalized_url", "fingerprint")


@query
def insert_ignore(spark, sf):
    posts = views.postings(spark, sf)
    job_url = F.regexp_replace("url", "&se=.*", "").alias("job_url")
    rows = posts.where(~views.is_history()).select("seq", job_url, "title", F.lit(None).cast("string").alias("source"))
    stored = posts.where(views.is_history()).select(job_url)
    return incremental.insert_ignore(stored, rows, F.col("seq")).select(
        "job_url", "seq", "title", "source", "posted_to_discord", "discord_channel_ids", "post_attempts", "normalized_url"
    )


# --- classification ---------------------------------------------------------------


@query
def classify_keywords(spark, sf):
    return classify.classify_keywords(views.postings(spark, sf)).select("seq", majors_text().alias("majors"))


@query
def classify_documents(spark, sf):
    docs = views.dealt(views.read(spark, sf, "documents")).select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("description")
    )
    return classify.classify_keywords(docs, DOCUMENT_WORDS).select("doc_id", majors_text().alias("majors"))


def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    labelled = classify.classify_keywords(views.postings(spark, sf))
    routed = routing.route(labelled.select("seq", "majors"), dims.channels_df(spark))
    return routed.groupBy("major", "channel_id").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"))


query(label_counts)


@query
def classify_scored(spark, sf):
    """A scorer that fails on some titles; those fall back to keywords."""

    def row_scorer(title, description):
        if "bolt" in title or "gear" in title:
            raise ValueError("no answer")
        return [("civil", 2), ("nonsense", 5), ("mechanical", 5 if "ring" in title else 2)]

    def chunk_scorer(pairs):
        answers = []
        for i, (title, description) in enumerate(pairs):
            if "bolt" not in title and "gear" not in title:
                answers += [(i, row_scorer(title, description)), (i, [("MIS", 5)]), (i + 1000, [])]
        return answers

    posts = views.postings(spark, sf).select("seq", "title", "description")
    return classify.classify(posts, scorer=chunk_scorer, row_scorer=row_scorer).select("seq", majors_text().alias("majors"))


@query
def classify_chunked(spark, sf):
    """A scorer whose answers show the chunk, by its first posting, and the place in it. Where that posting
    is about bolts it answers for seven postings only, so that chunks of 15 are discarded."""

    def chunk_scorer(pairs):
        first = pairs[0][0]
        label = ["civil", "mechanical", "MIS"][len(first) % 3]
        return [(i, [(label, i % 5 + 1)]) for i in range(7 if "bolt" in first else len(pairs))]

    posts = views.postings(spark, sf).select("seq", "title", "description")
    return classify.classify(posts, scorer=chunk_scorer).select("seq", majors_text().alias("majors"))


@query
def align_scores(spark, sf):
    asked = views.slots(spark, sf)
    aligned = classify.align_scores(asked.select("chunk_id", "index"), views.responses(asked))
    return aligned.select("chunk_id", "index", F.coalesce(majors_text(), F.lit("missing")).alias("majors"))


@query
def chunk_gate(spark, sf):
    asked = views.slots(spark, sf)
    return classify.chunk_gate(classify.align_scores(asked.select("chunk_id", "index"), views.responses(asked)))


@query
def chunk_text(spark, sf):
    return classify.chunk_text(views.slots(spark, sf))


# --- routing -----------------------------------------------------------------------


@query
def route_cards(spark, sf):
    labelled = classify.classify_keywords(views.postings(spark, sf))
    return routing.cards(routing.route(labelled, dims.channels_df(spark)))


OVERRIDES = '{"civil": 111, "MIS": "222", "poetry": 333}'


@query
def route_overridden(spark, sf):
    labelled = classify.classify_keywords(views.postings(spark, sf)).select("seq", "majors")
    channels = routing.apply_overrides(dims.channels_df(spark), OVERRIDES)
    return routing.route(labelled, channels).groupBy("channel_id").agg(F.count("*").alias("n"))


@query
def unknown_overrides(spark, sf):
    """Labels of the jobs table, taken as overrides, that are not known."""
    labels = [r["major"] for r in monitor.major_counts(views.jobs(spark, sf)).select("major").collect()]  # a few
    return routing.unknown_overrides(dims.channels_df(spark), json.dumps(dict.fromkeys(labels, "1")))


@query
def storage_rows(spark, sf):
    labelled = classify.classify_keywords(keys.with_keys(views.postings(spark, sf)))
    pending = routing.with_known_majors(labelled, ["industrial", "computer science"])
    return routing.to_rows(pending, "seq").select("seq", "job_url", "majors", "posted_to_discord", "discord_channel_ids", "fingerprint")


@query
def stored_postings(spark, sf):
    return routing.from_rows(views.jobs(spark, sf))


# --- monitoring ----------------------------------------------------------------------


def stamped(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


@query
def source_counts(spark, sf):
    return monitor.source_counts(views.jobs(spark, sf))


@query
def major_counts(spark, sf):
    return monitor.major_counts(views.jobs(spark, sf))


@query
def status_counts(spark, sf):
    return monitor.status_counts(views.jobs(spark, sf))


@query
def recent_jobs(spark, sf):
    return stamped(monitor.recent(views.jobs(spark, sf)).select("id", "job_url", "date_found"), "date_found")


@query
def failed_jobs(spark, sf):
    return stamped(
        delivery.failed(views.jobs(spark, sf)).select("id", "posted_to_discord", "post_attempts", "date_found"), "date_found"
    )


@query
def unposted_jobs(spark, sf):
    return stamped(delivery.unposted(views.jobs(spark, sf), limit=200).select("id", "post_attempts", "date_found"), "date_found")


@query
def last_run(spark, sf):
    return stamped(monitor.last_run(views.runs(spark, sf)), "started_at", "finished_at")


@query
def pass_status(spark, sf):
    return monitor.pass_status(views.jobs(spark, sf))


@query
def stats_json(spark, sf):
    runs = views.runs(spark, sf).drop("started_at", "finished_at")
    stats = monitor.stats_json(views.jobs(spark, sf), runs, F.lit("1998-01-01 00:00:00").cast("timestamp"))
    read = "struct<source_counts:map<string,bigint>, major_counts:map<string,bigint>, status_counts:map<string,bigint>, last_run:struct<id:bigint,status:string>, recent_job_count:bigint>"
    doc = stats.select(F.from_json("stats", read).alias("d")).select("d.*")

    def entries(part):
        return F.transform(F.map_entries(part), lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("name"), e["value"].alias("n")))

    single = F.array(
        F.struct(F.lit("last_run").alias("part"), F.col("last_run.status").alias("name"), F.col("last_run.id").alias("n")),
        F.struct(F.lit("recent_job_count").alias("part"), F.lit("").alias("name"), F.col("recent_job_count").alias("n")),
    )
    every = F.concat(*[entries(c) for c in ("source_counts", "major_counts", "status_counts")], single)
    return doc.select(F.explode(every).alias("e")).select("e.*")


@query
def fetch_counts(spark, sf):
    return monitor.fetch_counts(views.postings(spark, sf)).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query
def source_health(spark, sf):
    return monitor.source_health(dims.catalog_df(spark), views.postings(spark, sf))


@query
def catalog_check(spark, sf):
    """The board rules, over catalog entries made from suppliers and parts."""
    boards = views.read(spark, sf, "supplier").select(F.lit("Lever").alias("platform"), F.col("s_name").alias("key"))
    parts = views.read(spark, sf, "part").select(F.lit("Greenhouse").alias("platform"), F.col("p_type").alias("key"))
    lower = views.read(spark, sf, "part").select(
        F.lit("Lever").alias("platform"), F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("key")
    )
    return union.check_catalog(boards.unionByName(parts).unionByName(lower))


# --- delivery -------------------------------------------------------------------------


def attempts(spark, sf):
    return views.deliveries(spark, sf)


def states(df):
    return df.select("job_url", "posted_to_discord", "discord_channel_ids", "post_attempts", "last_error")


@query
def apply_results(spark, sf):
    jobs = views.jobs(spark, sf)
    wanted = delivery.targets(jobs, dims.channels_df(spark))
    return states(delivery.apply_results(jobs, wanted, attempts(spark, sf)))


@query
def apply_retry(spark, sf):
    return states(delivery.apply_retry(views.jobs(spark, sf), dims.channels_df(spark), attempts(spark, sf)))


@query
def plan_retry(spark, sf):
    page = delivery.unposted(views.jobs(spark, sf))
    return delivery.retry_targets(page, dims.channels_df(spark)).select("job_url", "rank", "major", "channel_id", "score")


@query
def retry_closed(spark, sf):
    page = delivery.unposted(views.jobs(spark, sf))
    return delivery.retry_closed(page, dims.channels_df(spark)).select("job_url", "posted_to_discord", "discord_channel_ids")


@query
def pass_counts(spark, sf):
    jobs = views.jobs(spark, sf)
    return delivery.pass_counts(jobs, delivery.apply_retry(jobs, dims.channels_df(spark), attempts(spark, sf)))


@query
def stream_delivery(spark, sf):
    """Passes of each job as a stream through the state machine."""
    passes = (
        views.read(spark, sf, "events")
        .groupBy("user_id", F.dayofmonth("ts").alias("day"))
        .agg(F.count("*").alias("labels"), F.count_if(F.col("event_type") != "error").alias("good"))
        .select(
            F.col("user_id").cast("string").alias("job_url"), (F.col("day") - 1).alias("pass_no"),
            F.col("labels").cast("int").alias("labels"),
            F.transform(F.sequence(F.lit(1), F.greatest("good", F.lit(1)).cast("int")), lambda i: i.cast("bigint")).alias("all"),
            "good",
        )
        .select("job_url", "pass_no", "labels", F.slice("all", F.lit(1), F.col("good").cast("int")).alias("delivered"))
    )
    landed = new_folder(spark, "passes")
    passes.write.parquet(landed)
    out = new_folder(spark, "delivery-states")
    stream = spark.readStream.schema(passes.schema).parquet(landed)
    running = (
        delivery_state.delivery_states(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_folder(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(delivery_state.OUTPUT).parquet(out)


# --- ledger and evolution ----------------------------------------------------------------


@query
def close_runs(spark, sf):
    closed = ledger.close_stale(views.runs(spark, sf), F.lit("2024-03-01 00:00:00").cast("timestamp"))
    return stamped(closed.select("id", "status", "finished_at"), "finished_at")


@query
def run_ledger(spark, sf):
    """Opening and closing events of every run, folded to the current view."""
    runs = views.runs(spark, sf)
    opened = runs.select(
        F.lit(0).cast("bigint").alias("version"), "id", "started_at", F.lit(None).cast("timestamp").alias("finished_at"),
        *[F.lit(None).cast("bigint").alias(c) for c in ledger.COUNTERS], F.lit("running").alias("status"),
    )
    finished = runs.where("status <> 'running'").withColumn("version", F.lit(1).cast("bigint"))
    return ledger.current_runs(opened.unionByName(finished)).select("id", "status", *ledger.COUNTERS)


@query
def evolve_backfill(spark, sf):
    old = views.jobs(spark, sf).select(
        "id", "job_url", "title", "company", "majors", "location",
        F.when(F.col("id") % 3 == 0, "stale|print").alias("fingerprint"),
    )
    table, version = evolve.backfill(evolve.evolve(old), 1)
    return table.select("id", "fingerprint", "normalized_url", "post_attempts", "source", F.lit(version).alias("version"))


@query
def read_versions(spark, sf):
    """Jobs in part files of versions 1, 2 and 3, in one folder."""
    folder = new_folder(spark, "versions")
    jobs = evolve.evolve(views.jobs(spark, sf))
    known = jobs.withColumns({
        "fingerprint": F.lit("kept|print|"), "post_attempts": F.lit(3),
        "normalized_url": F.concat(F.lit("https://kept.example.com/"), F.col("id").cast("string")),
    })
    jobs.where("id % 3 = 0").select(*JOBS_V1.names).write.parquet(folder)
    second = jobs.where("id % 3 = 1").select(*JOBS_V1.names, F.lit("stale|print").alias("fingerprint"), "location")
    second.write.mode("append").parquet(folder)
    known.where("id % 3 = 2").select(*JOBS.names).write.mode("append").parquet(folder)
    return evolve.read_versions(spark, folder).select(
        "id", "job_url", "fingerprint", "normalized_url", "post_attempts", "source", "location"
    )


@query
def stored_jobs(spark, sf):
    """Jobs table read back from a store after a retry pass was recorded."""
    jobs = views.jobs(spark, sf)
    target = store.Store.create(spark, new_folder(spark, "store"))
    full = evolve.evolve(jobs).select(*JOBS.names)
    store.append(full, target.inserts_path)
    after = delivery.apply_retry(target.jobs(), dims.channels_df(spark), attempts(spark, sf))
    target.record_states(after, version=1)
    return states(target.jobs())


# --- readers ------------------------------------------------------------------------------


TEXT_COLUMNS = [c for c in POSTING.names if c != "seq"]


@query
def read_greenhouse(spark, sf):
    return json_feeds.read_greenhouse(views.greenhouse_raw(views.feed(spark, sf))).select(*POSTING.names)


@query
def read_lever(spark, sf):
    return json_feeds.read_lever(views.lever_raw(views.feed(spark, sf))).select(*POSTING.names)


@query
def read_adzuna(spark, sf):
    return json_feeds.read_adzuna(views.adzuna_raw(views.feed(spark, sf))).select(*POSTING.names)


@query
def read_markdown(spark, sf):
    return readme_tables.read_markdown_tables(views.readme_docs(spark, sf, True)).select(*TEXT_COLUMNS)


@query
def read_html(spark, sf):
    return readme_tables.read_html_tables(views.readme_docs(spark, sf, False)).select(*TEXT_COLUMNS)


@query
def read_readmes(spark, sf):
    """Documents of both formats, told apart by the catalog entry of their name."""
    brands = views.read(spark, sf, "part").select(F.expr("concat(p_brand, '/', p_partkey div 500)").alias("key")).distinct()
    catalog = brands.select(
        F.lit("GitHub").alias("platform"), "key", F.when(F.col("key").endswith("0"), "markdown").otherwise("html").alias("format")
    )
    docs = views.readme_docs(spark, sf, True).where(F.col("name").endswith("0")).unionByName(
        views.readme_docs(spark, sf, False).where(~F.col("name").endswith("0"))
    )
    return readme_tables.read_readmes(docs, catalog).select(*TEXT_COLUMNS)


def land_all(spark, sf):
    """All five kinds landed as files, with broken bodies among them."""
    folder = new_folder(spark, "landed")
    broken = F.when(F.col("doc_ord") % 10 == 3, F.concat(F.lit("{"), F.col("body"))).otherwise(F.col("body"))
    for kind, raw in views.payloads(spark, sf).items():
        (raw.withColumn("body", broken) if kind == "lever" else raw).write.parquet(f"{folder}/{kind}")
    return folder


@query
def read_landed(spark, sf):
    """All kinds read together; postings per source kind, rejects, and different `seq`."""
    folder = land_all(spark, sf)
    got = materialize(union.read_landed(spark, folder).select("seq", F.split("source", "/")[0].alias("kind")), "read")
    lost = union.read_rejects(spark, folder).groupBy(F.concat(F.lit("rejected "), F.col("kind")).alias("kind"))
    unique = got.agg(F.count_distinct("seq").alias("n")).select(F.lit("different seq").alias("kind"), "n")
    counted = got.groupBy("kind").agg(F.count("*").alias("n"))
    return counted.unionByName(lost.agg(F.count("*").alias("n"))).unionByName(unique)


@query
def read_damaged(spark, sf):
    """All kinds read although each JSON kind has a file that is no Parquet; postings per source kind, and lost files."""
    folder = land_all(spark, sf)
    regions = views.read(spark, sf, "region").select(F.concat(F.lit("PAR1 cut "), "r_name").alias("value"))
    for kind in ("adzuna", "greenhouse", "lever"):
        regions.coalesce(1).write.mode("append").text(f"{folder}/{kind}")
    postings, lost = union.read_isolated(spark, folder)
    lost = lost.groupBy(F.concat(F.lit("lost "), "kind").alias("kind")).agg(F.count("*").alias("n"))
    return postings.groupBy(F.split("source", "/")[0].alias("kind")).agg(F.count("*").alias("n")).unionByName(lost)


# --- whole runs -----------------------------------------------------------------------------


@query
def stream_first_seen(spark, sf):
    """Postings that land in three parts, each read by a run of its own."""
    landed, table, offsets = (new_folder(spark, name) for name in ("landed", "seen", "offsets"))
    posts = materialize(views.postings(spark, sf), "posts")
    for part in range(3):
        # One run over what has landed since the one before.
        posts.where(views.order_of() % 3 == part).write.mode("append").parquet(landed)
        ingest.first_seen(spark, ingest.posting_stream(spark, landed, 10**6), table, offsets).awaitTermination()
    return spark.read.schema(ingest.SEEN).parquet(table).select("seq", "normalized_url", "fingerprint", "batch")


@query
def stream_first_within(spark, sf):
    """Postings of four days, each landed and read by itself, without repeats within three days."""
    landed, table, offsets = (new_folder(spark, name) for name in ("landed", "within", "offsets"))
    posts = materialize(views.postings(spark, sf), "posts")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSTING.fields) + ", ts timestamp"
    for part, day in enumerate((1, 2, 9, 10)):
        dated = posts.where(views.order_of() % 4 == part).withColumn("ts", F.expr(f"timestamp'2024-01-{day:02} 12:00:00'"))
        dated.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(kinds).parquet(landed)
        ingest.first_seen_within(stream, "ts", "3 days", table, offsets).awaitTermination()
    return spark.read.parquet(table).select("normalized_url", F.day("ts").alias("day"))


@query
def stream_payloads(spark, sf):
    """Raw payloads of all kinds that land in three parts, each read by a run of its own; then the second part's batch
    is repeated, as after a failure."""
    landed, table, offsets = (new_folder(spark, name) for name in ("landed", "postings", "offsets"))
    kinds = {kind: materialize(raw, kind) for kind, raw in views.payloads(spark, sf).items()}
    for part in range(3):
        for kind, raw in kinds.items():
            raw.where(F.col("doc_ord") % 3 == part).write.mode("append").parquet(f"{landed}/{kind}")
        ingest.land_payloads(ingest.landed_stream(spark, landed, 10**6), table, offsets).awaitTermination()
    again = [raw.where(F.col("doc_ord") % 3 == 1).withColumn("kind", F.lit(kind)) for kind, raw in kinds.items()]
    ingest.land_batch(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), again), 1, table)
    return spark.read.schema(ingest.LANDED).parquet(table).select(*TEXT_COLUMNS, "batch")


@query
def daily_run(spark, sf):
    """A first full run over an empty store; every delivery succeeds."""

    def send(cards):
        return cards.select(
            F.col("url").alias("job_url"), "major", "rank", "channel_id", F.lit(True).alias("ok"), F.current_timestamp().alias("ts")
        )

    target = store.Store.create(spark, new_folder(spark, "store"))
    daily.run_batch(target, views.postings(spark, sf), send)
    return target.runs().select("id", "status", *ledger.COUNTERS)


@query
def daily_run_landed(spark, sf):
    """A first full run over everything landed: nothing gained, nothing lost."""

    def send(cards):
        return cards.select(
            F.col("url").alias("job_url"), "major", "rank", "channel_id", F.lit(True).alias("ok"), F.current_timestamp().alias("ts")
        )

    target = store.Store.create(spark, new_folder(spark, "store"))
    daily.run_batch(target, union.read_landed(spark, land_all(spark, sf)), send)
    kept = F.col("fetched") - F.col("deduped")
    return target.runs().select(
        "status", "fetched", "errors", ((F.col("deduped") > 0) & (F.col("new_jobs") <= kept) & (F.col("posted") > 0)).alias("consistent")
    )
