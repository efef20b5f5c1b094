"""What payloads cost: lines read per kind, exchanges of whole postings, tries of unreadable files."""

import json
import re

from pyspark.sql import functions as F

from postmill.plans import views
from postmill.session import new_folder
from postmill.sources import json_feeds, union
from postmill.streaming import ingest


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_kind_reads_its_own_lines(spark, sf_dir):
    """The lines are chosen before the number among rows with equal order and line is made."""
    for kind in ("greenhouse", "lever", "adzuna"):
        text = plan(views.payloads(spark, sf_dir)[kind])
        below = text[text.index("Window") :]
        assert "l_linenumber" in below and "% 3)" in below, kind


def test_payloads_lose_no_line(spark, sf_dir):
    posts = views.feed(spark, sf_dir).groupBy(F.split("source", "/")[0].alias("kind")).count()
    expected = {r["kind"]: r["count"] for r in posts.collect()}
    field = {"Greenhouse": ("greenhouse", "jobs"), "org": ("lever", "postings"), "Adzuna": ("adzuna", "results")}
    raw = views.payloads(spark, sf_dir)
    got = {}
    for source, (kind, items) in field.items():
        got[source] = json_feeds.parse(raw[kind], kind).select(F.explode(f"doc.{items}")).count()
    assert got == expected


def test_board_name_is_made_once_per_document(spark):
    raw = spark.createDataFrame([("acme-labs", 1, "[]")], union.RAW_JSON)
    text = plan(json_feeds.read_lever(raw))
    assert text.index("Generate") < text.index("initcap")


def test_first_try_of_a_batch_joins_nothing(spark, monkeypatch):
    folder, table = new_folder(spark, "payloads"), new_folder(spark, "table")
    body = '[{"text": "Intern", "hostedUrl": "u", "descriptionPlain": "d", "categories": {"commitment": "x", "location": "y", "workplaceType": "z"}}]'
    rows = [("acme", k, body, None, None, "lever") for k in range(4)]
    raw = spark.createDataFrame(rows, "slug string, doc_ord bigint, body string, name string, text string, kind string")
    appended, append = [], ingest.append
    monkeypatch.setattr(ingest, "append", lambda df, path: appended.append(plan(df)) or append(df, path))
    ingest.land_batch(raw.where("doc_ord < 2"), 0, table)
    ingest.land_batch(raw.where("doc_ord >= 2"), 1, table)
    assert len(appended) == 2 and not any("Join" in p for p in appended)
    ingest.land_batch(raw.where("doc_ord >= 2"), 1, table)
    assert len(appended) == 2
    # What a failed try left out is added, and nothing else.
    ingest.land_batch(raw, 1, table)
    got = spark.read.parquet(table).groupBy("batch").count().collect()
    assert {(r["batch"], r["count"]) for r in got} == {(0, 2), (1, 4)}
    assert folder != table


def test_no_parquet_is_told_by_footers(spark, monkeypatch):
    """Only the readable file is read in full, once."""
    folder = new_folder(spark, "mixed")
    spark.createDataFrame([("a", 1, "[]")], union.RAW_JSON).coalesce(1).write.parquet(folder)
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.mode("append").text(folder)
    files = union.files_of(spark, folder)
    tries, failing = [], union._failing
    monkeypatch.setattr(union, "_failing", lambda s, paths, schema, columns: tries.append((len(paths), len(columns))) or failing(s, paths, schema, columns))
    lost = union.unreadable(spark, files, union.RAW_JSON)
    assert len(files) == 2 and [path[-4:] for path, _ in lost] == [".txt"]
    assert [n for n, columns in tries if columns] == [1]


def test_packing_moves_one_text_per_posting(spark, sf_dir):
    """Items are JSON before rows are sorted by document and moved; the bodies are those of whole documents."""
    posts = views.feed(spark, sf_dir, F.col("l_orderkey") < 3000)
    listed = [{"seq": r.seq, "supplier": r.supplier, "title": r.title} for r in posts.collect()]
    for raw, field in ((views.greenhouse_raw(posts), "title"), (views.lever_raw(posts), "text")):
        assert re.search(r"collect_list\(struct\(seq, seq#\w+, item, item#\w+\), 0, 0\)", plan(raw))
        for r in raw.collect():
            own = [p["title"] for p in sorted(listed, key=lambda p: p["seq"]) if packed_in(p) == r.doc_ord]
            body = json.loads(r.body)
            items = body if field == "text" else body["jobs"]
            edited = [re.sub("Co-Op|Intern", "Analyst", t) for t in own] if field == "text" else own
            assert [i[field] for i in items] == edited
            assert r.slug.removesuffix("-labs") == f"s{r.doc_ord // views.BODIES}"
            assert r.body == json.dumps(body, ensure_ascii=False, separators=(",", ":"))


def packed_in(p):
    order = p["seq"] >> views.COPY_BITS + views.LINE_BITS
    return p["supplier"] * views.BODIES + order // 500 % views.BODIES
