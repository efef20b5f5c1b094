"""Readers, catalog and union, from the semantics of the formats."""

import json

import pytest

from pyspark.sql import functions as F

from postmill.dims import catalog_df
from postmill.schemas import POSTING
from postmill.sources import json_feeds, readme_tables, union

RAW = union.RAW_JSON
TEXT = union.RAW_TEXT


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("seq").collect()]


def raw(spark, *bodies):
    data = [(slug, i, b if isinstance(b, (str, type(None))) else json.dumps(b)) for i, (slug, b) in enumerate(bodies)]
    return spark.createDataFrame(data, RAW)


def test_greenhouse(spark):
    body = {"jobs": [
        {"title": "Design Intern", "absolute_url": "u1", "company_name": "Vale", "content": "&lt;b&gt;x&lt;/b&gt; <p>a &amp; b</p>", "location": {"name": "Reno"}},
        {"title": "International Lead", "absolute_url": "u2", "location": None},
        {"title": None},
        {"title": "Co-op", "absolute_url": "u3", "content": None, "location": None, "extra": 1},
    ]}
    df = json_feeds.read_greenhouse(raw(spark, ("vale-labs", body), ("bad", "{oops"), ("none", None), ("empty", {"jobs": []})))
    assert df.columns == POSTING.names
    assert rows(df, "url", "title", "company", "description", "location", "source") == [
        ("u1", "Design Intern", "Vale", "<b>x</b>  a & b", "Reno", "Greenhouse/vale-labs"),
        ("u3", "Co-op", "Vale-Labs", "", "", "Greenhouse/vale-labs"),
    ]


def test_lever(spark):
    body = [
        {"text": "Analyst", "hostedUrl": "u1", "descriptionPlain": "d", "categories": {"commitment": "Internship", "location": "Elko", "workplaceType": "remote"}},
        {"text": "Analyst", "categories": {"commitment": "Full-time"}},
        {"text": "QA intern", "hostedUrl": "u2"},
    ]
    df = json_feeds.read_lever(raw(spark, ("3m", body), ("bad", "[1"), ("obj", {"ok": False})))
    assert rows(df, "url", "title", "company", "description", "location", "work_model", "source") == [
        ("u1", "Analyst", "3M", "d", "Elko", "remote", "Lever/3m"),
        ("u2", "QA intern", "3M", "", "", "", "Lever/3m"),
    ]


def test_adzuna(spark):
    good = {"redirect_url": "u", "title": "t", "company": {"display_name": "c"}, "description": "d",
            "location": {"display_name": "x", "area": ["US", "Nevada", "Washoe County", "Reno"]}}
    body = {"results": [good, {**good, "title": None}, {**good, "location": None}]}
    df = json_feeds.read_adzuna(raw(spark, ("term", body)))
    assert rows(df, "url", "title", "company", "description", "location", "source") == [
        ("u", "t", "c", "d", "Reno, NV", "Adzuna"), ("u", "t", "c", "d", "", "Adzuna")]


def test_rejects(spark):
    bad = raw(spark, ("a", "{oops"), ("b", {"jobs": []}), ("c", None), ("d", "[]"))
    assert {r.slug for r in json_feeds.rejects(bad, "greenhouse").collect()} >= {"a", "c"}
    assert {r.slug for r in json_feeds.rejects(raw(spark, ("a", "[1"), ("b", "[]")), "lever").collect()} == {"a"}


MARKDOWN = """# Title
| Company | Title | Place | Model | Date |
| ------- | :---: | ----- | ----- | ---- |
| --- | --- | --- | --- | --- |
| ↳ | [orphan](o) | p | m | d |
| **[Vale](http://v)** | [Design Intern](u1) | Reno, NV | Hybrid | Jan 1 |
| ↳ | **[QA * Intern](u2)** | Elko | | Jan 2 |
| [Moss](http://m) | no link | x | y | z |
| ↳ | [Field Intern](u3) | x | y | z |
| plain | [Skipped](u4) | x | y | z |
|| [Shifted](u5) | [T](u6) | x | y | z |
| short | [a](b) | c |
  | [Pad](p) | [Indented](u7) | l | w | d | more |
text"""


def test_markdown(spark):
    docs = spark.createDataFrame([("org/a", 0, MARKDOWN), ("org/b", 1, "| ↳ | [x](y) | 1 | 2 | 3 |\r\n")], TEXT)
    assert rows(readme_tables.read_markdown_tables(docs), "company", "title", "url", "location", "work_model", "posted_date", "source") == [
        ("", "orphan", "o", "p", "m", "d", "org/a"),
        ("Vale", "Design Intern", "u1", "Reno, NV", "Hybrid", "Jan 1", "org/a"),
        ("Vale", "QA * Intern", "u2", "Elko", "", "Jan 2", "org/a"),
        ("Moss", "Field Intern", "u3", "x", "y", "z", "org/a"),
        ("Shifted", "T", "u6", "x", "y", "z", "org/a"),
        ("Pad", "Indented", "u7", "l", "w", "d", "org/a"),
        ("", "x", "y", "1", "2", "3", "org/b"),
    ]


HTML = """<table><tbody>
<tr><td><b>Vale &amp; Co</b></td><td>Design Intern</td><td>Reno<br>NV</td><td><a href="u1"><img></a></td><td>3d</td></tr>
<tr><td>↳</td><td>QA Intern</td><td>Elko</td><td><a href="u2">x</a></td><td>x</td><td>4d</td></tr>
<tr><td>Moss</td><td>No Link</td><td>x</td><td>closed</td><td>5d</td></tr>
<tr><td></td><td>Field Intern</td><td>x</td><td><a href="u3">x</a></td></tr>
<tr><td>a</td><td>b</td><td>c</td></tr>
</tbody></table>
<tbody><tr><td>↳</td><td>Lost</td><td>x</td><td><a href="u4">x</a></td></tr>
<tr class="x"><td>No</td><td>No</td><td>x</td><td><a href="u5">x</a></td></tr></tbody>"""


def test_html(spark):
    docs = spark.createDataFrame([("org/h", 0, HTML)], TEXT)
    got = rows(readme_tables.read_html_tables(docs), "company", "title", "url", "location", "posted_date")
    assert got[0] == ("Vale & Co", "Design Intern", "u1", "Reno NV", "3d")
    assert got[1] == ("Vale & Co", "QA Intern", "u2", "Elko", "4d")
    assert got[2][:3] == ("Moss", "Field Intern", "u3")
    assert len(got) == 3


def test_readmes_by_catalog_format(spark):
    catalog = spark.createDataFrame(
        [("GitHub", "org/a", "markdown"), ("GitHub", "org/h", "html")], "platform string, key string, format string")
    docs = spark.createDataFrame([("org/a", 0, MARKDOWN), ("org/h", 1, HTML), ("org/x", 2, HTML)], TEXT)
    got = readme_tables.read_readmes(docs, catalog).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"org/a": 6, "org/h": 3}


def test_landed_folders_union_and_rejects(spark, tmp_path):
    body = {"jobs": [{"title": "Intern", "absolute_url": "g"}]}
    raw(spark, ("a", body), ("b", "{")).write.parquet(f"{tmp_path}/greenhouse")
    spark.createDataFrame([("org/a", 0, MARKDOWN)], TEXT).write.parquet(f"{tmp_path}/markdown")
    got = union.read_landed(spark, str(tmp_path))
    assert [r.source for r in got.orderBy("seq").collect()] == ["org/a"] * 6 + ["Greenhouse/a"]
    assert got.select("seq").distinct().count() == 7
    assert [(r.kind, r.slug) for r in union.read_rejects(spark, str(tmp_path)).collect()] == [("greenhouse", "b")]


def test_whole_text_files(spark, tmp_path):
    (tmp_path / "r.md").write_text(MARKDOWN)
    docs = spark.createDataFrame([("r.md", "org/a", 0)], "file string, name string, doc_ord bigint")
    landed = union.land_text(spark, f"{tmp_path}/*.md", docs)
    assert readme_tables.read_markdown_tables(landed).count() == 6


def test_catalog(spark):
    catalog = catalog_df(spark)
    assert union.check_catalog(catalog).count() == 0
    bad = spark.createDataFrame(
        [("Lever", "a"), ("Lever", "a"), ("Greenhouse", "B"), ("Lever", "x/y"), ("Adzuna", "Two Words")],
        "platform string, key string")
    got = {(r.platform, r.key): r.problems for r in union.check_catalog(bad).collect()}
    assert got == {("Lever", "a"): "repeated", ("Greenhouse", "B"): "not lower case,not a slug", ("Lever", "x/y"): "not a slug"}
    counts = {r.platform: r["count"] for r in catalog.groupBy("platform").count().collect()}
    assert counts == {"Adzuna": 50, "GitHub": 2, "Greenhouse": 35, "Lever": 1}
    assert catalog.where(F.col("format") == "html").count() == 1


def test_seq_is_unique_across_kinds_and_checked(spark):
    job = {"title": "Design Intern", "absolute_url": "u"}
    greenhouse = json_feeds.read_greenhouse(raw(spark, ("a", {"jobs": [job, job]}), ("b", {"jobs": [job]})))
    lever = json_feeds.read_lever(raw(spark, ("a", [{"text": "QA intern"}] * 2), ("b", [{"text": "QA intern"}])))
    table = spark.createDataFrame([("r", 0, "| A | [T](u) | x | y | z |\n| B | [T](u) | x | y | z |")], TEXT)
    both = union.union_sources(greenhouse, lever, readme_tables.read_markdown_tables(table))
    assert both.select("seq").distinct().count() == both.count() >= 6
    far = spark.createDataFrame([("a", 2**36, json.dumps({"jobs": [job]}))], RAW)
    with pytest.raises(Exception, match="does not fit"):
        json_feeds.read_greenhouse(far).collect()
