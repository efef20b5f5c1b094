"""Archives: contract, exact round trip, equal files for equal tables, publishing twice."""

import gzip
import hashlib

import pytest

from postmill.llm import warc
from postmill.llm.files import range_bounds

LONG = "é" * 600
ROWS = [
    (1, "http://a/ b\r\n", LONG), (2, None, LONG), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 499),
    (6, "http://f", "é" * 499), (7, "http://g", LONG), (8, "http://h", "x" * 1000), (9, "http://i", "x" * 1000),
    (10**15, "http://far", "y" * 3000), (-(2**62), "http://low", "y" * 3000), (None, "http://none", LONG), (9, "http://i", "x" * 1000),
]
SCHEMA = "page_id bigint, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("digest", "kind", "shard", "payload", "refers_to"):
        df = df.withColumn(name, F.lit(1))
    return df


def expected():
    last = {}
    for i, _, html in ROWS:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(i, last.get(html, i))
    out, seen = [], set()
    for i, _, html in ROWS:
        data = (html or "").encode()
        to = last.get(html) if i is not None else None
        if to == i and i not in seen:
            seen.add(i)
            to = None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def files(folder):
    return {f.name: f.read_bytes() for f in sorted(folder.iterdir()) if f.name.endswith(".warc.gz")}


def test_warc(spark, pages, tmp_path):
    manifest = warc.write_warc(pages, str(tmp_path / "a"), shard_bytes=4000, file_bytes=400)
    rows = warc.read_warc(spark, manifest).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=repr) == expected()
    assert all(r["sound"] for r in rows)
    html = {i: h for i, _, h in ROWS}
    for r in rows:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert r["payload"].decode() == (html[r["page_id"]] or "")
    assert {r["url"] for r in rows if r["page_id"] in (1, 2)} == {"http://a/%20b%0D%0A", "urn:page:2"}
    written = files(tmp_path / "a")
    assert len(written) == manifest.count() > 4
    assert not [f for f in (tmp_path / "a").iterdir() if "_tmp" in f.name]
    # Other partitions and another order give the same files; so does publishing again.
    warc.write_warc(pages.repartition(5).orderBy("url"), str(tmp_path / "b"), shard_bytes=4000, file_bytes=400)
    assert files(tmp_path / "b") == written
    warc._publish(manifest, str(tmp_path / "a"))
    assert files(tmp_path / "a") == written


def test_records_are_gzip_members(spark, pages, tmp_path):
    warc.write_warc(pages, str(tmp_path / "c"))
    whole = b"".join(gzip.decompress(b) for b in files(tmp_path / "c").values())
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)
    ids = [x.split(b"\r\n")[0] for x in whole.split(b"WARC-Record-ID: ")[1:]]
    assert len(set(ids)) == len(ids)


def test_empty(spark, pages, tmp_path):
    manifest = warc.write_warc(pages.limit(0), str(tmp_path / "d"))
    assert manifest.count() == 0 and warc.read_warc(spark, manifest).count() == 0


def test_bounds_split_clumps(spark):
    keys = [*range(1000), *range(10**12, 10**12 + 1000), 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(k, 1) for k in keys], "key bigint, weight bigint")
    bounds = range_bounds(rows, 100)
    assert bounds == range_bounds(rows.repartition(7), 100) == sorted(set(bounds))
    held = [sum(a <= k < b for k in keys) for a, b in zip([-(2**63), *bounds], [*bounds, 2**63], strict=True)]
    assert max(held) <= 100 and len(held) < 40
