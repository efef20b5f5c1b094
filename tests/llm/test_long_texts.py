"""Texts with very many spans: linear cost, the same spans."""

import random
import re
import time

import brute
from pyspark.sql import functions as F

from postmill.llm import licenses, pii


def test_running_sums_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 4)
    rows = [(list(range(n)),) for n in (0, 1, 3, 4, 5, 8, 17)]
    df = spark.createDataFrame(rows, "v array<int>")
    sums = pii.running(F.col("v"), lambda a, b: a + b)
    for r in df.select("v", sums.alias("sums"), pii.running(F.reverse("v"), F.least).alias("least")).collect():
        assert r["sums"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))]
        assert r["least"] == [min(r["v"][::-1][: k + 1]) for k in range(len(r["v"]))]


def test_untouched_spans(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(200):
        cuts = sorted(draw.sample(range(300), 2 * draw.randint(0, 12)))
        mine = [(cuts[k], cuts[k + 1]) for k in range(0, len(cuts), 2)]
        others = [(a, a + draw.randint(1, 12)) for a in (draw.randint(0, 300) for _ in range(draw.randint(0, 8)))]
        rows.append((mine, others))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"mine {kind}, others {kind}")
    for r in df.select("mine", "others", pii.untouched(F.col("mine"), F.col("others")).alias("free")).collect():
        want = [s for s in r["mine"] if not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["others"])]
        assert r["free"] == want


def test_places_and_surroundings(spark):
    text = "@abcd x @efgh,@ijkl " * 3 + "p" * 40 + " token = abcdefgh1234 123-45-6789"
    pattern = "|".join(f"(?:{p})" for p in pii.ADDED.values())
    rows = spark.createDataFrame([(text,)], "text string").select(pii.located(F.col("text"), pattern, around=True).alias("s"))
    found = rows.first()["s"]
    assert len(found) >= 5
    for s in found:
        assert s["value"] == text[s["start"] : s["end"]]
        assert s["before"] == text[max(0, s["start"] - pii.CONTEXT) : s["start"]]
        assert s["after"] == text[s["end"] : s["end"] + 1]


def test_very_many_addresses(spark):
    text = " ".join(f"u{k}@mail{k}.example.org 10.0.{k % 256}.7 token=abcd{k:06d}efgh" for k in range(40_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, None, "a")], brute.SCHEMA)
    start = time.monotonic()
    found = {r["doc_id"]: r["pii"] for r in pii.detect(docs).collect()}
    assert time.monotonic() - start < 60
    assert found[2]["spans"] == []
    places = [(s["start"], s["end"]) for s in found[1]["base"]["email"]]
    assert places == [m.span() for m in re.finditer(r"u[0-9]+@mail[0-9]+\.example\.org", text)]
    assert len(found[1]["base"]["ip"]) == 40_000


def test_very_many_license_names():
    start = time.monotonic()
    found = licenses.scan_text("released under the mit license today " * 40_000)
    assert time.monotonic() - start < 60
    assert found["n_base"] == 40_000 and (found["first_word"], found["last_word"]) == (3, 3 + 6 * 39_999)
    assert [d["first_word"] for d in found["detections"][:2]] == [d["first_word"] - 6 for d in found["detections"][1:3]]
